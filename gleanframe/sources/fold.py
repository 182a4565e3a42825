"""Items of pages in the pass that parses them: what each candidate says and links, one row for each, no shuffle.

Only what needs the tree is done here. Urls are made absolute, normalised and identified by columns afterwards.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .html import PIECE, ended_and_open, parse

PRE, END, PARENT, TAG, ID, CLASSES, ATTRS, TEXT = range(8)

ITEMS = "page_id long, url string, main boolean, item int, title string, page_title string, slug string, words string, chars int, summary string, hrefs array<string>, said array<string>, starter string, replies int"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("main", pa.bool_()), ("item", pa.int32()), ("title", pa.string()), ("page_title", pa.string()), ("slug", pa.string()), ("words", pa.string()), ("chars", pa.int32()), ("summary", pa.string()), ("hrefs", pa.list_(pa.string())), ("said", pa.list_(pa.string())), ("starter", pa.string()), ("replies", pa.int32())])
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
_SILENT = ("script", "style", "template")
#: Where an open node ends, as far as is known; links of a main part that go out in one row; characters of a summary.
_OPEN, LINKS, SUMMARY = 1 << 60, 10_000, 400


def spaced(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def outside(nodes: list, banned: Callable[[list], bool]) -> list:
    """nodes without the subtrees of banned ones."""
    out, until = [], -1
    for n in nodes:
        if n[PRE] > until:
            if banned(n):
                until = n[END]
            else:
                out.append(n)
    return out


def outermost(nodes: list, picked: Callable[[list], bool]) -> list:
    out, until = [], -1
    for n in nodes:
        if n[PRE] > until and picked(n):
            out.append(n)
            until = n[END]
    return out


class Rules:
    """What counts as furniture, an item, a title, a quote: fixed values of the operators, as plain functions of nodes."""

    def __init__(self, selectors: tuple, furniture: tuple, signatures: tuple, title_classes: tuple, ui_words: tuple, quotes: tuple, slug: str, data_links: tuple, board: bool, profile: str, topic: str):
        self.selectors, self.furniture, self.signatures, self.title_classes = selectors, frozenset(furniture), frozenset(signatures), frozenset(title_classes)
        self.ui_words, self.quotes, self.data_links, self.board = ui_words, frozenset(quotes), data_links, board
        self.slug, self.profile, self.topic = slug, profile, topic


def _simple(selector: tuple, n: list) -> bool:
    tag, attribute, how, value = selector
    if tag and n[TAG] != tag:
        return False
    if attribute == "class":
        return value in n[CLASSES]
    if attribute:
        held = n[ID] or ""
        return held == value if how == "is" else held.startswith(value)
    return True


class Page:
    def __init__(self, tree: list, rules: Rules):
        passwords = [n[PRE] for n in tree if n[TAG] == "input" and n[ATTRS].get("type", "").lower() == "password"]

        def furniture(n: list) -> bool:
            if n[TAG] in rules.furniture or not rules.signatures.isdisjoint(n[CLASSES]) or re.match("msg_.*_signature$", n[ID] or ""):
                return True
            if n[TAG] != "form":
                return False
            i = bisect_right(passwords, n[PRE])
            return n[ATTRS].get("role") == "search" or "search" in " ".join([*n[CLASSES], n[ATTRS].get("action", "")]).lower() or (i < len(passwords) and passwords[i] <= n[END])

        self.rules, self.nodes = rules, outside(tree, furniture)
        self.at = [n[PRE] for n in self.nodes]

    def within(self, top: list) -> list:
        return self.nodes[bisect_left(self.at, top[PRE]) : bisect_right(self.at, top[END])]

    def text(self, top: list) -> str:
        return spaced(" ".join(n[TEXT] for n in self.within(top) if n[TAG] not in _SILENT))

    def candidates(self) -> list:
        reach = {}  # of the outer half of a selector: the end of what it holds so far
        def picked(n: list) -> bool:
            found = False
            for s in self.rules.selectors:
                if not isinstance(s[0], tuple):
                    found = found or _simple(s, n)
                    continue
                if _simple(s[1], n):
                    reach[s] = max(reach.get(s, -1), n[END])
                found = found or (reach.get(s, -1) >= n[PRE] and _simple(s[0], n))
            return found

        chosen = [n for n in self.nodes if picked(n)]
        return outermost(chosen, lambda n: True)

    @staticmethod
    def as_main(n: list) -> int | None:
        return 0 if n[TAG] == "main" or n[ATTRS].get("role") == "main" or n[ID] == "content" else 1 if n[TAG] == "body" else 2 if n[PARENT] is None else None

    def main(self) -> list | None:
        best = None
        for n in self.nodes:
            rank = self.as_main(n)
            if rank is not None and (best is None or rank < best[0]):
                best = (rank, n)
        return best and best[1]

    def as_title(self, n: list) -> int | None:
        if n[TAG] in ("h1", "h2", "h3"):
            return int(n[TAG][1])
        return 4 if not self.rules.title_classes.isdisjoint(n[CLASSES]) else 5 if n[TAG] == "a" else None

    def titled(self, n: list) -> tuple[int, str] | None:
        """Rank and text of a node that can be a title."""
        r, t = self.as_title(n), self.text(n)
        fits = len(t) >= 3 if r < 5 else len(t) >= 5 and t.lower() not in self.rules.ui_words
        return (r, t) if fits else None

    def title(self, top: list) -> str | None:
        best = None
        for n in outermost(self.within(top), lambda n: self.as_title(n) is not None):
            found = self.titled(n)
            if found and (best is None or found[0] < best[0]):
                best = found
        return best and best[1]

    def page_title(self) -> str | None:
        return next((spaced(n[TEXT]) for n in self.nodes if n[TAG] == "title"), None)

    def own_words(self, top: list) -> tuple[str | None, str | None]:
        """The catalogue's name in a post's links, and its text without quotes and labels of links."""
        own = outside(self.within(top), lambda n: n[TAG] == "blockquote" or not self.rules.quotes.isdisjoint(n[CLASSES]))
        slug = next((m[1] for n in own if (m := re.search(self.rules.slug, " ".join([*n[ATTRS].values(), n[TEXT]]), re.ASCII))), None)
        words = outside(own, lambda n: n[TAG] == "a")
        return slug, " ".join(n[TEXT] for n in words) if words else None

    def links(self, top: list) -> tuple[list[str], list[str]]:
        """Hrefs, and texts that may hold urls."""
        return self.links_of(self.within(top))

    def links_of(self, nodes: list) -> tuple[list[str], list[str]]:
        hrefs, said = [], []
        for n in nodes:
            a = n[ATTRS]
            hrefs += [a[k] for k in (("href",) if n[TAG] == "a" else ()) + self.rules.data_links if k in a]
            if n[TAG] != "a" and "//" in n[TEXT]:
                said.append(n[TEXT])
        return hrefs, said

    def starter(self, row: list) -> tuple[str | None, int | None]:
        """Of a board's row the member of the first cell that links a profile and no topic, and the first number behind."""
        name, replies, begun = None, None, False
        for cell in (n for n in self.within(row) if n[TAG] == "td" and n[PARENT] == row[PRE]):
            t = re.sub("[.,]", "", self.text(cell))
            if begun:
                if re.fullmatch("[0-9]{1,9}", t):
                    return name, int(t)
                continue
            anchors = [n for n in self.within(cell) if n[TAG] == "a"]
            members = [n for n in anchors if re.search(self.rules.profile, n[ATTRS].get("href", ""))]
            if members and not any(re.search(r"topic[=,]\d+", n[ATTRS].get("href", "")) for n in anchors):
                name, begun = members[0][TEXT].strip(" ") or members[0][ATTRS]["href"], True
        return name, replies

    def links_topic(self, row: list) -> bool:
        return any(n[TAG] == "a" and re.search(self.rules.topic, n[ATTRS].get("href", "")) for n in self.within(row))


class _Main:
    """What a main part says, gathered from its nodes as they end."""

    def __init__(self, top: list):
        self.top, self.best, self.chars, self.said_by = top, None, -1, []
        self.hrefs, self.texts = {}, {}

    def add(self, page: Page, fresh: set) -> None:
        """fresh: places of nodes that have ended since the last time; page holds these and what is open."""
        mine = page.within(self.top)
        for n in outermost(mine, lambda n: page.as_title(n) is not None):
            if n[PRE] in fresh and (found := page.titled(n)) and (self.best is None or (found[0], n[PRE]) < self.best[:2]):
                self.best = (found[0], n[PRE], found[1])
        mine = [n for n in mine if n[PRE] in fresh]
        for n in mine:
            if n[TAG] not in _SILENT and (t := spaced(n[TEXT])):
                self.chars += len(t) + 1
                self.said_by.append((n[PRE], t[:SUMMARY]))
        hrefs, texts = page.links_of(mine)
        self.hrefs |= dict.fromkeys(hrefs)
        self.texts |= dict.fromkeys(texts)
        if len(self.said_by) > SUMMARY:
            self.summary()

    def summary(self) -> str:
        """The first characters; of what has been said, no more than makes them is kept."""
        self.said_by.sort()
        del self.said_by[SUMMARY:]  # each has a character at least
        return " ".join(t for _, t in self.said_by)[:SUMMARY]

    def rows(self, page_id: int, url: str | None, page_title: str | None) -> Iterator[tuple]:
        hrefs, texts = list(self.hrefs), list(self.texts)
        yield page_id, url, True, self.top[PRE], self.best and self.best[2], page_title, None, None, max(self.chars, 0), self.summary(), hrefs[:LINKS], texts[:LINKS], None, None
        for at in range(LINKS, max(len(hrefs), len(texts)), LINKS):
            yield page_id, url, True, self.top[PRE], None, None, None, None, None, None, hrefs[at : at + LINKS], texts[at : at + LINKS], None, None


def in_stream(text: str | None) -> bool:
    """Whether a board's rows can go out before the page has ended: no later part of it decides what is furniture (a form
    with a password) or what the page is called."""
    text = text or ""
    row, title = re.search(r"<tr[\s/>]", text, re.I), None
    for title in re.finditer("<title", text, re.I):
        if row is None or title.start() > row.start():
            return False
    return row is not None and not (re.search("<form", text, re.I) and re.search("<input", text, re.I))


def board_rows(page_id: int, url: str | None, text: str | None, rules: Rules, piece: int = PIECE) -> Iterator[tuple]:
    """Of a board the rows as they end, and its main part behind them. Of the page are held: what is open, the nodes of a
    row or title that is, and what its main part links."""
    held: list = []
    mains: dict[int, _Main] = {}
    page_title, sent = None, False
    for done, spine in ended_and_open(text, piece):
        for n in spine:
            n[END] = _OPEN
        page = Page(sorted([*spine, *held, *done], key=lambda n: n[PRE]), rules)
        fresh = {n[PRE] for n in done}
        if page_title is None:
            first = next((n for n in page.nodes if n[TAG] == "title"), None)
            page_title = spaced(first[TEXT]) if first and first[END] < _OPEN else None
        chosen = page.candidates()
        for top in chosen:
            if top[PRE] in fresh and page.links_topic(top):
                if not sent and page_title is None and any(n[TAG] == "title" for n in spine):
                    yield from _rows(page_id, url, text, rules)  # a title without an end
                    return
                sent, t = True, page.text(top)
                yield page_id, url, False, top[PRE], page.title(top), page_title, *page.own_words(top), len(t), t[:SUMMARY], *page.links(top), *page.starter(top)
        for n in page.nodes:
            if (rank := page.as_main(n)) is not None and rank not in mains:
                mains[rank] = _Main(n)
        for main in mains.values():
            main.add(page, fresh)
        least = min([_OPEN, *(n[PRE] for n in chosen if n[END] == _OPEN), *(n[PRE] for n in spine if page.as_title(n) is not None)])
        held = [n for n in (*held, *done) if n[PRE] > least]
    if mains:
        yield from mains[min(mains)].rows(page_id, url, page_title)


def _rows(page_id: int, url: str | None, text: str | None, rules: Rules) -> Iterator[tuple]:
    page = Page(parse(text), rules)
    chosen = [(False, n) for n in page.candidates() if not rules.board or page.links_topic(n)]
    main, title = page.main(), page.page_title()
    for is_main, top in [*chosen, *([(True, main)] if main else [])]:
        t = page.text(top)
        starter, replies = page.starter(top) if rules.board and not is_main else (None, None)
        yield page_id, url, is_main, top[PRE], page.title(top), title, *page.own_words(top), len(t), t[:SUMMARY], *page.links(top), starter, replies


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _ARROW)], schema=_ARROW)


def in_rows(batches: Iterator[pa.RecordBatch], rules: Rules, at_a_time: int) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    for batch in batches:
        for one in zip(*batch.columns):
            page_id, url, text = (v.as_py() for v in one)
            rows = board_rows if rules.board and in_stream(text) else _rows
            for row in rows(page_id, url, text, rules):
                found.append(row)
                if len(found) == at_a_time:
                    yield _batch(found)
                    found = []
    if found:
        yield _batch(found)


def page_items(pages: DataFrame, rules: Rules, at_a_time: int = 1000) -> DataFrame:
    """pages (page_id, url, html) -> ITEMS: the candidates of each page, and its main part as one more row; of a board's
    main part, links beyond LINKS as rows of their own. One page is held at a time, of most boards its text alone, and so
    many rows."""
    run = lambda batches: in_rows(batches, rules, at_a_time)
    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(run, ITEMS)
