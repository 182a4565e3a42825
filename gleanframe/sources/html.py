"""Pages as node tables: one pass of the standard parser for each page, over Arrow batches."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cuts import cut

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "template", "textarea", "title"))
# a start tag of the first closes an open one of the second
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# tags that need none of the parser's care: attributes in double quotes without entities, a name that begins no raw text
_PLAIN = re.compile(r'<(?!(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)[ >])([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>')
_PAIR = re.compile(r' ([a-z-]+)="([^"]*)"')
_PLAIN_END = re.compile("</([a-z][a-z0-9]*)>")

NODES = "page_id long, pre int, end int, parent int, tag string, id string, classes array<string>, attrs map<string,string>, text string"


_ARROW = pa.schema([("page_id", pa.int64()), ("pre", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
#: Characters of a page that are parsed, and nodes that are held, before nodes go out.
PIECE, ROWS = 1 << 18, 4096


# shared by all nodes without, and never changed
_NO_ATTRS: dict[str, str] = {}
_NO_CLASSES: list[str] = []


class _Tree(HTMLParser):
    """Nodes as they end; `end` is the last number in a node's subtree, text its own text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.count = 0
        self.open: list[list] = []
        self.closed: list[list] = []

    def updatepos(self, i, j):
        return j  # lines and columns tell nothing here

    def _pop(self, to: int):
        while len(self.open) > to:
            node = self.open.pop()
            node[1] = self.count - 1
            if isinstance(node[7], list):
                node[7] = "".join(node[7])
            self.closed.append(node)

    def parse_starttag(self, i):
        found = _PLAIN.match(self.rawdata, i)
        if found is None:
            return super().parse_starttag(i)
        self.handle_starttag(found[1], _PAIR.findall(found[2]))
        return found.end()

    def parse_endtag(self, i):
        found = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if found is None:
            return super().parse_endtag(i)
        self.handle_endtag(found[1])
        return found.end()

    def handle_starttag(self, tag, attrs):
        closes = ("p",) if tag in _BLOCKS else _CLOSES.get(tag, ())
        for depth in range(len(self.open) - 1, -1, -1):
            kind = self.open[depth][3]
            if kind in closes:
                self._pop(depth)
                break
            if kind in ("table", "ul", "ol", "dl", "div", "body", "select", "article", "section") and kind != tag:
                break
        known = {k: v or "" for k, v in attrs} if attrs else _NO_ATTRS
        said = known.get("class")
        node = [self.count, self.count, self.open[-1][0] if self.open else None, tag, known.get("id"), said.split() if said else _NO_CLASSES, known, ""]
        self.count += 1
        (self.closed if tag in _VOID else self.open).append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][3] == tag:
                self._pop(depth)
                break

    def handle_data(self, data):
        if self.open:
            node = self.open[-1]
            if isinstance(node[7], list):
                node[7].append(data)
            else:
                node[7] = [node[7], data] if node[7] else data


def ended(page: str | None, piece: int = PIECE) -> Iterator[list[list]]:
    """Lists of nodes in the order in which they end; the page is parsed piece by piece, cut before a tag."""
    return (done for done, _ in ended_and_open(page, piece))


def ended_and_open(page: str | None, piece: int = PIECE) -> Iterator[tuple[list[list], list[list]]]:
    """Of each piece the nodes that ended in it, and those that are open behind it, outermost first."""
    tree, at, page = _Tree(), 0, page or ""
    while at < len(page):
        to = page.find("<", at + piece)
        to = len(page) if to < 0 else to
        tree.feed(page[at:to])
        at = to
        yield tree.closed, tree.open
        tree.closed = []
    tree.close()
    tree._pop(0)
    yield tree.closed, tree.open


def parse(page: str | None) -> list[list]:
    """Nodes in document order."""
    nodes: list[list] = []
    for found in ended(page):
        nodes += found
    nodes.sort(key=itemgetter(0))
    return nodes


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    page, pre, end, parent, tag, ident, classes, attrs, text = zip(*((p, *n) for p, n in rows))
    ends = lambda parts: pa.array([0, *pd.Series(list(map(len, parts))).cumsum()], pa.int32())
    listed = pa.ListArray.from_arrays(ends(classes), pa.array([c for cs in classes for c in cs], pa.string()))
    mapped = pa.MapArray.from_arrays(ends(attrs), pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string()))
    plain = [pa.array(c, f.type) for c, f in zip((page, pre, end, parent, tag, ident), _ARROW)]
    return pa.RecordBatch.from_arrays([*plain, listed, mapped, pa.array(text, pa.string())], schema=_ARROW)


def page_nodes(pages: DataFrame, rows_at_a_time: int = ROWS) -> DataFrame:
    """pages (page_id, html) -> nodes; a node holds another if pre < other.pre <= end. No shuffle.

    Nodes go out as they end, so that of a page of any length only a piece and the nodes that are open are held.
    """

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found in ended(text.as_py()):
                    held += [(page, n) for n in found]
                    while len(held) >= rows_at_a_time:
                        yield _batch(held[:rows_at_a_time])
                        held = held[rows_at_a_time:]
        if held:
            yield _batch(held)

    return pages.selectExpr("cast(page_id as long) as page_id", "html").mapInArrow(run, NODES)


def stored_nodes(pages: DataFrame) -> DataFrame:
    """page_nodes, parsed once into the shared folder and dealt by page_id: what joins and windows by page make of them
    needs no other exchange, since partitions by a given number are kept."""
    return by_page(cut(page_nodes(pages), "nodes"))


def by_page(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")


def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _html.unescape(t) if t is not None else None)


def unescape(text: Column) -> Column:
    """All of HTML's entities."""
    return F.pandas_udf(_unescaped, "string")(text)


def _joined(c: dict) -> Column:
    folded = F.concat(F.lit("/"), F.array_join(c["steps"], "/"), F.when(c["whole"].rlike(r"/\.\.?$") & (F.size(c["steps"]) > 0), "/").otherwise(""))
    href, path, tail = c["href"], c["path"], c["tail"]
    return (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(c["base"], "(?i)^[a-z][a-z0-9+.-]*:", 0), href))
        .when(path == "", F.concat(c["front"], F.when(tail.startswith("?"), c["bare"]).otherwise(F.regexp_extract(c["rest"], "^[^#]*", 0)), tail))
        .when(c["dotted"], F.concat(c["front"], folded, tail))
        .otherwise(F.concat(c["front"], c["whole"], tail))
    )


_FOLDED = lambda whole: F.aggregate(F.split(F.substring(whole, 2, 1 << 20), "/"), F.array().cast("array<string>"), lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.array_append(out, s)))
#: Steps of absolute; each has names and functions of the columns so far.
ABSOLUTE = (
    {"front": lambda c: F.regexp_extract(c["base"], "(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", 0), "path": lambda c: F.regexp_extract(c["href"], "^[^?#]*", 0)},
    {"rest": lambda c: F.substring(c["base"], F.length(c["front"]) + 1, F.length(c["base"])), "tail": lambda c: F.substring(c["href"], F.length(c["path"]) + 1, F.length(c["href"]))},
    {"bare": lambda c: F.regexp_extract(c["rest"], "^[^?#]*", 0)},
    {"whole": lambda c: F.when(c["path"].startswith("/"), c["path"]).otherwise(F.concat(F.when(F.contains(c["bare"], F.lit("/")), F.regexp_extract(c["bare"], "^(.*/)[^/]*$", 1)).otherwise("/"), c["path"]))},
    {"dotted": lambda c: c["whole"].rlike(r"(^|/)\.\.?(/|$)")},
    {"steps": lambda c: F.when(c["dotted"], _FOLDED(c["whole"]))},
    {"to": _joined},
)


def absolute(base: Column, href: Column) -> Column:
    """An absolute url by RFC 3986, in expressions; only paths with dots between slashes are folded part by part. For whole
    tables see operators.dedupe.stepwise with ABSOLUTE, which computes each step once."""
    c = {"base": base, "href": href}
    for step in ABSOLUTE:
        c |= {name: f(c) for name, f in step.items()}
    return c["to"]
