"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field over what looks like data.

The patterns decide emails, IP addresses, payment cards and phone numbers. The field then labels every token that holds
a digit or an at sign: neighbouring tokens share a potential, and so do distant ones that repeat each other (long numbers
by their digits, whatever stands between and before them) or look alike, through one hub for all that are alike, so that
distance in a document costs nothing. Loopy message passing, until it settles, gives the marginals of all labels; tokens
that are personal data by them add spans where the patterns have none: a number that was once given with its country code
and then without, for one.

Labels for training are the patterns' hits and, as evidence that the patterns don't see, all repeats of a hit.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: In the order in which spans that start together are listed; label 0 is none of them.
KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is trained on (on average, drawn by a hash of doc_id); rounds of messages at most, and the
#: largest change of a message with which they have settled; probability from which a token is personal data.
SAMPLE, ROUNDS, SETTLED, SURE = 4000, 300, 1e-4, 0.9
#: Digits from which a token without letters is known by its digits alone, and that a span added as a number has at least;
#: digits at most of a number written in groups, by kind (as in the patterns).
NUMBER, DIGITS = 7, {2: 19, 3: 15}
STEPS, RATE = 200, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN, _TOKEN, _DIGIT = re.compile(r"[0-9@]"), re.compile(r"\S+"), re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str):
    """Runs of local characters are looked at once, from the at sign back: long runs cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order: the contract's patterns, leftmost and non-overlapping within a kind."""
    if not _SIGN.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


FEATURES = 20


_EDGE_SIGNS = ".,;:!?\"'()<>[]{}#*$%&"


def _nodes(text: str, base: list[tuple[int, int, int]]):
    """Tokens with a digit or an at sign: spans without the signs around them, features, normal forms, shapes, and labels
    by the patterns (0: none)."""
    spans, rows, forms, shapes = [], [], [], []
    end_before, last = -9, ""
    for m in _TOKEN.finditer(text):
        token = m[0]
        if not _SIGN.search(token):
            last = token
            continue
        core = token.strip(_EDGE_SIGNS)
        a = m.start() + len(token) - len(token.lstrip(_EDGE_SIGNS))
        found = _DIGIT.findall(core)
        digits, dots, n = len(found), core.count("."), len(core)
        has_at, letters = "@" in core, any(c.isalpha() for c in core)
        rows.append((1, has_at, has_at and "." in core.rpartition("@")[2], core[:1] == "+", digits == 0, digits < 4, 4 <= digits < 9, 9 <= digits < 12, 12 <= digits < 20, digits >= 20, digits == n, dots == 3, dots > 0, "-" in core, "(" in token, digits < n and letters, n > 30, a - end_before < 3, last[-1:] in ":=", core[:1].isdigit()))
        spans.append((a, a + n))
        forms.append("".join(found) if digits >= NUMBER and not letters and not has_at else core.lower())
        shapes.append(re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", core)) + f"/{digits}")
        end_before, last = a + n, token
    labels, ends, tokens = [0] * len(spans), [b for _, b in spans], len(spans)
    for start, kind, end in base:
        i = bisect_right(ends, start)
        while i < tokens and spans[i][0] < end:
            labels[i] = labels[i] or kind + 1
            i += 1
        digits = "".join(_DIGIT.findall(text[start:end])) if kind > 1 else ""
        if len(digits) >= NUMBER:  # what is written in groups is a node as a whole, too, which its repeats can meet
            spans.append((start, end))
            rows.append((0,) * FEATURES)
            forms.append(digits)
            shapes.append("")
            labels.append(kind + 1)
    return spans, rows, forms, shapes, labels


def _edges(spans, forms, shapes) -> tuple[np.ndarray, np.ndarray, int]:
    """(from, to), kind of edge (0 neighbours, 1 repeats, 2 look-alikes), and the number of hubs, which come after the
    tokens: one for each form, and each shape of several forms, that occurs more than once."""
    out = [(i - 1, i) for i in range(1, len(spans)) if 0 <= spans[i][0] - spans[i - 1][1] < 3]
    kinds, hub = [0] * len(out), len(spans)
    by_form: dict[str, list[int]] = {}
    by_shape: dict[str, dict[str, int]] = {}
    for i, (form, shape) in enumerate(zip(forms, shapes)):
        by_form.setdefault(form, []).append(i)
        if shape:
            by_shape.setdefault(shape, {}).setdefault(form, i)
    for kind, groups in ((1, by_form.values()), (2, (list(g.values()) for g in by_shape.values()))):
        for members in groups:
            if len(members) > 1:
                out += [(i, hub) for i in members]
                kinds += [kind] * len(members)
                hub += 1
    return np.array(out, np.int64).reshape(-1, 2), np.array(kinds, np.int64), hub - len(spans)


class Field:
    """unary: (label, feature) weights; pair: (kind of edge, label, label) log potentials."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, x: np.ndarray, edges: np.ndarray, kinds: np.ndarray, hubs: int = 0) -> np.ndarray:
        """Loopy max-normalised sum-product on all nodes and edges at once, damped by half, until it settles. The last
        nodes are hubs, of which nothing is known."""
        local = np.concatenate([x @ self.unary.T, np.zeros((hubs, len(self.unary)))])
        if len(edges):
            ends = np.concatenate([edges, edges[:, ::-1]])
            psi = np.concatenate([self.pair[kinds], self.pair[kinds].transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            sent = np.zeros((len(ends), local.shape[1]))
            for _ in range(ROUNDS):
                belief = local.copy()
                np.add.at(belief, ends[:, 1], sent)
                out = (belief[ends[:, 0]] - sent[back])[:, :, None] + psi
                top = out.max(1)
                out = top + np.log(np.exp(out - top[:, None, :]).sum(1))
                new = 0.5 * sent + 0.5 * (out - out.max(1, keepdims=True))
                done, sent = np.abs(new - sent).max() < SETTLED, new
                if done:
                    break
            np.add.at(local, ends[:, 1], sent)
        p = np.exp(local - local.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, weight: np.ndarray | None = None) -> Field:
    """Piecewise training: softmax regression for the tokens (weighted rows), and for each kind of edge how often labels
    meet, against how often each occurs: 0 where a label always meets itself."""
    k, weight = len(KINDS) + 1, np.ones(len(x)) if weight is None else weight
    n = max(1.0, weight.sum())
    w, speed, goal = np.zeros((k, FEATURES)), np.zeros((k, FEATURES)), np.eye(k)[y]
    for _ in range(STEPS if len(x) else 0):
        s = x @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        speed = 0.9 * speed - RATE * (((p / p.sum(1, keepdims=True)) - goal).T @ (x * weight[:, None]) / n + 1e-4 * w)
        w = w + speed
    seen = pairs + pairs.transpose(0, 2, 1) + 0.5
    each = seen.sum(2)
    return Field(w, np.clip(np.log(seen / np.sqrt(each[:, :, None] * each[:, None, :])), -6, 0))


def _sampled(batches):
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            base = base_spans(text)
            spans, rows, forms, shapes, labels = _nodes(text, base)
            if not rows:
                continue
            known = {form: label for form, label in zip(forms, labels) if label}
            y = np.array([known.get(form, 0) for form in forms])
            edges, kinds, hubs = _edges(spans, forms, shapes)
            first = np.zeros(len(y) + hubs, np.int64)  # of a hub: the label of its first member
            first[edges[::-1, 1]] = y[edges[::-1, 0]]
            first[: len(y)] = y
            pairs = np.zeros((3, len(KINDS) + 1, len(KINDS) + 1), np.int64)
            np.add.at(pairs, (kinds, y[edges[:, 0]], first[edges[:, 1]]), 1)
            # tokens with the same features and label are told by their number
            code = np.array(rows, np.int64) @ (1 << np.arange(FEATURES)) * 8 + y
            found, n = np.unique(code, return_counts=True)
            flat = np.flatnonzero(pairs.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([found, -1 - flat])), pa.array(np.concatenate([n, pairs.reshape(-1)[flat]]))], names=["code", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Learned from the patterns' hits and their repeats. To the driver come counts by distinct features and label (five
    million could occur; a few hundred do); rows that occur n times weigh the root of n."""
    rows = docs.where("text is not null")
    rate = min(1.0, sample / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000)).select(F.col("text").cast("string").alias("text"))
    got = drawn.mapInArrow(_sampled, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").toPandas()
    tokens, pairs = got[got.code >= 0], got[got.code < 0]
    x = (tokens.code.to_numpy()[:, None] // 8 >> np.arange(FEATURES) & 1).astype(float)
    counts = np.zeros(3 * (len(KINDS) + 1) ** 2)
    counts[-1 - pairs.code.to_numpy()] = pairs.n.to_numpy()
    return train(x, tokens.code.to_numpy() % 8, counts.reshape(3, len(KINDS) + 1, len(KINDS) + 1), np.sqrt(tokens.n.to_numpy()))


def all_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """base and the spans that the field adds: runs of tokens that overlap none of base, without the signs around them."""
    spans, rows, forms, shapes, labels = _nodes(text, base)
    if not rows or all(labels):
        return base
    edges, kinds, hubs = _edges(spans, forms, shapes)
    held, times = np.array(labels), Counter(forms)
    # what repeats look like is one piece of evidence, however many there are
    x = np.array(rows, float) / np.array([times[form] for form in forms])[:, None]
    p = _clamped(field, x, edges, kinds, hubs, held)[: len(spans)]
    best = p.argmax(1)
    sure = np.flatnonzero((held == 0) & (best > 0) & (p.max(1) >= SURE))
    return sorted(base + _runs([(*spans[i], int(best[i]) - 1, len(_DIGIT.findall(text[slice(*spans[i])]))) for i in sure]))


def _runs(tokens: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of tokens (start, end, kind, digits), in order: what is written in groups is one number.

    Neighbours of one kind belong together as long as the kind's digits suffice for all; a number of fewer than NUMBER
    digits is a shard and none. Emails and addresses stand for themselves.
    """
    out: list[list[int]] = []
    for start, end, kind, digits in tokens:
        if out and kind in DIGITS and out[-1][1] == kind and 0 <= start - out[-1][2] < 3 and out[-1][3] + digits <= DIGITS[kind]:
            out[-1][2:] = end, out[-1][3] + digits
        else:
            out.append([start, kind, end, digits])
    return [(a, k, b) for a, k, b, digits in out if k not in DIGITS or digits >= NUMBER]


def _clamped(field: Field, x: np.ndarray, edges: np.ndarray, kinds: np.ndarray, hubs: int, held: np.ndarray) -> np.ndarray:
    """Marginals where the patterns' tokens have their label for certain, by one more feature that only they have."""
    k = field.unary.shape[0]
    sure = np.concatenate([np.zeros((1, k - 1)), np.eye(k - 1)]) * 50
    wide = Field(np.concatenate([field.unary, sure], 1), field.pair)
    return wide.marginals(np.concatenate([x, np.eye(k)[held][:, 1:]], 1), edges, kinds, hubs)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row for each row of docs (doc_id, text).

    Counts and hash are of the patterns' spans, spans also has those that the field adds; offsets are code points, ends
    exclusive. Null texts count as empty; texts of any length are read whole; rows that repeat a doc_id are each judged by
    their own text; other columns are left out; no rows, no result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        field, none = shared.value, hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, hashes, spans, added = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                every = all_spans(text, base, field) if base or _SIGN.search(text) else base
                counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
                hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest() if base else none)
                spans.append(_joined(every))
                added.append(len(every) - len(base))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs).select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
