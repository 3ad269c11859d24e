"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Base matches (strict patterns with their checks) always stay.  Wide patterns propose further, overlapping spans; a gradient-boosted
ensemble scores each by its shape and the text around it, and a span is added when its score reaches the threshold of its kind.
The ensemble is fitted on all documents, on candidates like those it will score: none overlaps a base match.
Positive are base matches written again, where they stand, in forms that the base patterns miss; negative are the other candidates.
Candidates become counted rows of bins; each level of a tree is chosen by histograms that the tasks sum over their own rows.
Thresholds are calibrated on the third of the documents that the fit leaves out, so that at least ``PRECISION`` of what passes is confirmed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm import textblock as B

KINDS = ("email", "ip", "card", "phone")
DRIVER_ROWS = 20_000  # different rows of bins that are fitted in one place; more stay with the tasks, with the same result
KEEP_TREES = 10  # trees after which the blocks' scores are kept anew
SCALE, GRID = 2.0 ** 20, 2.0 ** 16  # gradients are summed, and scores compared, as whole numbers: no sum depends on its order
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
PRECISION = 0.98
LEAST_CONFIRMED = 20  # confirmed candidates above a threshold before it may be used
AROUND = 24  # characters of context on each side
NEARBY = 300  # characters kept on each side of a rewritten span, more than a candidate can take
MOST_DISTANCE = 255  # largest part of an address

# -- base ------------------------------------------------------------------------------------------------------------------
# Each search tries a match where the one before ended and then only at the start of a run of the leading class: no other start
# in a run can do what the first can't, so long runs are read once.

# The base patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"{_LOCAL}++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_CARD = r"[0-9]([\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_HERE = {"email": re.compile(_EMAIL), "ip": re.compile(_IP)}
_NEXT = {"email": re.compile(f"(?<!{_LOCAL}){_EMAIL}"), "ip": re.compile(f"(?<![0-9]){_IP}")}
_PLAIN = {"card": re.compile(_CARD), "phone": re.compile(_PHONE)}
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def confirmed(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part) <= 3 and int(part) <= MOST_DISTANCE for part in (p.lstrip("0") or "0" for p in found.split(".")))
    digits = "".join(_DIGIT.findall(found))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _runs(text: str, kind: str) -> Iterator[tuple[int, int]]:
    at = 0
    while (m := _HERE[kind].match(text, at) or _NEXT[kind].search(text, at)):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind that pass their check, by start and then by kind."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _runs(text, "email")]
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in _runs(text, "ip") if confirmed("ip", text[a:b])]
        for order, kind in ((2, "card"), (3, "phone")):
            found += [(m.start(), order, m.end()) for m in _PLAIN[kind].finditer(text) if confirmed(kind, m.group())]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


# -- candidates ------------------------------------------------------------------------------------------------------------

# Wide patterns of the generators, and words that announce a kind.
_WIDE = {
    "email": re.compile(r"(?<![^\s<>()\[\]{},;:\"'])[^\s<>()\[\]{},;:\"'@]{1,64}+(?:@|\s?[\[(](?:at|AT)[\])]\s?)[^\s<>()\[\]{},;:\"'@]{1,190}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,4}(?:[.,-][0-9]{1,4}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+|00|\()?[0-9][0-9 ()./-]{6,20}[0-9](?![0-9])"),
}
_HINTS = {
    "email": ("mail", "contact", "write", "correo", "e-mail"),
    "ip": ("ip", "host", "server", "address", "ping"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "dial"),
}
FEATURES = 22


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of wide matches, overlapping across kinds."""
    out = []
    if "@" in text or "(at" in text or "[at" in text or "[AT" in text or "(AT" in text:
        out += [(*m.span(), 0) for m in _WIDE["email"].finditer(text)]
    if _DIGIT.search(text):
        out += [(*m.span(), k) for k in (1, 2, 3) for m in _WIDE[KINDS[k]].finditer(text)]
    return out


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    """Shape of the span and of its surroundings."""
    span = text[start:end]
    before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
    n = len(span)
    digits = sum(c.isdigit() for c in span)
    groups = re.split(r"[^0-9A-Za-z]+", span)
    sizes = [len(g) for g in groups if g]
    tail = span.rpartition("@")[2]
    low = before.lower()
    return [kind, n, digits, digits / n, sum(c.isalpha() for c in span) / n, len(sizes), max(sizes, default=0), min(sizes, default=0),
            span.count("."), span.count("-"), span.count(" "), span.count(":"), float(span[0] == "+"), float("(" in span),
            span.count("@"), float("." in tail), len(tail.rpartition(".")[2]), len(set(span)) / n,
            float(not before or before[-1].isspace()), float(not after or not after[0].isalnum()),
            float(any(h in low for h in _HINTS[KINDS[kind]])), float(any(c.isdigit() for c in after[:2]))]


# -- boosted trees ---------------------------------------------------------------------------------------------------------

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]  # feature, bin, value by node
Sums = Callable[[Tree, int], np.ndarray]


@dataclass
class Trees:
    """Depth-limited regression trees on binned features, fitted to the logistic loss."""

    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-raised(np.full(len(x), self.start), self.bins(x), self.trees)))


def nodes_at(b: np.ndarray, tree: Tree, level: int) -> np.ndarray:
    """The node that each row has reached after ``level`` questions."""
    feature, cut, _ = tree
    node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for _ in range(level):
        f = feature[node]
        node = np.where(f < 0, node, np.where(b[rows, np.maximum(f, 0)] <= cut[node], 2 * node + 1, 2 * node + 2))
    return node


def raised(score: np.ndarray, b: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        score = score + tree[2][nodes_at(b, tree, DEPTH)]
    return score


def level_sums(b: np.ndarray, y: np.ndarray, n: np.ndarray, score: np.ndarray, tree: Tree, level: int) -> np.ndarray:
    """(node of the level, feature, bin, 3): how many rows, and their whole-number gradients of first and second order."""
    p, first = 1 / (1 + np.exp(-score)), 2 ** level - 1
    node = nodes_at(b, tree, level) - first
    live = node >= 0
    at, b, n, p, y = node[live] * (BINS + 1), b[live], n[live], p[live], y[live]
    each = (n, np.rint((y - p) * SCALE) * n, np.rint(p * (1 - p) * SCALE) * n)
    shape = (first + 1, BINS + 1)
    return np.stack([np.stack([np.bincount(at + b[:, j], v, shape[0] * shape[1]).reshape(shape) for v in each], -1) for j in range(b.shape[1])], 1)


def grow(sums: Sums) -> Tree:
    size = 2 ** (DEPTH + 1) - 1
    feature, cut, value = tree = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
    for level in range(DEPTH):
        for k, found in enumerate(sums(tree, level), 2 ** level - 1):
            n, (g, h) = found[0, :, 0].sum(), found[0, :, 1:].sum(0) / SCALE
            if not k:
                value[k] = RATE * g / (h + 1)
            if n < 10:
                continue
            left_g, left_h = np.moveaxis(found[:, :, 1:].cumsum(1)[:, :-1] / SCALE, -1, 0)
            gain = left_g ** 2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g ** 2 / (h + 1)
            j, at = np.unravel_index(gain.argmax(), gain.shape)
            if gain[j, at] > 1e-6:
                feature[k], cut[k] = j, at
                value[2 * k + 1] = RATE * left_g[j, at] / (left_h[j, at] + 1)
                value[2 * k + 2] = RATE * (g - left_g[j, at]) / (h - left_h[j, at] + 1)
    return tree


def quantile_edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Different inner quantiles of values that come ``counts`` times each, between neighbours in proportion."""
    order = np.argsort(values)
    values, ends = values[order], np.cumsum(counts[order])
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (ends[-1] - 1)
    low = np.floor(at)
    below, above = (values[np.minimum(np.searchsorted(ends, i, "right"), len(values) - 1)] for i in (low, low + 1))
    return np.unique(below + (above - below) * (at - low))


@dataclass
class Model:
    trees: Trees | None = None
    thresholds: dict[int, float] = field(default_factory=dict)  # kinds that have none add nothing


def rewritten(kind: str, found: str) -> list[str]:
    """A base match in forms of its kind that the base patterns miss."""
    if kind == "email":
        local, _, host = found.partition("@")
        return [f"{local} [at] {host}", f"{local}(at){host}", f"{local}é@{host}"]
    if kind == "ip":
        parts = [int(p) for p in found.split(".")]
        return ["-".join(map(str, parts)), "2001:db8:" + ":".join(f"{p:x}" for p in (*parts, parts[0] ^ parts[2], parts[1] ^ parts[3]))]
    digits = "".join(_DIGIT.findall(found))
    if kind == "card":
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), "  ".join(fours)]
    return [re.sub(r"^\+[0-9]+[\x20.-]*(?=[(0-9])", "", found) if re.match(r"\+[0-9]{1,3}[^0-9]", found) else f"0{digits[2:]}", f"00{found[1:]}"]


def free_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span: what the trees are fitted on and what they score."""
    taken = sorted((a, b) for a, b, _ in base)
    starts, ends = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    out = []
    for a, b, k in candidates(text):
        at = bisect_left(starts, b)
        if not (at and ends[at - 1] > a):
            out.append((a, b, k))
    return out


def labelled(text: str) -> list[list[float]]:
    """Features and label of each candidate that overlaps no base span: 0 in the text itself; with a base span rewritten, 1 if it
    covers the new form and is of its kind, 0 if it only touches it or is of another kind."""
    base = base_spans(text)
    out = [[*features(text, a, b, k), 0.0] for a, b, k in free_candidates(text, base)]
    for start, end, kind in base:
        before, after = text[max(0, start - NEARBY):start], text[end:end + NEARBY]
        for form in rewritten(kind, text[start:end]):
            new, low, high = before + form + after, len(before), len(before) + len(form)
            out += [[*features(new, a, b, k), float(KINDS[k] == kind and a <= low and b >= high)]
                    for a, b, k in free_candidates(new, base_spans(new)) if a < high and b > low]
    return out


def on_grid(score: np.ndarray) -> np.ndarray:
    return np.floor(score * GRID) / GRID


def calibrate(kind: np.ndarray, score: np.ndarray, hits: np.ndarray, n: np.ndarray) -> dict[int, float]:
    """For each kind the lowest score above which at least ``PRECISION`` of the candidates are confirmed, if enough are.

    A row stands for ``n`` candidates of which ``hits`` are confirmed.
    """
    out = {}
    for k in range(len(KINDS)):
        order = np.argsort(-score[kind == k], kind="stable")
        s, right, seen = score[kind == k][order], np.cumsum(hits[kind == k][order]), np.cumsum(n[kind == k][order])
        good = np.flatnonzero((right / np.maximum(seen, 1) >= PRECISION) & (right >= LEAST_CONFIRMED) & (np.append(s[1:], -1) < s))
        if len(good):
            out[k] = float(s[good[-1]])
    return out


def first_score(fit: dict[float, int], held: dict[float, int]) -> float | None:
    """The log-odds of the label, from candidates per label; None where there are too few of one label to fit."""
    ones, total = fit.get(1.0, 0), sum(fit.values())
    if total + sum(held.values()) < 60 or not 10 <= ones <= total - 10:
        return None
    rate = float(np.clip(ones / total, 1e-3, 1 - 1e-3))
    return float(np.log(rate / (1 - rate)))


def fit_bins(edges: list[np.ndarray], start: float, b: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray, kind: np.ndarray) -> Model:
    """The model from rows of bins that are all in one place."""
    trees = Trees(edges, start)
    fit, score = (b[~held], y[~held], n[~held]), np.full(int((~held).sum()), start)
    for _ in range(TREES):
        trees.trees.append(grow(lambda tree, level: level_sums(*fit, score, tree, level)))
        score = raised(score, fit[0], trees.trees[-1:])
    last = on_grid(1 / (1 + np.exp(-raised(np.full(int(held.sum()), start), b[held], trees.trees))))
    return Model(trees, calibrate(kind[held], last, (y * n)[held], n[held]))


def fit_model(rows: np.ndarray, held: np.ndarray | None = None) -> Model:
    """``rows``: features and label.  Those in ``held``, else every third, are kept for calibration; too few of one label give no trees."""
    held = np.arange(len(rows)) % 3 == 0 if held is None else held
    x, y = rows[:, :-1], rows[:, -1]
    start = first_score(*(Counter(y[part].tolist()) for part in (~held, held)))
    if start is None:
        return Model()
    edges = [quantile_edges(*np.unique(x[~held, j], return_counts=True)) for j in range(x.shape[1])]
    return fit_bins(edges, start, Trees(edges).bins(x), y, np.ones(len(rows)), held, x[:, 0].astype(int))


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(row, held, n): the different rows of features and label, as bytes, of all texts, and how often each comes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slabs(batches, "text"):
            found: Counter = Counter()
            for value in batch["text"].to_pylist():
                rows = labelled(value or "")
                if rows:  # all rows of a text go to the same part, since its forms of one span are alike
                    held = xxhash.xxh64_intdigest((value or "").encode("utf-8", "replace")) % 3 == 0
                    found.update((np.array(r).tobytes(), held) for r in rows)
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.binary()), pa.array([h for _, h in found], pa.bool_()),
                                              pa.array(list(found.values()), pa.int64())], ["row", "held", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(work, "row binary, held boolean, n bigint")
    return found.groupBy("row", "held").agg(F.sum("n").alias("n"))


def _matrix(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), float).reshape(-1, FEATURES + 1)


def bin_edges(rows: DataFrame) -> list[np.ndarray]:
    """The edges of each feature's bins.  Spans are of bounded length, so a feature has a bounded number of values."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _matrix(batch["row"]), batch["n"].to_numpy()
            for j in range(FEATURES if len(x) else 0):
                values, at = np.unique(x[:, j], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(values), pa.int32()), pa.array(values), pa.array(np.bincount(at, n).astype(np.int64))],
                                                 ["feature", "value", "n"])

    found = rows.filter("NOT held").mapInArrow(work, "feature int, value double, n bigint").groupBy("feature", "value").agg(F.sum("n").alias("n")).toArrow()
    feature, value, n = (found[c].to_numpy() for c in ("feature", "value", "n"))
    return [quantile_edges(value[feature == j], n[feature == j]) for j in range(FEATURES)]


def binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(bins, kind, y, held, n) of ``counted`` rows: different rows of bins."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["row"])
            bins = Trees(edges).bins(x[:, :-1]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(x[:, 0].astype(np.int32)),
                                              pa.array(x[:, -1].astype(np.int32)), batch["held"], batch["n"]], ["bins", "kind", "y", "held", "n"])

    keys = ["bins", "kind", "y", "held"]
    return rows.mapInArrow(work, "bins binary, kind int, y int, held boolean, n bigint").groupBy(*keys).agg(F.sum("n").alias("n"))


def _bins(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FEATURES)


def fit_blocks(rows: DataFrame, edges: list[np.ndarray], start: float) -> Model:
    """The model of ``fit_bins`` from rows that stay with the tasks: each holds blocks with their scores and sums histograms over them;
    a histogram's size is fixed, and the driver adds up one per task."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = [_bins(batch["bins"]), batch["y"].to_numpy().astype(float), batch["n"].to_numpy().astype(float), np.full(len(batch), start)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in body], names)

    names = ["bins", "y", "n", "score"]
    schema = ", ".join(f"{c} binary" for c in names)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for b, *others in zip(*(batch[c].to_pylist() for c in names)):
                yield np.frombuffer(b, np.uint8).reshape(-1, FEATURES), *(np.frombuffer(x, float) for x in others)

    def summed(new: list[Tree], tree: Tree, level: int) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(level_sums(b, y, n, raised(score, b, new), tree, level) for b, y, n, score in opened(batches))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()] if isinstance(total, np.ndarray) else [], pa.binary())], ["sums"])

        found = kept.mapInArrow(work, "sums binary").collect()
        return sum(np.frombuffer(r["sums"], float) for r in found).reshape(2 ** level, FEATURES, BINS + 1, 3)

    def rescored(new: list[Tree]) -> Callable:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, y, n, score in opened(batches):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (b, y, n, raised(score, b, new))], names)
        return work

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _bins(batch["bins"])
            score = on_grid(1 / (1 + np.exp(-raised(np.full(len(b), start), b, trees.trees))))
            yield pa.RecordBatch.from_arrays([batch["kind"], pa.array(score), batch["y"], batch["n"]], ["kind", "score", "y", "n"])

    trees, since = Trees(edges, start), 0
    kept = rows.filter("NOT held").mapInArrow(packed, schema).persist()
    for number in range(TREES):
        if number - since == KEEP_TREES:
            before, kept = kept, kept.mapInArrow(rescored(trees.trees[since:]), schema).persist()
            kept.foreach(lambda row: None)
            before.unpersist()
            since = number
        trees.trees.append(grow(lambda tree, level: summed(trees.trees[since:], tree, level)))
    kept.unpersist()
    scores = rows.filter("held").mapInArrow(judged, "kind int, score double, y int, n bigint").groupBy("kind", "score").agg(
        F.sum(F.col("y") * F.col("n")).alias("hits"), F.sum("n").alias("n")).toArrow()  # at most GRID scores of a kind
    return Model(trees, calibrate(*(scores[c].to_numpy() for c in ("kind", "score", "hits", "n"))))


def train(docs: DataFrame, text: str = "text", most: int = DRIVER_ROWS) -> Model:
    """The model from all texts.  Up to ``most`` different rows of bins are fitted in one place, more where they lie.

    NULL and empty texts give no candidates.  An empty table, or one with few candidates, gives a model that adds nothing to the base.
    """
    rows = counted(docs, text).persist()
    sizes = rows.groupBy("held", F.expr("substring(row, -8, 8)").alias("label")).agg(F.sum("n").alias("n"))
    parts: tuple[dict, dict] = ({}, {})
    for r in sizes.collect():
        parts[r["held"]][float(np.frombuffer(bytes(r["label"]), float)[0])] = r["n"]
    start = first_score(*parts)
    if start is None:
        rows.unpersist()
        return Model()
    edges = bin_edges(rows)
    bins = binned(rows, edges).persist()
    if bins.count() <= most:
        table = bins.toArrow()
        y, n, held, kind = (table[c].to_numpy() for c in ("y", "n", "held", "kind"))
        model = fit_bins(edges, start, _bins(table["bins"]), y.astype(float), n.astype(float), held, kind)
    else:
        model = fit_blocks(bins, edges, start)
    rows.unpersist()
    bins.unpersist()
    return model


# -- search ----------------------------------------------------------------------------------------------------------------

def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base and added spans together.  An added span overlaps no other span of its kind and no base span."""
    base = base_spans(text)
    if not model.thresholds:
        return base, base
    free = [c for c in free_candidates(text, base) if c[2] in model.thresholds]
    if not free:
        return base, base
    scores = model.trees.predict(np.array([features(text, a, b, k) for a, b, k in free], float))
    added, reach = [], {}
    for (a, b, k), score in sorted(zip(free, scores.tolist()), key=lambda c: (c[0][2], c[0][0])):
        if score >= model.thresholds[k] and reach.get(k, -1) <= a:
            added.append((a, b, KINDS[k]))
            reach[k] = b
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, end, kind) in code points, end exclusive, by start and kind.

    A NULL or empty text has no spans; repeated rows are searched alike; input columns named like the new ones are replaced.
    """
    docs = docs.drop("base", "spans")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slabs(batches, text):
            both = [all_spans(value or "", model) for value in batch[text].to_pylist()]
            lists = [[[{"start": a, "end": b, "kind": k} for a, b, k in x[i]] for x in both] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, span) for x in lists]], [*batch.schema.names, "base", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = "array<struct<start:int,end:int,kind:string>>"
    return docs.mapInArrow(work, f"{schema}, base {kind}, spans {kind}")


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``spans`` replaced by its kind in brackets; of overlapping spans the leftmost, then longest, is named."""
    names = docs.columns

    def cover(value: str) -> str:
        _, spans = all_spans(value, model)
        out, at = [], 0
        for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
            if a >= at:
                out += [value[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        return "".join([*out, value[at:]]) if spans else value

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slabs(batches, text):
            new = pa.array([None if v is None else cover(v) for v in batch[text].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == text else batch[n] for n in batch.schema.names], batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    done = docs.mapInArrow(work, schema)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return done.select(names)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
