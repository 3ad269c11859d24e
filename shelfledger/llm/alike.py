"""Links between sets of hashes whose Jaccard similarity reaches a bound, for candidates that share a band key.

No list of candidates is paired with itself.  First every set of a band is checked against the band's smallest node, which joins tight
groups at the cost of their size.  What shares a band with another group after that goes through an exact prefix filter: shingles are
put in one fixed order, rarest first by a count sketch of fixed size; two sets at the bound share a shingle among the first
``size - ceil(bound * size) + 1`` of each, and from its place in both sets their overlap is bounded from above.  Each posting list is
checked against its most central set (the one with the fewest rarer shingles), and then the pairs that are still in different groups
and whose bound on the overlap suffices are checked.  Long lists are dealt into blocks, so no task holds a whole list.

Shingles are compared as 64-bit hashes.  Two large groups whose centres lie barely below the bound remain the costly case: all their
cross pairs that pass the bound on the overlap are checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.llm import textblock as B
from shelfledger.llm.shared import cut
from shelfledger.llm.vp_simhash import components

SLOT_BITS = 18  # counters of the sketch; its size is fixed, and only the order of shingles depends on it, never the result
LIST = 1 << 16  # entries of a posting list that one block holds
SMALL = 128  # lists up to this size are compared row by row
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Bound:
    """Similar from ``alike / of`` on."""

    alike: int = 8
    of: int = 10

    def same_size(self, a: str, b: str) -> str:
        return f"least({a}, {b}) * {self.of} >= greatest({a}, {b}) * {self.alike}"

    def overlap(self, reach_a: str, reach_b: str, a: str, b: str) -> str:
        """Whether sets of sizes ``a`` and ``b`` that share at most the lesser reach can be alike."""
        return f"least({reach_a}, {reach_b}) * {self.of + self.alike} >= ({a} + {b}) * {self.alike}"

    def alike_sets(self, a: bytes, b: bytes) -> bool:
        """Whether two sets (sorted 64-bit hashes) reach the bound."""
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = np.sort(np.concatenate([x, y]), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return self.of * common >= self.alike * (len(both) - common)

    def prefix(self, size: int) -> int:
        return size + self.alike * size // -self.of + 1


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of all texts (A-Z lower-cased), one after the other, and their bounds; a text with fewer words
    than a shingle is one shingle, a text without words has none."""
    block, bounds = B.utf8(column)
    starts, ends, first = B.words(block, bounds)
    counts = np.diff(first)
    number = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + first[owner]
    word = B.range_hashes(B.BYTE_VALUE[_LOWER[block]], starts, ends)
    hashes = B.range_hashes(word, at, np.minimum(at + shingle, first[owner + 1]))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def nodes_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit digest per set."""
    return B.range_hashes(hashes, bounds[:-1], bounds[1:]).view(np.int64)


def sets_of(docs: DataFrame, ids: DataFrame, row_id: str, text: str, shingle: int) -> DataFrame:
    """(node, set) of the rows whose id is in ``ids`` (column ``id``, NULL included), one for each node."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slabs(batches, "text", 1 << 20):
            hashes, bounds = shingle_sets(batch["text"], shingle)
            parts = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of(hashes, bounds)), pa.array(parts, pa.binary())], ["node", "set"])

    rows = docs.select(F.col(row_id).alias("_row"), F.col(text).alias("text"))
    rows = rows.join(ids, rows["_row"].eqNullSafe(ids["id"]), "left_semi").select("text")
    return rows.mapInArrow(work, "node bigint, set binary").groupBy("node").agg(F.min("set").alias("set"))


def checked(pairs: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [bound.alike_sets(x.as_py(), y.as_py()) for x, y in zip(batch["set_a"], batch["set_b"])]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(n), F.col("set").alias(f"set_{n}")) for n in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(work, "a bigint, b bigint")


# -- the prefix filter -----------------------------------------------------------------------------------------------------

def slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold the shingles of each slot: ``2 ** SLOT_BITS`` numbers, whatever the input."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for value in batch["set"]:
                total += np.bincount(slots(np.frombuffer(value.as_py(), np.uint64)), minlength=len(total)) if len(value.as_py()) > 1 << 18 else 0
            tokens = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(v, np.uint64) for v in batch["set"].to_pylist() if len(v) <= 1 << 18]])
            total += np.bincount(slots(tokens), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    table = sets.select("set").mapInArrow(work, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[table["slot"].to_numpy()] = table["n"].to_numpy()
    return out


def postings(sets: DataFrame, counts: np.ndarray, bound: Bound) -> DataFrame:
    """(tok, node, size, reach) of the prefix of each set; ``reach`` is how many of its shingles come at or after this one."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, toks, sizes, reaches = [], [], [], []
            for node, value in zip(batch["node"].to_numpy(), batch["set"].to_pylist()):
                tokens = np.frombuffer(value, np.uint64)
                n = bound.prefix(len(tokens))
                toks.append(tokens[np.lexsort((tokens, counts[slots(tokens)]))[:n]])
                names.append(np.full(n, node))
                sizes.append(np.full(n, len(tokens), np.int32))
                reaches.append(len(tokens) - np.arange(n, dtype=np.int32))
            if toks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(names)),
                                                  pa.array(np.concatenate(sizes)), pa.array(np.concatenate(reaches))], ["tok", "node", "size", "reach"])

    return sets.filter(F.length("set") > 0).select("node", "set").mapInArrow(work, "tok bigint, node bigint, size int, reach int")


def mixed_lists(entries: DataFrame) -> DataFrame:
    """``entries`` of the lists that hold two groups, each with its list's count and lead (the entry with the fewest rarer shingles)."""
    lists = (entries.groupBy("tok").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("n"),
                                        F.min(F.struct((F.col("size") - F.col("reach")).alias("place"), "node", "size", "reach", "root")).alias("lead"))
             .filter("_low < _high").drop("_low", "_high"))
    return entries.join(lists, "tok")


class Lists:
    """Posting lists in rows sorted by list, home rows before guests."""

    names = ["tok", "part", "guest", "node", "size", "reach", "root"]

    def __init__(self, columns: list[np.ndarray]):
        self.tok, self.part, self.guest, self.node, self.size, self.reach, self.root = self.columns = columns

    def rows(self, at) -> Lists:
        return Lists([c[at] for c in self.columns])

    def starts(self) -> np.ndarray:
        new = np.ones(len(self.tok), bool)
        new[1:] = (self.tok[1:] != self.tok[:-1]) | (self.part[1:] != self.part[:-1])
        return np.flatnonzero(new)

    def fit(self, i: np.ndarray, j: np.ndarray, bound: Bound) -> np.ndarray:
        return ((self.root[i] != self.root[j]) & (self.node[i] != self.node[j])
                & (np.minimum(self.reach[i], self.reach[j]) * (bound.of + bound.alike) >= (self.size[i] + self.size[j]) * bound.alike))

    def pairs(self, bound: Bound) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different groups that can be alike by size and reach."""
        start = self.starts()
        sizes = np.diff(np.append(start, len(self.tok)))
        number = np.repeat(np.arange(len(start)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        for step in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            i = np.flatnonzero((number[step:] == number[:-step]) & small[step:])
            i = i[self.fit(i, i + step, bound)]
            yield self.node[i], self.node[i + step]
        for a, n in zip(start[sizes > SMALL], sizes[sizes > SMALL]):
            here = self.rows(slice(a, a + n))
            home = here.rows(~here.guest)
            _, group, counts = np.unique(home.root, return_inverse=True, return_counts=True)
            yield from home.across(home.rows(group != counts.argmax()), bound)  # the largest group never meets itself
            yield from home.across(here.rows(here.guest), bound)

    def across(self, others: Lists, bound: Bound) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of ``others`` with the rows at hand; rows sorted by size bound each window from both sides."""
        mine = self.rows(np.argsort(self.size, kind="stable"))
        low = np.searchsorted(mine.size * bound.of, others.size * bound.alike, "left")
        high = np.searchsorted(mine.size * bound.alike, others.reach * (bound.of + bound.alike) - others.size * bound.alike, "right")
        width = np.maximum(0, high - low)
        cuts = np.flatnonzero(np.diff((np.cumsum(width) - width) // (1 << 20), prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(width)]):
            w = width[a:b]
            who = np.repeat(np.arange(a, b), w)
            what = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + low[who]
            good = ((mine.root[what] != others.root[who]) & (mine.node[what] != others.node[who])
                    & (np.minimum(mine.reach[what], others.reach[who]) * (bound.of + bound.alike) >= (mine.size[what] + others.size[who]) * bound.alike))
            yield mine.node[what[good]], others.node[who[good]]


def close_pairs(entries: DataFrame, bound: Bound) -> DataFrame:
    """Different pairs (a, b) of one list that are in different groups and can be alike.

    A list of more than ``LIST`` entries is dealt into blocks by node; only entries outside the group of the list's lead visit the
    other blocks, and they are read there as a stream.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.dtype([("a", np.int64), ("b", np.int64)]))
            for x, y in found:
                new = np.empty(len(x), seen.dtype)
                new["a"], new["b"] = np.minimum(x, y), np.maximum(x, y)
                seen = np.unique(np.concatenate([seen, new])) if len(new) else seen
                if len(seen) > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(seen["a"]), pa.array(seen["b"])], ["a", "b"])
                    seen = seen[:0]
            yield pa.RecordBatch.from_arrays([pa.array(seen["a"]), pa.array(seen["b"])], ["a", "b"])

        held = None
        for batch in batches:
            columns = [batch[n].to_numpy(zero_copy_only=False) for n in Lists.names]
            columns = [c.astype(np.int64) if c.dtype == np.int32 else c for c in columns]
            now = Lists(columns if held is None else [np.concatenate(c) for c in zip(held.columns, columns)])
            if not len(now.tok):
                continue
            last = now.starts()[-1]
            if last:
                yield from out(now.rows(slice(0, last)).pairs(bound))
            open_ = now.rows(slice(last, None))
            held = open_.rows(~open_.guest)
            if open_.guest.any():  # all home rows of this list are here
                yield from out(held.across(open_.rows(open_.guest), bound))
        if held is not None:
            yield from out(held.pairs(bound))

    home = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = (entries.withColumn("parts", F.ceil(F.col("n") / LIST).cast("int")).withColumn("home", home)
             .withColumn("part", F.explode(F.when((F.col("parts") > 1) & (F.col("root") != F.col("lead.root")), F.sequence(F.lit(0), F.col("parts") - 1))
                                           .otherwise(F.array("home"))))
             .select("tok", "part", (F.col("part") != F.col("home")).alias("guest"), "node", "size", "reach", "root"))
    return dealt.repartition("tok", "part").sortWithinPartitions("tok", "part", "guest").mapInArrow(work, "a bigint, b bigint").distinct()


# -- all together ----------------------------------------------------------------------------------------------------------

def band_members(nodes: DataFrame) -> DataFrame:
    """(key, node, size, lead) of every band key that two nodes or more of ``nodes`` (node, size, keys) share."""
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last")
    return cut(keyed.join(shared, "key").select("key", "node", "size", "lead"))


def star_pairs(members: DataFrame, bound: Bound) -> DataFrame:
    """(a, b): each node with the lead of each of its keys, unless their sizes tell them apart."""
    leads = members.filter("lead = node").select(F.col("node").alias("a"), F.col("size").alias("a_size")).distinct()
    return (members.filter("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("size").alias("b_size")).distinct()
            .join(leads, "a").filter(bound.same_size("a_size", "b_size")).select("a", "b"))


def links(members: DataFrame, sets: DataFrame, bound: Bound, proposed: DataFrame | None = None) -> DataFrame:
    """Checked links (a, b) that join all alike nodes sharing a key of ``members``; ``sets`` holds their sets.

    ``proposed`` pairs from another search are checked with the first ones.
    """
    stars = star_pairs(members, bound)
    first = stars if proposed is None else stars.unionByName(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    near = cut(checked(first, sets, bound))
    placed = members.join(components(near), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("key")
    rooted = cut(placed.join(mixed, "key", "left_semi").select("node", "root").distinct())
    if rooted.isEmpty():
        return near
    open_sets = cut(sets.join(rooted, "node", "left_semi"))
    entries = cut(mixed_lists(postings(open_sets, shingle_counts(open_sets), bound).join(rooted, "node"))
                  .select("tok", "node", "size", "reach", "root", "lead"))
    central = (entries.filter("root <> lead.root")
               .filter(bound.overlap("reach", "lead.reach", "size", "lead.size"))
               .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
               .join(first, ["a", "b"], "left_anti"))
    tested = cut(central)
    near = cut(near.unionByName(checked(tested, sets, bound)))
    again = entries.drop("lead", "root").join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = close_pairs(mixed_lists(again), bound).join(reduce(DataFrame.unionByName, [first.select("a", "b"), tested]), ["a", "b"], "left_anti")
    return near.unionByName(checked(rest, sets, bound))


def named_groups(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, component_id) of ``nodes`` (node, first): the least ``first`` of the nodes reachable over ``linked``."""
    rooted = nodes.select("node", "first").join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(best, "root").select("node", "component_id")
