"""SimHash near-duplicates: exact links between fingerprints through vantage-point shards.

Fingerprints within Hamming distance ``d`` agree on at least one of ``d + 1`` blocks of bits.  In the space of one block the
two have distance 0, so by the triangle bound they have the same distance to every vantage point: the vector of those distances
names a shard, each pair meets in at least one shard, and a shard's boundary needs no overlap.  Of ``d + k`` smaller blocks they agree on
at least ``k``; the more fingerprints there are, the more blocks a shard agrees on, so shards stay small.  Inside a shard a vantage-point
tree on all 64 bits cuts cells ``d + 1`` wide; a cell is compared with itself and the neighbours its boundary overlaps, nothing else.
A shard yields a spanning forest of its links, never all pairs, and components are joined by alternating stars in Spark.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm import textblock as B
from shelfledger.llm.shared import cut

SHINGLE = 4
SEED = 42
DISTANCE = 4
LEVELS = 9  # vantage points of a block; each distance takes five bits of the shard's key
MOST_AGREED = 4  # 70 keys at most; shards of 32 agreed bits
KEY_COST, SPLIT = 20, 0.9  # a key costs as much as so many comparisons; the part of a block's bits that its distances tell apart
SMALL = 128  # shards up to this size are compared directly
TASK_EDGES = 250_000  # edges that one task of the components writes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VANTAGE = np.random.default_rng(64).integers(0, 1 << 64, 96, dtype=np.uint64)


# -- fingerprints ----------------------------------------------------------------------------------------------------------

def fingerprint_block(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """One 64-bit fingerprint per text: a bit is 1 if more than half of the shingles' XXH64 values have it."""
    block, bounds = B.utf8(column)
    starts, ends, first = B.words(block, bounds)
    rows = len(bounds) - 1
    if not len(starts):
        return np.zeros(rows, np.uint64)
    # The words again, lower-cased, each followed by exactly one space.
    sizes = ends - starts
    new_ends = np.cumsum(sizes + 1) - 1
    new_starts = new_ends - sizes
    solid = ~B.BLANK[block]
    joined = np.full(new_ends[-1] + 1, 32, np.uint8)
    joined[np.arange(solid.sum()) + np.repeat(np.arange(len(starts)), sizes)] = _LOWER[block[solid]]
    text = joined.tobytes()
    counts = np.diff(first)
    shingles = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(rows), shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[owner]
    last = np.minimum(at + shingle, first[owner + 1]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(new_starts[at].tolist(), new_ends[last].tolist())), np.uint64, len(at))
    return majority(hashes, owner, shingles)


def majority(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row a fingerprint: a bit is 1 if more than half of the row's ``counts`` hashes have it; ``owner`` is each hash's row, ascending."""
    votes = np.zeros((len(counts), 64), np.int64)
    for low in range(0, len(hashes), 1 << 15):
        part, who = hashes[low:low + (1 << 15)], owner[low:low + (1 << 15)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.diff(who, prepend=-1))
        votes[who[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    won = votes * 2 > counts[:, None]
    return np.packbits(won, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, fp bigint) of every row; a text without words has fingerprint 0."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slabs(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fingerprint_block(batch["text"]).view(np.int64))], ["id", "fp"])

    kind = docs.schema[row_id].dataType.simpleString()
    return (docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(work, f"id {kind}, fp bigint")
            .withColumnRenamed("id", row_id))


# -- links -----------------------------------------------------------------------------------------------------------------

def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def agreed_blocks(rows: int, distance: int = DISTANCE) -> int:
    """How many blocks a shard agrees on, so that the comparisons of a fingerprint stay about the same however many there are.

    Of ``distance + agreed`` blocks two linked fingerprints share at least ``agreed`` whole ones.  More blocks mean more keys for each
    fingerprint, but each has more bits, which splits the shards: the cheapest choice for ``rows`` unrelated fingerprints is taken.
    """
    def cost(agreed: int) -> float:
        bits = agreed * 64 // (distance + agreed)
        return math.comb(distance + agreed, agreed) * (KEY_COST + rows / 2 ** (bits * SPLIT))

    return min(range(1, MOST_AGREED + 1), key=cost)


def shard_keys(fp: Column, distance: int = DISTANCE, agreed: int = 1) -> Column:
    """One key for each choice of ``agreed`` blocks: the choice and the distances of its blocks to their vantage points."""
    blocks = distance + agreed
    edges = [64 * j // blocks for j in range(blocks + 1)]
    places = []
    for j in range(blocks):
        mask = ((1 << edges[j + 1]) - 1) ^ ((1 << edges[j]) - 1)
        place = F.lit(j).cast("bigint")
        for level in range(LEVELS):
            seen = F.lit(_signed(int(_VANTAGE[j * LEVELS + level]) & mask))
            place = F.shiftleft(place, 5) + F.bit_count(fp.bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(seen))
        places.append(place)
    if agreed == 1:
        return F.array(*places)
    return F.array(*[F.xxhash64(F.lit(i), *chosen) for i, chosen in enumerate(itertools.combinations(places, agreed))])


class Forest:
    """Union of small integers; keeps only the links that join two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def tree_links(fps: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest, distance: int, level: int = 0) -> None:
    """Join all pairs of ``left`` x ``right`` (positions in ``fps``) within ``distance``."""
    if level == len(_VANTAGE) or len(left) * len(right) <= 1 << 16 or level >= 12:
        for at in range(0, len(left), 256):
            rows = left[at:at + 256]
            near = np.bitwise_count(fps[rows][:, None] ^ fps[right][None, :]) <= distance
            for i, js in zip(rows.tolist(), near):
                for j in right[js].tolist():
                    forest.join(i, j)
        return
    width = distance + 1
    mine = np.bitwise_count(fps[left] ^ _VANTAGE[level]) // width
    other = np.bitwise_count(fps[right] ^ _VANTAGE[level]) // width
    for cell in np.unique(mine):
        here = left[mine == cell]
        for beside in (int(cell) - 1, int(cell), int(cell) + 1):  # what the cell's boundary overlaps
            there = right[other == beside]
            if len(there) and not (left is right and beside < cell):
                same = left is right and beside == cell
                tree_links(fps, here, here if same else there, forest, distance, level + 1)


def shard_links(fps: np.ndarray, keys: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of every shard in rows sorted by key."""
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cuts, len(keys)))
    forest = Forest(len(fps))
    most = int(sizes[sizes <= SMALL].max(initial=1))
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, most):
        near = (keys[step:] == keys[:-step]) & small[step:] & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= distance)
        for i in np.flatnonzero(near).tolist():
            forest.join(i, i + step)
    for start, size in zip(cuts[sizes > SMALL], sizes[sizes > SMALL]):
        here = np.arange(start, start + size)
        tree_links(fps, here, here, forest, distance)
    pairs = np.array(forest.links, np.int64).reshape(-1, 2)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) links that connect all fingerprints within ``distance`` of each other; ``distinct`` has one row per ``fp``."""
    agreed = agreed_blocks(distinct.count(), distance)
    def emit(fps: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        a, b = shard_links(np.concatenate(fps).view(np.uint64), np.concatenate(keys), distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        for batch in batches:  # sorted by key; the last shard of a batch may go on in the next one
            key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy()
            if not len(key):
                continue
            done = np.searchsorted(key, key[-1])
            if done:
                yield emit([*fps, fp[:done]], [*keys, key[:done]])
                fps, keys = [], []
            fps.append(fp[done:])
            keys.append(key[done:])
        if fps:
            yield emit(fps, keys)

    return (distinct.select("fp", F.explode(shard_keys(F.col("fp"), distance, agreed)).alias("key"))
            .repartition("key").sortWithinPartitions("key").mapInArrow(work, "a bigint, b bigint").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b); alternating large and small stars.

    No node's neighbours are gathered: each star is a map-side minimum joined back to the edges.  Every step is written by as many
    tasks as its edges need, so a small graph leaves few shuffle files.
    """
    both = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows, before = both.count(), None
    while True:
        tasks = 1 + rows // TASK_EDGES
        here = both.coalesce(tasks)
        around = here.unionByName(here.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        moved = large.join(small_least, "u").select("u", F.explode(F.array("v", "u")).alias("w"), F.col("m").alias("v"))
        moved = moved.select(F.when(F.col("w") == F.col("v"), F.col("u")).otherwise(F.col("w")).alias("u"), "v")
        both = cut(moved.filter("u <> v").coalesce(tasks).distinct())
        now = both.coalesce(tasks).agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            here = both.coalesce(tasks)
            return here.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(here.select(F.col("v").alias("node"), F.col("v").alias("root"))).coalesce(tasks).distinct()
        rows, before = now[0], now


def groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(row_id, fp, component_id): the smallest id reachable over links, the row's own included.

    Texts without words have fingerprint 0 and are linked like any other.  Repeated rows share a component.  A NULL id is never
    the smallest; a component of NULL ids alone has a NULL component.  An empty table gives an empty table.
    """
    marked = cut(fingerprints(docs, row_id, text))
    distinct = marked.groupBy("fp").agg(F.min(row_id).alias("_first"))
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(best, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(row_id, "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
