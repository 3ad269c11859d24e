"""MinHash near-duplicates by min-max hashing: each permutation of the shingles gives two signature values, its least and its greatest.

Both agree between two sets with the probability of their Jaccard similarity, and their errors lean against each other, so half the
hash evaluations give a signature of the same length with a smaller variance.  Bands of ``ROWS`` values, minima and maxima apart,
give candidates; every link is confirmed on the full sets (``alike``).  Two sets at 0.8 share no band with probability
(1 - 0.8 ** ROWS) ** (2 * BANDS), three in a million; more alike, less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.llm import alike as A
from shelfledger.llm import textblock as B
from shelfledger.llm.shared import cut

SHINGLE = 2
BOUND = A.Bound(80, 100)
BANDS, ROWS = 16, 5  # permutations: BANDS * ROWS; bands: twice BANDS
_FACTORS = np.random.default_rng(256).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, starts: np.ndarray, factors: np.ndarray = _FACTORS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value of every set under each permutation."""
    for factor in factors:
        mixed = hashes * factor
        mixed ^= mixed >> np.uint64(32)
        mixed *= factor
        yield np.minimum.reduceat(mixed, starts), np.maximum.reduceat(mixed, starts)


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``2 * BANDS`` keys per set that is not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    keys = np.empty((len(starts), 2 * BANDS), np.uint64)
    values = signature(hashes, starts)
    for band in range(BANDS):
        low, high = np.full(len(starts), band, np.uint64), np.full(len(starts), BANDS + band, np.uint64)
        for _ in range(ROWS):
            least, greatest = next(values)
            low, high = B.mix(low + least), B.mix(high + greatest)
        keys[:, band], keys[:, BANDS + band] = low, high
    return keys.view(np.int64)


def sketches(docs: DataFrame, row_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, node, size, keys) of every row; a text without words has no keys."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slabs(batches, "text", 1 << 20):
            hashes, bounds = A.shingle_sets(batch["text"], shingle)
            sizes = np.diff(bounds)
            keys = band_keys(hashes, bounds) if len(hashes) else np.zeros((0, 2 * BANDS), np.int64)
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * 2 * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(A.nodes_of(hashes, bounds)), pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["id", "node", "size", "keys"])

    kind = docs.schema[row_id].dataType.simpleString()
    return (docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
            .mapInArrow(work, f"id {kind}, node bigint, size int, keys array<bigint>"))


def groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bound: A.Bound = BOUND) -> DataFrame:
    """(row_id, n_shingles, component_id) of every row: the size of its shingle set and the smallest id reachable over links.

    A text with fewer words than a shingle is one shingle.  A NULL text, or one without words, has no shingle and is linked with
    nothing, so its component is its own id.  Repeated rows and rows with the same id share what they link to; ties don't arise, since
    the smallest id names a component.  A NULL id is never the smallest, and a component of NULL ids alone has a NULL component.  An empty
    table gives an empty table; other columns, whatever their names, are not read.  A text is one set in one task, so a very long one
    takes memory in proportion to its words.
    """
    marked = cut(sketches(docs, row_id, text, shingle))
    nodes = marked.filter("size > 0").groupBy("node").agg(F.min("id").alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    members = A.band_members(nodes)
    ids = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("first").alias("id")).distinct()
    sets = cut(A.sets_of(docs, ids, row_id, text, shingle))
    named = A.named_groups(nodes, A.links(members, sets, bound))
    full = marked.filter("size > 0").join(named, "node").select("id", "size", "component_id")
    rows = full.unionByName(marked.filter("size = 0").select("id", "size", F.col("id").alias("component_id")))
    return rows.select(F.col("id").alias(row_id), F.col("size").cast("bigint").alias("n_shingles"), "component_id")
