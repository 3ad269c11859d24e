"""Centroid clustering with Ptolemaic pivots: Lloyd rounds whose nearest-centroid search skips centroids by lower bounds.

For a vector x, a centroid c and two pivots p, q, Ptolemy's inequality in Euclidean space gives

    d(x, c) * d(p, q)  >=  | d(x, p) * d(c, q) - d(x, q) * d(c, p) |

so distances to a few fixed pivots, taken once per vector and kept, and those of the few centroids bound every distance from below.
The bound is rounded down by a margin above all floating-point error; a centroid whose bound exceeds the exact distance to the best
one so far cannot be nearest, and what survives is checked in whole numbers.

Vectors become whole numbers first, so every sum, quotient and distance is exact and the result doesn't depend on how Spark deals the
rows.  Rows stay where they were read; a round sends one row of sums per task and centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.shared import cut

WIDTH, SCALE = 64, 64
CLUSTERS, ROUNDS = 16, 3
PIVOTS = 6
SAFE = 1 << 29  # components below this have squared distances of up to 64 terms below 2**63; larger ones are counted in Python's integers


def usable(rows: DataFrame, vector: str, width: int = WIDTH) -> Column:
    """Whether the vector has exactly ``width`` components, none null, infinite or not a number."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) == width) & finite, F.lit(False))


def whole_numbers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: 64-bit integers, or Python's where they don't fit."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) * scale)
    if not len(x) or np.abs(x).max() < SAFE:
        return x.astype(np.int64)
    limit = np.isfinite(x)
    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.array([[int(v) if ok else int(r) * scale for v, ok, r in zip(*z)] for z in zip(x, limit, raw)], object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of matching rows."""
    if x.dtype != object and c.dtype == object:
        x = x.astype(object)
    d = x - c
    return (d * d).sum(-1)


class Pivots:
    """Fixed pivots: the centroids that the search starts from are spread as the data are, so the first of them serve."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(float)
        pairs = [(i, j) for i in range(len(points)) for j in range(i)]
        gap = np.sqrt(((self.points[:, None] - self.points[None]) ** 2).sum(-1))
        self.pairs = [(i, j, gap[i, j]) for i, j in pairs if gap[i, j] > 0]

    def distances(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in self.points], 1)) if len(self.points) else np.zeros((len(x), 0))

    def bounds(self, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances, vectors x centroids, from both sides' pivot distances; rounded down.

        Each distance carries a relative error below 2 ** -40 (64 terms, a root), so a product pair is off by less than 2 ** -38 of
        its size; what is taken off is more than that.
        """
        best = np.zeros((len(mine), len(theirs)))
        for i, j, gap in self.pairs:
            one, two = mine[:, i, None] * theirs[None, :, j], mine[:, j, None] * theirs[None, :, i]
            np.maximum(best, (np.abs(one - two) - (one + two) * 2.0 ** -36) / gap, out=best)
        return np.nan_to_num(best * best * (1 - 2.0 ** -36), nan=0, posinf=0)  # beyond the range of doubles a bound says nothing


def nearest(x: np.ndarray, near_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid number, exact squared distance) of each vector, ties to the smaller number, and how many distances were taken."""
    own = pivots.distances(centroids)
    bound = pivots.bounds(near_pivots, own)
    guess = bound.argmin(1) if bound.size else np.zeros(len(x), np.int64)
    least = squared(x, centroids[guess])
    taken = len(x)
    best = guess.astype(np.int64)
    for number in range(len(centroids)):
        # Doubles next to a whole number may round up, so the bound is compared with one more than the distance.
        at = np.flatnonzero((bound[:, number] <= least.astype(float) * (1 + 2.0 ** -50) + 1) & (guess != number))
        if not len(at):
            continue
        taken += len(at)
        d = squared(x[at], centroids[number][None])
        closer = (d < least[at]) | ((d == least[at]) & (number < best[at]))
        least[at[closer]], best[at[closer]] = d[closer], number
    return best, least, taken


def _seeds(good: DataFrame, row_id: str, clusters: int) -> list[tuple]:
    """The vectors of smallest hash, a list of ``clusters`` rows at most; copies of an id are told apart by their vectors."""
    order = F.sha2(F.concat(F.lit("1:"), F.col(row_id).cast("string")), 256)
    return good.select(order.alias("h"), "_x").orderBy("h", "_x").limit(clusters).collect()


def cluster(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(row_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row whose vector is usable.

    ``clusters`` vectors, those of smallest hash of the id, are the first centroids; a row with a NULL id is clustered, but never a first
    centroid.  Empty clusters keep their centroid.  Ties go to the smaller number; repeated rows count each time.  Fewer vectors than
    ``clusters`` make fewer centroids; an empty table, or one without usable vectors, gives an empty table.  Sums and distances beyond
    64 bits fail loudly when they are written as long.  Other columns, whatever their names, are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema[row_id].dataType.simpleString()
    result = f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    good = rows.filter(usable(rows, vector, width)).select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("_x"))
    seeds = _seeds(good.filter(F.col("id").isNotNull()), "id", clusters)
    if not seeds:
        if good.isEmpty():
            return spark.createDataFrame([], result).withColumnRenamed("id", row_id)
        seeds = _seeds(good.withColumn("id", F.lit("")), "id", clusters)
    first = whole_numbers(pa.array([r["_x"] for r in seeds], pa.list_(pa.float64())), width, scale)
    pivots = Pivots(first[:PIVOTS])

    def with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch["_x"], width, scale)
            near = pivots.distances(x)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["_x"], pa.array(list(near), pa.list_(pa.float64()))], ["id", "x", "near"])

    kept = cut(good.mapInArrow(with_pivots, f"id {kind}, x array<double>, near array<double>"))

    def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return (whole_numbers(batch["x"], width, scale),
                batch["near"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(pivots.points)))

    centroids = first
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(centroids), width), object), np.zeros(len(centroids), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, near = matrices(batch)
                own, _, _ = nearest(x, near, centroids, pivots)
                for c in np.unique(own):
                    total[c] += x[own == c].sum(0)
                    count[c] += int((own == c).sum())
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(count[used]),
                 pa.array([[str(v) for v in total[c]] for c in used], pa.list_(pa.string()))], ["cluster", "n", "total"])

        parts = (kept.mapInArrow(sums, "cluster int, n bigint, total array<string>")
                 .select("cluster", "n", F.posexplode("total").alias("axis", "v"))
                 .groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")))
        moved = centroids.astype(object)
        for r in parts.collect():  # clusters x width numbers
            moved[r["cluster"], r["axis"]] = int(r["v"]) // r["n"]
        centroids = moved.astype(np.int64) if max(abs(v) for v in moved.ravel()) < SAFE else moved
    names = [hashlib.sha256(",".join(str(v) for v in c).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, near = matrices(batch)
            own, least, _ = nearest(x, near, centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(own.astype(np.int32)), pa.array(least.tolist(), pa.int64()),
                                              pa.array([names[c] for c in own], pa.string())], ["id", "cluster", "distance", "centroid_sha256"])

    placed = cut(kept.mapInArrow(assign, f"id {kind}, cluster int, distance bigint, centroid_sha256 string"))
    totals = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of_cluster = F.create_map(*[F.lit(v) for c, s in totals.items() for v in (c, s)]) if totals else F.lit(None)
    return placed.select(F.col("id").alias(row_id), "cluster", "distance", of_cluster[F.col("cluster")].cast("bigint").alias("cluster_inertia"),
                         F.lit(sum(totals.values())).cast("bigint").alias("inertia"), "centroid_sha256")
