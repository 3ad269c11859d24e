"""Approximate nearest neighbours over several shifted Hilbert orderings.

Each ordering projects the vectors on a few random directions, shifts the grid, and walks it along a Hilbert curve.  The order is
cut at quantiles of all keys into cells; a query reads its own cell and both neighbours in every ordering, distances are exact, and
the lists of all orderings are merged.  Cells hold a fixed share of the rows; a cell with many rows (copies of one vector may be a
third of them) is dealt into blocks, so that no task holds a whole cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.shared import hash_sample

CURVES, DIMS, BITS = 16, 8, 6
CELLS = 48  # of an ordering; a query reads three of them
LEAST_ROWS = 64  # rows of a cell; fewer rows make fewer cells, down to one
BLOCK_ROWS = 512
SAMPLE = 4096  # rows, about, that the projections' scale is fitted on
QUERY_BLOCK = 256
SEED = 11


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates below ``2**bits`` (one row per point), by Gray-code rotations."""
    axes = [grid[:, i].astype(np.int64) for i in range(grid.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            high = (axis & bit) != 0
            swap = np.where(high, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> level) & 1
    return key


@dataclass
class Orderings:
    """Directions, scale and shift of every curve."""

    centre: np.ndarray
    directions: np.ndarray  # curves x width x dims
    scale: np.ndarray  # curves x dims
    shift: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS) -> Orderings:
        rng = np.random.default_rng(SEED)
        width = sample.shape[1]
        dims = min(dims, width)
        directions = np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims] for _ in range(curves)])
        centre = sample.mean(0)
        spread = np.einsum("nw,cwd->cnd", sample - centre, directions).std(1) * 4
        return cls(centre, directions, np.where(spread > 0, spread, 1), (rng.random((curves, dims)) - 0.5) / 4)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One row of keys per vector."""
        out = []
        for d, s, move in zip(self.directions, self.scale, self.shift):
            place = ((x - self.centre) @ d / s + 0.5 + move) * (1 << BITS)
            out.append(hilbert_key(np.clip(place, 0, (1 << BITS) - 1).astype(np.int64), BITS))
        return np.stack(out, 1)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has only finite components and is not all zero, as doubles."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return rows.withColumn("_x", x).filter(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest_in_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, distance) of each query's ``k`` nearest rows other than itself, ties to the smaller id.

    Squared distances by products choose, with room for their rounding; the kept ones are taken again term by term.
    """
    out: list[tuple[np.ndarray, ...]] = []
    squares = (x * x).sum(1)
    for low in range(0, len(q), QUERY_BLOCK):
        mine, names = q[low:low + QUERY_BLOCK], q_ids[low:low + QUERY_BLOCK]
        rough = (mine * mine).sum(1)[:, None] + squares[None] - 2 * mine @ x.T
        rough[names[:, None] == ids[None]] = np.inf
        if x.shape[0] > k:
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
        else:
            bound = np.full(len(mine), np.finfo(float).max)
        room = 1e-9 * ((mine * mine).sum(1) + squares.max(initial=0))
        who, what = np.nonzero((rough <= (bound + room)[:, None]) & np.isfinite(rough))
        exact = np.sqrt(((mine[who] - x[what]) ** 2).sum(1))
        order = np.lexsort((ids[what], exact, who))
        rank = np.arange(len(order)) - np.searchsorted(who[order], who[order], "left")
        order = order[rank < k]
        out.append((names[who[order]], ids[what[order]], exact[order]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(rows: DataFrame, is_query, k: int = 10, row_id: str = "vec_id", vector: str = "embedding", curves: int = CURVES,
           cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies ``is_query`` (a condition), its ``k`` nearest found rows.

    ``score`` is the Euclidean distance in double precision.  Vectors that are null, zero, hold null or non-finite components, or
    differ in width from most of the sample, take no part, and a row with a NULL id neither.  Copies tie and are ranked by id; a row
    is never its own neighbour.  Rows repeated with id and vector count once; other columns, whatever their names, are not read.  Fewer
    candidates than ``k`` give them all; an empty table gives an empty table.  A cell holds a 48th of the rows, 64 at least, at every size.
    """
    spark = rows.sparkSession
    good = usable(rows, vector).filter(F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("id"), "_x", is_query.alias("asks"))
    sample = [r["_x"] for r in hash_sample(good, "id", SAMPLE).select("_x").collect()]
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not sample:
        return spark.createDataFrame([], result)
    widths = [len(v) for v in sample]
    width = max(sorted(set(widths)), key=widths.count)
    good = good.filter(F.size("_x") == width)
    orders = Orderings.fit(np.array([v for v in sample if len(v) == width]), curves)

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = orders.keys(_matrix(batch["_x"], width))
            curve = np.tile(np.arange(curves, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(curve), pa.array(keys.ravel())], ["curve", "key"])

    n = good.count()
    cells = max(1, min(cells, n // LEAST_ROWS))
    cuts = [float(i) / cells for i in range(1, cells)] or [0.5]
    edges_by = {r["curve"]: sorted(set(r["edges"])) if cells > 1 else [] for r in
                good.select("_x").mapInArrow(key_rows, "curve int, key bigint").groupBy("curve")
                .agg(F.percentile_approx("key", cuts, 10_000).alias("edges")).collect()}
    edges = [np.array(edges_by[c], np.int64) for c in range(curves)]
    first_cell = np.cumsum([0, *(len(e) + 1 for e in edges)])

    def cell_of(x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, key, "right") for e, key in zip(edges, orders.keys(x).T)], 1) + first_cell[:-1]

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(first_cell[-1], np.int64)
        for batch in batches:
            np.add.at(total, cell_of(_matrix(batch["_x"], width)).ravel(), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "n"])

    counts = np.zeros(first_cell[-1], np.int64)
    for r in good.select("_x").mapInArrow(count_rows, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    blocks = np.maximum(1, -(-counts // BLOCK_ROWS))
    first_block = np.cumsum([0, *blocks])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, asks = _matrix(batch["_x"], width), batch["id"].to_numpy(), batch["asks"].fill_null(False).to_numpy(zero_copy_only=False)
            own = cell_of(x)
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for curve in range(curves):
                cell = own[:, curve]
                at = [first_block[cell] + spread % blocks[cell]]
                row = [np.arange(len(ids))]
                query = [np.zeros(len(ids), bool)]
                for step in (-1, 0, 1):
                    beside = cell + step
                    here = np.flatnonzero(asks & (beside >= first_cell[curve]) & (beside < first_cell[curve + 1]))
                    times = blocks[beside[here]]
                    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at.append(np.repeat(first_block[beside[here]], times) + inner)
                    row.append(np.repeat(here, times))
                    query.append(np.ones(times.sum(), bool))
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(query)), batch["id"].take(take),
                                                  batch["_x"].take(take)], ["block", "asks", "id", "x"])

    def rerank(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        ids, x = group["id"].to_numpy(), _matrix(group["x"].combine_chunks(), width)
        if not asks.any() or asks.all():
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v, s = nearest_in_block(ids[asks], x[asks], ids[~asks], x[~asks], k)
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    found = (good.mapInArrow(dealt, "block bigint, asks boolean, id bigint, x array<double>").groupBy("block")
             .applyInArrow(rerank, "query_id bigint, vec_id bigint, score double").distinct())
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
