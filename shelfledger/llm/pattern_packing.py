"""Best-fit packing by patterns: token lengths are packed as a histogram, then dealt to the pieces by rank.

The driver sees only the histogram of lengths (at most ``capacity`` entries, whatever the number of documents): few-document
patterns that fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and what is left is packed best fit, longest first.  The plan is a list of runs "the pieces of length L with ranks
r .. r + n go to sequences s .. s + n at offset o"; each piece finds its run by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfledger.llm import textblock as B
from shelfledger.llm.shared import cut

CAPACITY = 1024
END_ID = 2
TEXT_MARK, TEXT_MARK_ID = "<|endoftext|>", 50256  # the vocabulary's one special token; its string in a text gets its id
LONG_BLANKS = 10_000  # a run of so many blanks is left to the library of the JSON file: the rank file's overflows its stack on a million
STEPS = 400  # of the least-squares fit
ROWS_PER_LIST = 50_000


# -- tokens ----------------------------------------------------------------------------------------------------------------

@cache
def _encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={TEXT_MARK: TEXT_MARK_ID})


@cache
def _whole(json_path: str) -> Tokenizer:
    return Tokenizer.from_file(json_path)


_BLANKS = re.compile(rf"(?<!\s)\s{{{LONG_BLANKS}}}")


def encode(text: str, ranks_path: str, pattern: str, json_path: str) -> list[int]:
    """The ids of the JSON file's tokenizer; the rank file holds the same vocabulary."""
    if len(text) >= LONG_BLANKS and _BLANKS.search(text):
        return _whole(json_path).encode(text, add_special_tokens=False).ids
    encoder = _encoder(ranks_path, pattern)
    return encoder.encode(text, allowed_special="all") if TEXT_MARK in text else encoder.encode_ordinary(text)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than ``capacity``."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, json_path: str, row_id: str = "doc_id", text: str = "text",
             capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: row_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A NULL text counts as empty and gives one piece with the end id alone.  Repeated rows are cut alike, once each; an empty table gives no
    piece; other columns, whatever their names, are not read.  A very long text is encoded in one piece of work and cut into many.
    """
    kind = docs.schema[row_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slabs(batches, "text"):
            out = defaultdict(list)
            for row, (key, value) in enumerate(zip(batch["id"].to_pylist(), batch["text"].to_pylist())):
                ids = np.array([*encode(value or "", ranks_path, pattern, json_path), END_ID], "<u4")
                for number, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    part = ids[start:start + length]
                    for name, x in zip(("id", "piece", "start", "length", "crc"), (key, number, start, length, zlib.crc32(part.tobytes()))):
                        out[name].append(x)
                    if keep_ids:
                        out["ids"].append(part.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], batch["id"].type), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                 pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()),
                 *([pa.array(out["ids"], pa.list_(pa.int32()))] if keep_ids else [])],
                ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")
    return (docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(work, schema)
            .withColumnRenamed("id", row_id))


# -- plan ------------------------------------------------------------------------------------------------------------------

def enumerate_patterns(lengths: np.ndarray, capacity: int, slack: int = 0) -> np.ndarray:
    """Patterns of two and three lengths (0 for none) whose total lies between ``capacity - slack`` and ``capacity``."""
    have = np.zeros(capacity + 1, bool)
    have[lengths[lengths < capacity]] = True
    single = np.flatnonzero(have)
    found = []
    for short in range(slack + 1):
        goal = capacity - short
        pair = single[(single * 2 <= goal)]
        pair = pair[have[goal - pair]]
        found.append(np.stack([np.zeros_like(pair), pair, goal - pair], 1))
        a, b = np.meshgrid(single, single, indexing="ij")
        a, b = a.ravel(), b.ravel()
        c = goal - a - b
        good = (a <= b) & (c >= b)
        a, b, c = a[good], b[good], c[good]
        good = have[c]
        found.append(np.stack([a[good], b[good], c[good]], 1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeats x of least squared error |A x - counts|, by projected accelerated gradient; A counts lengths by pattern."""
    if not len(patterns):
        return np.zeros(0)
    flat, size = patterns.ravel(), len(counts)
    weight = np.where(np.arange(size) > 0, 1.0, 0.0)

    def totals(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), size) * weight

    probe = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue of A'A, for the step
        probe = totals(probe)[patterns].sum(1)
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        error = (totals(y) - counts) * weight
        new = np.maximum(0, y - error[patterns].sum(1) / (norm * 1.05))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, offset) and the number of sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    rank = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(rank[length]), n, sequence, offset))
        rank[length] += n
        left[length] -= n

    if left[capacity]:
        n = int(left[capacity])
        place(capacity, n, 0, 0)
        sequences += n
    patterns = enumerate_patterns(np.flatnonzero(left), capacity)
    repeats = np.floor(fit_repeats(patterns, left.astype(float)) + 1e-6).astype(np.int64)
    for which in np.argsort(-repeats, kind="stable"):
        if repeats[which] <= 0:
            break
        parts = [int(p) for p in patterns[which] if p]
        n = int(min(repeats[which], *(left[p] // parts.count(p) for p in parts)))
        if n <= 0:
            continue
        offset = 0
        for p in sorted(parts, reverse=True):
            place(p, n, sequences, offset)
            offset += p
        sequences += n
    # Best fit of the rest, longest first: groups of alike sequences by the room they have left.
    room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room -> (first sequence, count, offset)
    rooms: list[int] = []

    def keep(space: int, first: int, n: int, offset: int) -> None:
        if space:
            if not room[space]:
                heapq.heappush(rooms, space)
            room[space].append((first, n, offset))

    for length in range(capacity, 0, -1):
        while left[length]:
            fitting = min((r for r in room if r >= length and room[r]), default=None)
            if fitting is None:
                n = -(-int(left[length]) // (capacity // length))
                keep(capacity, sequences, n, 0)
                sequences += n
                continue
            first, n, offset = room[fitting].pop()
            used = int(min(n, left[length]))
            place(length, used, first, offset)
            if used < n:
                keep(fitting, first + used, n - used, offset)
            keep(fitting - length, first, used, offset + length)
    return np.array(runs, np.int64).reshape(-1, 5), sequences


# -- dealing ---------------------------------------------------------------------------------------------------------------

def pack(pieces: DataFrame, capacity: int = CAPACITY, row_id: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; an empty table gives an empty table.

    Pieces are numbered inside (list, length) by windows, lists being cut by the row's hash, so that a length that most pieces
    share is not one task's work.
    """
    pieces = cut(pieces.drop("sequence_id", "offset"))
    total = pieces.count()
    lists = max(8, -(-total // ROWS_PER_LIST))
    dealt = pieces.withColumn("_list", F.pmod(F.xxhash64(row_id, "piece", "start"), F.lit(lists)))
    counts = dealt.groupBy("_list", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = plan_runs(histogram, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    before = counts.select("_list", "length", F.expr(
        "coalesce(sum(_n) OVER (PARTITION BY length ORDER BY _list ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before"))
    order = F.expr(f"row_number() OVER (PARTITION BY _list, length ORDER BY `{row_id}`, piece)")
    ranked = dealt.withColumn("_rank", order).join(before, ["_list", "length"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    step = int(total) + 1
    starts = runs[:, 0] * step + runs[:, 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            run = runs[np.searchsorted(starts, length * step + rank, "right") - 1]
            fields = [batch[n] for n in batch.schema.names if n not in ("_list", "_rank", "_before")]
            names = [n for n in batch.schema.names if n not in ("_list", "_rank", "_before")]
            yield pa.RecordBatch.from_arrays([*fields, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                                             [*names, "sequence_id", "offset"])

    ranked = ranked.select(*pieces.columns, "_rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(work, f"{fields}, sequence_id bigint, offset bigint")
