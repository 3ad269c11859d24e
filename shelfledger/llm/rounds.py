"""Questions from chunks of documents to buckets of an index, and the answers back, as grouped Arrow jobs in one plan.

A chunk is a set of documents of bounded bytes; it asks each bucket one list of questions per step, with repeated questions sent
once, so a passage that fills a third of the corpus costs a bucket one entry per chunk.  A bucket answers by position.  All steps
read the same exchange of the documents (Spark reuses it), nothing is kept outside Spark, and a lost task is computed again from
its inputs: chunks are sorted by id, so the order of questions is always the same.  Rows are dealt by id and text, so NULL or repeated ids
spread; only rows that are alike in both share a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.shared import free_name

CHUNK_FLOOR, CHUNK_CEILING, CHUNK_FACTOR = 256 << 10, 8 << 20, 32  # bytes of text in a chunk: factor * sqrt(total), within bounds
BUCKET_CHUNKS = 4  # a bucket indexes the share of so many chunks
ASKED = "bucket int, chunk int, step int, body binary"
ANSWERED = "chunk int, bucket int, step int, body binary"

Ask = Callable[[pa.Table, dict[int, dict[int, bytes]], int], dict[int, bytes]]
Answer = Callable[[list[bytes]], list[bytes]]
Finish = Callable[[pa.Table, dict[int, dict[int, bytes]], int], pa.Table]


@dataclass(frozen=True)
class Step:
    """``ask`` gives the body for each bucket; ``answer`` gives a reply for each body, in the order of the chunks."""

    ask: Ask
    answer: Answer


def chunk_counts(docs: DataFrame, text: str) -> tuple[int, int]:
    total = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    size = min(CHUNK_CEILING, max(CHUNK_FLOOR, int(CHUNK_FACTOR * total ** 0.5)))
    chunks = max(1, -(-total // size))
    return chunks, max(1, -(-chunks // BUCKET_CHUNKS))


def converse(docs: DataFrame, row_id: str, text: str, steps: Sequence[Step], finish: Finish, schema: str) -> DataFrame:
    """``docs`` by chunk through all steps; ``finish`` sees the chunk's rows, sorted by id and text, and all answers."""
    chunks, buckets = chunk_counts(docs, text)
    place = free_name(docs, "_chunk")
    base = docs.withColumn(place, F.pmod(F.xxhash64(row_id, text), F.lit(chunks)).cast("int"))

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([(row_id, "ascending"), (text, "ascending")])

    def sent(step: int, chunk: int, bodies: dict[int, bytes]) -> pa.Table:
        keys = sorted(bodies)
        return pa.table({"bucket": pa.array(keys, pa.int32()), "chunk": pa.array([chunk] * len(keys), pa.int32()),
                         "step": pa.array([step] * len(keys), pa.int32()), "body": pa.array([bodies[k] for k in keys], pa.binary())})

    def heard(table: pa.Table) -> dict[int, dict[int, bytes]]:
        got: dict[int, dict[int, bytes]] = {}
        for step, bucket, body in zip(*(table[n].to_pylist() for n in ("step", "bucket", "body"))):
            got.setdefault(step, {})[bucket] = body
        return got

    def asker(step: int, ask: Ask):
        def work(rows: pa.Table, answers: pa.Table | None = None) -> pa.Table:
            if not rows.num_rows:
                return sent(step, 0, {})
            return sent(step, rows[place][0].as_py(), ask(ordered(rows), heard(answers) if answers is not None else {}, buckets))
        return work if step else lambda rows: work(rows)

    def answerer(step: int, answer: Answer):
        def work(asked: pa.Table) -> pa.Table:
            asked = asked.sort_by("chunk")
            replies = answer(asked["body"].to_pylist())
            return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "step": asked["step"], "body": pa.array(replies, pa.binary())})
        return work

    def closing(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return finish(ordered(rows), heard(answers), buckets)

    answers = None
    for number, step in enumerate(steps):
        if answers is None:
            asked = base.groupBy(place).applyInArrow(asker(number, step.ask), ASKED)
        else:
            asked = base.groupBy(place).cogroup(answers.groupBy("chunk")).applyInArrow(asker(number, step.ask), ASKED)
        new = asked.groupBy("bucket").applyInArrow(answerer(number, step.answer), ANSWERED)
        answers = new if answers is None else answers.unionByName(new)
    return base.groupBy(place).cogroup(answers.groupBy("chunk")).applyInArrow(closing, schema)


# -- buckets and lists in bodies -------------------------------------------------------------------------------------------------------

def spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its upper 32 bits: as many buckets as asked for, up to four billion."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack(*parts: bytes) -> bytes:
    return b"".join([len(p).to_bytes(8, "little") + p for p in parts])


def unpack(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at:at + 8], "little")
        out.append(body[at + 8:at + 8 + n])
        at += 8 + n
    return out


def short(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def long(body: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(body) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions in their order) for each bucket in use."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[part[0]]), part) for part in np.split(order, cuts[1:])] if len(order) else []


def ordinals(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For rows in ``order``, the number of the run of equal keys each belongs to."""
    new = np.zeros(len(order), bool)
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)
