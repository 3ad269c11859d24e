"""Histogram sort: shards of nearly equal bytes from splitters found by counting, then one exchange.

Rows get a 63-bit key (40 bits of the text's hash, 23 bits of the id's hash), so equal texts lie together and a text that fills
a third of the table can still be split.  Each round counts exact bytes in evenly spaced probes around every splitter, on all
partitions at once; at most ``(shards - 1) * probes`` sums reach the driver, whatever the size of the table.  Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfledger.llm.shared import cut, sheltering, text_of

KEY_END = 1 << 63
PROBES = 4096
TOLERANCE = 1000  # a splitter is fixed when at most 1/1000 of a shard's bytes is undecided
ROWS_PER_LIST = 100_000  # rows of one numbered list inside a shard


def sort_key(text: Column, row_id: Column) -> Column:
    head = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 24), 23)
    return head.bitwiseOR(F.shiftrightunsigned(F.xxhash64(row_id), 41))


def find_splitters(sizes: DataFrame, shards: int, probes: int = PROBES, tolerance: int = TOLERANCE) -> list[int]:
    """``shards - 1`` keys; shard ``s`` takes the keys from splitter ``s - 1`` up to, not including, splitter ``s``.

    ``sizes`` has ``key`` and ``size``.  Invariant of each splitter: bytes below ``low`` <= its target < bytes below ``high``.
    """
    total = sizes.agg(F.sum("size").alias("n")).first()["n"] or 0
    targets = {s: total * s // shards for s in range(1, shards)}
    spans = {s: (0, KEY_END, 0) for s in targets}  # low, high, bytes below low
    done = {} if total else dict.fromkeys(targets, KEY_END - 1)
    while len(done) < len(targets):
        open_spans = {s: spans[s] for s in targets if s not in done}
        steps = {s: max(1, -(-(high - low) // probes)) for s, (low, high, _) in open_spans.items()}
        apart: dict[tuple[int, int], list[int]] = {}
        for s, (low, high, _) in open_spans.items():
            apart.setdefault((low, high), []).append(s)
        hits = [F.when((F.col("key") >= low) & (F.col("key") < F.lit(min(high, KEY_END - 1)) if high < KEY_END else F.col("key") >= low),
                       F.struct(F.lit(group[0]).alias("s"),
                                F.floor((F.col("key") - low) / F.lit(1)).cast("bigint").alias("d") if steps[group[0]] == 1 else
                                F.expr(f"(key - {low}L) div {steps[group[0]]}L").alias("d")))
                for (low, high), group in apart.items()]
        found = (sizes.select("size", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("hit"))
                 .groupBy("hit.s", "hit.d").agg(F.sum("size").alias("n")).collect())
        bins: dict[int, list[tuple[int, int]]] = {}
        for row in found:
            bins.setdefault(row["s"], []).append((row["d"], row["n"]))
        for (low, high), group in apart.items():
            counted = sorted(bins.get(group[0], []))
            for s in group:
                below = spans[s][2]
                for d, n in counted:
                    if below + n > targets[s]:
                        break
                    below += n
                start = low + d * steps[group[0]]
                end = min(start + steps[group[0]], high)
                spans[s] = (start, end, below)
                if end - start == 1 or n * tolerance * shards <= total:
                    done[s] = start if targets[s] - below <= below + n - targets[s] else end
    return [min(done[s], KEY_END - 1) for s in sorted(done)]


@sheltering("_key", "_list", "_before", "_n")
def shard(docs: DataFrame, shards: int = 8, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    The size of a row is its text's UTF-8 bytes plus one; a NULL text counts as empty, a NULL id hashes like any other value.
    Rows alike in id and text share a key and so a shard.  Own columns replace input columns of the same name; an empty table
    gives an empty table.
    """
    docs = docs.drop("size", "shard", "slot")
    size = (F.octet_length(text_of(text)) + F.lit(1)).cast("bigint")
    keyed = docs.withColumns({"size": size, "_key": sort_key(text_of(text), F.col(row_id))})
    splitters = find_splitters(cut(keyed.select(F.col("_key").alias("key"), "size")), shards)
    number = F.lit(0)
    for s in splitters:
        number = number + (F.col("_key") >= F.lit(s)).cast("int")
    lists = max(16, -(-keyed.count() // (shards * ROWS_PER_LIST)))
    placed = keyed.withColumns({"shard": number.cast(T.IntegerType()), "_list": F.pmod(F.xxhash64(F.col(row_id), F.col("_key")), F.lit(lists))})
    counts = placed.groupBy("shard", "_list").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_list", F.expr(
        "coalesce(sum(_n) OVER (PARTITION BY shard ORDER BY _list ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _before"))
    order = F.expr(f"row_number() OVER (PARTITION BY shard, _list ORDER BY _key, `{row_id}`)")
    ranked = placed.withColumn("slot", order)
    return (ranked.join(before, ["shard", "_list"]).withColumn("slot", (F.col("slot") - 1 + F.col("_before")).cast("bigint"))
            .drop("_key", "_list", "_before"))
