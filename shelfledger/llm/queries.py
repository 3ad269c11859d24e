"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.llm import (checks, hilbert_ann, histogram_sort, minmax_hash, pattern_packing, piece_lattice, pii_boost, ptolemaic_clusters, quality_lines,
                             rlz_dedup, suffix_dedup, trigram_secrets, turn_repair, vp_simhash)
from shelfledger.llm.shared import read_documents, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            CHECKS[name] = sql
        return function
    return add


def _only(kind: str):
    return lambda x: F.when(x == kind, x)


@register("op6_quality_rules", checks.QUALITY)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_lines.judge(read_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


@register("op7_histogram_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    placed = histogram_sort.shard(docs.withColumn("text_crc32", F.crc32(text_of())), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = trigram_secrets.scan(read_documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return scanned.select("doc_id", *counts, F.sha2(trigram_secrets.spans_text(base), 256).alias("base_sha256"),
                          trigram_secrets.spans_text(F.col("spans")).alias("spans"))


VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json: the same ids, several times as fast
WHOLE = "byte_bpe_50k.json"


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = pattern_packing.tokenize(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, public_tokenizers.path(WHOLE))
    return pattern_packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op3_pattern_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_documents(spark, sf_dir))


@register("op9_simhash_groups")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vp_simhash.groups(read_documents(spark, sf_dir))
    return found.select("doc_id", vp_simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


@register("op2_rlz_dedup", checks.WORD_DEDUP)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz_dedup.dedup(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"), F.col("kept_words").alias("text"))


@register("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@register("op5_pii_boost")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    found = pii_boost.find(docs, pii_boost.train(docs)).drop("text")
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("bigint").alias(f"n_{k}") for k in pii_boost.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii_boost.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii_boost.spans_text(F.col("spans")).alias("spans"))


@register("op10_hilbert_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return hilbert_ann.search(rows, F.col("vec_id") % 100 == 0)


@register("op4_piece_lattice")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, a digest of the ids, and whether decoding gives the text back."""
    import public_tokenizers

    model = piece_lattice.Model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = piece_lattice.decode(piece_lattice.encode(read_documents(spark, sf_dir).select("doc_id", "text"), model), model)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.crc32(F.array_join("ids", ",")).alias("ids_crc32"),
                        (F.col("decoded") == text_of()).alias("round_trip"))


@register("op11_minmax_groups", checks.MINMAX_GROUPS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax_hash.groups(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@register("op12_ptolemaic_clusters", checks.CLUSTERS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ptolemaic_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


@register("op13_turn_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repaired = turn_repair.repair(turn_repair.damage(rows))
    found = repaired.figures().join(repaired.digests(), "key")
    whole = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("name")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
