"""Near copies in the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the sets, searched through vantage-point shards, propose the closest pairs; at 0.8 fingerprints differ by 13
bits or so, too far for them, so min-max bands propose the rest.  Every link is checked on the sets (``alike``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfledger.llm import alike as A
from shelfledger.llm import textblock as B
from shelfledger.llm import vp_simhash
from shelfledger.llm.minmax_hash import BANDS, band_keys
from shelfledger.llm.shared import cut, free_name

SHINGLE = 5
BOUND = A.Bound(8, 10)


def sketches(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, node, size, fp, keys) of every row; a text without words has fingerprint 0 and no keys."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slabs(batches, "text", 1 << 20):
            hashes, bounds = A.shingle_sets(batch["text"], SHINGLE)
            sizes = np.diff(bounds)
            keys = band_keys(hashes, bounds) if len(hashes) else np.zeros((0, 2 * BANDS), np.int64)
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * 2 * BANDS)]).astype(np.int32)
            fps = vp_simhash.majority(hashes, np.repeat(np.arange(len(sizes)), sizes), sizes)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(A.nodes_of(hashes, bounds)), pa.array(sizes, pa.int32()), pa.array(fps.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["id", "node", "size", "fp", "keys"])

    kind = docs.schema[row_id].dataType.simpleString()
    return (docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
            .mapInArrow(work, f"id {kind}, node bigint, size int, fp bigint, keys array<bigint>"))


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b) nodes of equal fingerprints, and of fingerprints that the vantage-point search links."""
    leads = cut(nodes.filter("size > 0").groupBy("fp").agg(F.min("node").alias("lead")))
    equal = nodes.join(leads, "fp").filter("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    linked = vp_simhash.links(leads.select("fp"))
    for end in "ab":
        linked = linked.join(leads.select(F.col("fp").alias(end), F.col("lead").alias(f"node_{end}")), end)
    return equal.unionByName(linked.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, component_id): the smallest id reachable over links of alike texts, the row's own included.

    Texts without words are alike.  A NULL id is never the smallest; a component of NULL ids alone has a NULL component.  An empty
    table gives an empty table; a very long text is one set in one task.
    """
    marked = cut(sketches(docs, row_id, text))
    nodes = marked.groupBy("node").agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("size", "fp", "keys")])
    members = A.band_members(nodes)
    proposed = cut(close_fingerprints(nodes.select("node", "size", "fp")))
    asked = members.select("node").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    ids = nodes.join(asked, "node", "left_semi").select(F.col("first").alias("id")).distinct()
    sets = cut(A.sets_of(docs, ids, row_id, text, SHINGLE))
    named = A.named_groups(nodes, A.links(members, sets, BOUND, proposed))
    return marked.select(F.col("id").alias(row_id), "node").join(named, "node").select(row_id, "component_id")


def keep_one(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of smallest id of each group; of rows with the same id, the one of least text (NULL first, then least as JSON) stays.

    Rows with the same id count as one document.  A row with a NULL id stays, since it can't be named by its group.
    """
    found = groups(docs.filter(F.col(row_id).isNotNull()), row_id, text)
    keepers = found.filter(F.col(row_id) == F.col("component_id")).select(row_id).distinct()
    nameless = docs.filter(F.col(row_id).isNull())
    place = free_name(docs, "_place")
    first = Window.partitionBy(row_id).orderBy(text, F.to_json(F.struct(*docs.columns)))
    kept = docs.join(keepers, row_id, "left_semi").withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    return kept.select(docs.columns).unionByName(nameless)
