"""Sharding by longest processing time: groups of equal texts go, largest first, to the least loaded shard.

Group sizes are summed in Spark. A group of at least 1/1000 of a shard's share is dealt on its own;
there are at most 1000 of those per shard. Smaller groups are hashed into 1000 bundles per shard,
each a small part of a shard's share, and a bundle is dealt as one group. So the heap sees at most
2000 items per shard whatever the number of documents, and no item that is not a whole group or a
bundle of whole groups. Loads then differ by less than the smallest items, unless one group alone
is larger than a shard's share: it stays together, as a group must, and the rest is levelled.

A null text counts as no bytes and shares the group of the empty text. Repeated rows are equal
texts. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import located, materialise, number_within

SHARDS = 24
ROW_BYTES = 8
#: Parts of a shard's share: the size from which a group is dealt alone, and the number of bundles.
PARTS = 1000


def longest_first(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Deals items to shards, largest first (ties by name), each to the least loaded."""
    loads = [(0, shard) for shard in range(shards)]
    out: dict[str, int] = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        out[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the group's key; the only step that reads the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("group"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """One row per document with its shard and its place there."""
    spark = docs.sparkSession
    rows = located(materialise(measured(docs), "measured"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("group"), F.lit(shards * parts)).cast("string"))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    alone = F.col("bytes") * (shards * parts) >= total
    # at most shards * parts groups reach that size, as the sizes of all groups sum to the total
    items = groups.groupBy(F.when(alone, F.col("group")).otherwise(bundle).alias("item")).agg(
        F.sum("bytes").alias("bytes")
    )
    dealt = longest_first([(r["item"], r["bytes"]) for r in items.collect()], shards)
    table = spark.createDataFrame(list(dealt.items()) or [("", 0)], "item string, shard int")
    large = F.broadcast(table.where(~F.col("item").startswith("bundle ")))  # both sides: shards * parts rows at most
    small = F.broadcast(table.where(F.col("item").startswith("bundle ")).select(
        F.col("item").alias("bundle"), F.col("shard").alias("bundle_shard")
    ))
    placed = (
        rows.withColumn("bundle", bundle)
        .join(large, F.col("group") == F.col("item"), "left").join(small, "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("shard", "bundle_shard").alias("shard"), "_run", "_at")
    )
    numbered = number_within(placed, ["shard"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
