"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays in one shard. Groups, sorted by size (all their rows' bytes), go to the
least-loaded shard through a heap. Groups of equal size are alike to the heap, so the driver needs only how many there
are of each size: it places such a run at once, with the very loads that one group at a time would give (`schedule`),
and tells each shard's share of the run; a group's shard follows from its rank among those of its size.

The driver holds the distinct sizes, at most the square root of twice the bytes of the input (their sum is at most
that): 245,000 for 30 GB, 14 million for 100 TB. The plan is broadcast up to `FEW_SIZES` rows and joined by size beyond.

Edge cases: a null text counts as no bytes and shares a group with the empty text; repeated rows are separate rows of
one group; a group larger than a fair share gets a shard to itself as far as the heap allows; a very long text is a
size like any other; an empty table gives an empty result; ties in size go by text digest, ties in load by shard number;
other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.llm.common import FEW, HOT, dense_rank_in, skewed_join, stored
from strataquery.operators.schedule import lpt_plan

#: Rows of the plan that are broadcast: about 100 bytes each.
FEW_SIZES = 500_000


def rank_in_size(groups: DataFrame, runs: DataFrame, total: int) -> DataFrame:
    """Adds `rank` (from 0, by digest) among the groups of one size. A size that very many groups share is cut by hash
    into parts ranked apart; there are fewer than HOT such sizes, and parts follow from counts."""
    limit = max(FEW, total // HOT)
    hot = runs.where(F.col("n_groups") > limit).select("bytes", F.ceil(F.col("n_groups") / limit).alias("parts"))
    dealt = groups.join(F.broadcast(hot), "bytes", "left").withColumn("part", F.pmod(F.xxhash64("digest"), F.coalesce("parts", F.lit(1)))).drop("parts")
    counts = dealt.where("part IS NOT NULL").join(F.broadcast(hot.select("bytes")), "bytes", "left_semi").groupBy("bytes", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bytes", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))  # below 2 x HOT rows
    inside = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("digest")) - 1
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(offsets), ["bytes", "part"], "left")
    return ranked.select("digest", "bytes", "n_rows", (F.col("inside") + F.coalesce("offset", F.lit(0))).alias("rank"))


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for rows (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = stored(docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest")), "sharding")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows")), "sharding-groups")
    runs = stored(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n_groups")), "sharding-runs")
    table = runs.toArrow().sort_by([("bytes", "descending")])
    sizes, counts = table["bytes"].to_pylist(), table["n_groups"].to_pylist()
    ends = lpt_plan(list(zip(sizes, counts, strict=True)), shards)
    plan = spark.createDataFrame(pa.table({"bytes": pa.array(sizes, pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64()))}), "bytes long, ends array<long>")
    ranked = rank_in_size(groups, runs, sum(counts))
    # A group's shard is the number of shares that end at or before its rank.
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int").alias("shard")
    placed = stored(ranked.join(F.broadcast(plan) if len(sizes) <= FEW_SIZES else plan, "bytes").select("digest", "n_rows", shard), "sharding-placed")
    out = skewed_join(rows, placed, ["digest"], "n_rows", rows.count()).select("doc_id", "size", "text_crc32", "shard")
    return dense_rank_in(out, "shard", ["doc_id", "text_crc32", "size"], "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
