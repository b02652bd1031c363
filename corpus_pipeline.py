"""The corpus pipeline: language ID, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of `documents`, whatever other columns there are and however they
are named; they may hold nulls. Very long texts are handled whole; every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm import jaccard, langid, packing, pii
from strataquery.llm.common import dense_rank_in, skewed_join, stored


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def boxed(docs: DataFrame, *columns: Column) -> DataFrame:
    """Some columns beside `row`, which holds all those of `docs` but the text: names inside a stage never meet them."""
    return docs.select(*columns, "text", F.struct(F.lit(None).cast("string").alias("text"), *[named(c).alias(c) for c in docs.columns if c != "text"]).alias("row"))


def unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language: null, empty, without a letter, or scoring less than `langid.acceptance` asks for.

    Profiles are learned from three quarters of the labelled rows, the score to ask for from the others. Repeated rows
    fare alike; ties between languages don't matter here."""
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    least = langid.acceptance(docs.where(langid.held_out()), profiles)
    found = langid.predict_languages(boxed(docs), profiles)
    return unboxed(found.where((F.col("lang_pred") != "und") & (F.col("score") > 0) & (F.col("score") >= least)), docs)


def with_digest(docs: DataFrame) -> DataFrame:
    return boxed(docs, F.col("doc_id").cast("long").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: that of the smallest doc_id, then of the smallest text digest.

    Rows with a null doc_id or without words are linked with nothing and stay. Rows of one doc_id with different texts
    are different documents; rows equal in doc_id and text are one, and of those the first in the order of their JSON
    stays."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = stored(ids.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    if again.isEmpty():
        found = jaccard.near_duplicates(ids)
        gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-gone")
        kept = jaccard.only_ids(boxed(docs, F.col("doc_id").cast("long").alias("doc_id")), gone, "left_anti")
        return unboxed(kept, docs)
    # Each (doc_id, text) of a repeated id gets an id of its own below all others.
    rows = with_digest(docs).withColumnRenamed("id", "doc_id")
    twice = jaccard.only_ids(rows, again)
    pairs = twice.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")).withColumn("g", F.lit(0))
    least = ids.agg(F.min("doc_id")).first()[0]
    pairs = stored(dense_rank_in(pairs, "g", ["doc_id", "digest"], "at").select("doc_id", "digest", "copies", (F.lit(least) - 1 - F.col("at")).alias("own")), "pipeline-pairs")
    total = pairs.agg(F.sum("copies")).first()[0]
    told = skewed_join(stored(twice.select("doc_id", "digest", "text"), "pipeline-twice"), pairs, ["doc_id", "digest"], "copies", total)
    once = told.groupBy("own").agg(F.first("text").alias("text")).select(F.col("own").alias("doc_id"), "text")
    single = jaccard.only_ids(ids, again, "left_anti")
    found = stored(jaccard.near_duplicates(single.unionByName(once)).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("own"), "component_id"), "pipeline-groups")
    real = found.join(pairs.select("own", F.col("doc_id").alias("real"), "digest"), "own", "left").select("own", "component_id", F.struct(F.coalesce("real", "own").alias("real"), F.coalesce("digest", F.lit("")).alias("digest")).alias("who"))
    best = real.groupBy("component_id").agg(F.min("who").alias("best"))
    lost = stored(real.join(best, "component_id").where("who <> best").select("own"), "pipeline-lost")
    gone = stored(lost.where(F.col("own") >= least).select(F.col("own").alias("doc_id")), "pipeline-gone")
    stay = jaccard.only_ids(jaccard.only_ids(rows, again, "left_anti"), gone, "left_anti")
    held = stored(pairs.join(lost, "own", "left_anti"), "pipeline-held")
    some = skewed_join(stored(twice, "pipeline-rows"), held, ["doc_id", "digest"], "copies", total)
    one = some.groupBy("doc_id", "digest").agg(F.min_by(F.struct("text", "row"), F.to_json("row")).alias("r")).select("r.text", "r.row")
    return unboxed(stay.select("text", "row").unionByName(one), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what discloses it; n_chars, where there is one, follows the text. No row goes; null and
    empty texts stay as they are, and repeated rows fare alike."""
    clean = pii.sanitise(docs)
    return clean.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else named(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of `packing.pack` over byte lengths: one row for each document, null and empty texts (length 1) and
    repeated rows included; ties go by doc_id."""
    return packing.pack(docs, packing.byte_length())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]
#: Language profiles, components and bucket boundaries have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
