"""The model's tables out of the driver's tables: files, lines, postings, symbols, edges and a dependency graph.

Each has a twin CTE in SQL for the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.functions.text import line_terms, short_name, token_estimate
from strataquery.session import table
from strataquery.sources.grams import Grams
from strataquery.sources.postings import Postings
from strataquery.sources.stored import fresh_path


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "doc_id", F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("surface"), token_estimate(text).alias("full_tokens"), text.alias("text"),
    )


def lines(files_: DataFrame) -> DataFrame:
    return files_.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "content")).select("path", (F.col("pos") + 1).alias("line"), "content")


def postings(files_: DataFrame) -> DataFrame:
    """token, path, line: distinct terms of each line."""
    return lines(files_).select("path", "line", F.explode(line_terms(F.col("content"))).alias("token"))


_indexed: dict[tuple[str, str], Postings] = {}


def index(spark: SparkSession, sf_dir: str) -> Postings:
    """The stored postings of the documents, written by the application's first question about them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexed:
        _indexed[key] = Postings.write(files(spark, sf_dir), fresh_path(spark, "postings"))
    return _indexed[key]


_grams: dict[tuple[str, str], Grams] = {}


def grams(spark: SparkSession, sf_dir: str) -> Grams:
    """The stored trigrams of symbols and paths, written by the application's first question about them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _grams:
        _grams[key] = Grams.write([(symbols(spark, sf_dir), ["name", "qualname", "signature", "path"]), (files(spark, sf_dir), ["path"])], fresh_path(spark, "grams"))
    return _grams[key]


def file_terms(files_: DataFrame) -> DataFrame:
    """token, path: distinct terms of each file, found inside the row."""
    return files_.select("path", F.explode(line_terms(F.col("text"))).alias("token"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("name"),
        F.concat("event_type", F.lit("."), F.col("event_id").cast("string")).alias("qualname"), F.col("event_type").alias("kind"), F.col("props").alias("signature"),
        (F.col("event_id") % 500).cast("int").alias("start_line"), (F.col("event_id") % 500 + F.col("event_id") % 37).cast("int").alias("end_line"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    target = F.concat(F.lit("supplier.s"), F.col("l_suppkey").cast("string"))
    return l.select(
        F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"), F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("source"),
        F.col("l_returnflag").alias("kind"), target.alias("target"), short_name(target).alias("target_short"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("confidence"),
    )


def dependency_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("context"), F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_size") % 7).cast("string"), F.lit(".0")).alias("version"), F.when(F.col("p_size") % 10 == 0, "py<3").alias("marker"))


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edges out of most parts: a graph with cycles, diamonds and conditional edges. The modulus is the node count."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    e = p.crossJoin(F.broadcast(n))  # one row
    one = e.select(F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("target"), F.when(F.col("p_size") % 10 == 1, "extra").alias("marker"))
    two = e.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 11 + 5) % F.col("n")).alias("target"), F.lit(None).cast("string").alias("marker"))
    return one.union(two)


FILES_SQL = "files AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.txt' AS path, doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS surface, CAST(CASE WHEN strlen(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, (strlen(text) + 3) // 4) END AS BIGINT) AS full_tokens, coalesce(text, '') AS text FROM documents)"
LINES_SQL = FILES_SQL + ", parts AS (SELECT path, string_split(text, chr(10)) AS ls FROM files), lines AS (SELECT path, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line, unnest(ls) AS content FROM parts)"
POSTINGS_SQL = (
    LINES_SQL
    + r""", raw AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]+')) AS tok FROM lines),
postings AS (SELECT DISTINCT path, line, unnest(list_concat([lower(tok)], list_filter(list_transform(regexp_extract_all(regexp_replace(tok, '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2))) AS token FROM raw)"""
)
SYMBOLS_SQL = "symbols AS (SELECT 'user/' || user_id AS path, event_type AS name, event_type || '.' || event_id AS qualname, event_type AS kind, props AS signature, CAST(event_id % 500 AS INTEGER) AS start_line, CAST(event_id % 500 + event_id % 37 AS INTEGER) AS end_line FROM events)"
EDGES_SQL = "edges AS (SELECT 'order/' || l_orderkey AS path, 'part.' || l_partkey AS source, l_returnflag AS kind, 'supplier.s' || l_suppkey AS target, 's' || l_suppkey AS target_short, l_linenumber AS line, l_linestatus AS confidence FROM lineitem)"
NODES_SQL = "nodes AS (SELECT p_partkey AS node, p_brand AS context, (p_size % 5) || '.' || (p_size % 7) || '.0' AS version, CASE WHEN p_size % 10 = 0 THEN 'py<3' END AS marker FROM part)"
DEPS_SQL = NODES_SQL + ", deps AS (SELECT p_partkey AS source, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS target, CASE WHEN p_size % 10 = 1 THEN 'extra' END AS marker FROM part UNION ALL SELECT p_partkey, (p_partkey * 11 + 5) % (SELECT count(*) FROM part), NULL FROM part WHERE p_partkey % 3 <> 0)"
