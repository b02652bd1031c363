"""Queries over a dependency observation with bounds, and their DuckDB equivalents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.operators import dependency
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.sources import corpus as C

PACKAGES = "packages AS (SELECT p_partkey AS node, p_brand AS context, CASE WHEN p_partkey % 3 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '__')) WHEN 1 THEN replace(p_name, ' ', '.') ELSE replace(p_name, ' ', '-') END AS name, (p_size % 5) || '.' || (p_size % 7) || '.0' AS version, p_size % 5 AS major, p_size % 7 AS minor, CASE WHEN p_size % 10 = 0 THEN 'py<3' END AS marker FROM part)"
RED = "hits AS (SELECT * FROM packages WHERE ecosystem = 'pypi' AND lower(regexp_replace(name, '[-_.]+', '-', 'g')) = 'red-widget')"


def _packages(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    spaced = lambda sep: F.replace("p_name", F.lit(" "), F.lit(sep))
    return p.select(
        k.alias("node"), F.col("p_brand").alias("context"), F.when(k % 3 == 0, "npm").otherwise("pypi").alias("ecosystem"),
        F.when(k % 4 == 0, F.upper(spaced("__"))).when(k % 4 == 1, spaced(".")).otherwise(spaced("-")).alias("name"),
        F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_size") % 7).cast("string"), F.lit(".0")).alias("version"), F.when(F.col("p_size") % 10 == 0, "py<3").alias("marker"),
    )


@query(f"WITH {PACKAGES}, {RED} SELECT node, context, name, version FROM hits WHERE major >= 2 AND (major, minor) < (4, 3) ORDER BY context, node LIMIT 25")
def package_selector(spark: SparkSession, sf: str) -> DataFrame:
    return dependency.package_query(_packages(spark, sf), 25, ecosystem="pypi", name="Red_Widget", spec=">=2,<4.3")[0].select("node", "context", "name", "version")


@query(f"WITH {PACKAGES}, {RED}, m AS (SELECT * FROM hits WHERE major >= 2 AND (major, minor) < (4, 3)) SELECT count(*) AS match_count, count(*) > 25 AS truncated, CAST(0 AS BIGINT) AS unclassified, count(DISTINCT version) > 1 AS multiple_versions, count(DISTINCT context) > 1 AS multiple_contexts FROM m")
def package_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dependency.package_query(_packages(spark, sf), 25, ecosystem="pypi", name="Red_Widget", spec=">=2,<4.3")[1]


@query("""WITH c AS (SELECT 'o' || o_custkey % 40 AS context, CASE WHEN o_orderpriority LIKE '5%' THEN 'resolution-graph' ELSE 'resolved-inventory' END AS kind, CASE WHEN o_orderkey % 97 = 3 THEN 'incomplete' WHEN o_custkey % 40 = 7 THEN 'unknown' ELSE 'complete' END AS completeness, CASE WHEN o_orderkey % 101 = 5 AND o_custkey % 40 < 20 THEN 'truncated' ELSE 'complete' END AS truncation FROM orders),
d AS (SELECT DISTINCT context FROM c UNION SELECT 'none'), r AS (SELECT context, bool_and(completeness = 'complete' AND truncation = 'complete') AS a, bool_or(completeness = 'incomplete' OR truncation = 'truncated') AS s FROM c WHERE kind = 'resolved-inventory' GROUP BY context)
SELECT context, CASE WHEN a THEN 'complete' WHEN s THEN 'incomplete' ELSE 'unknown' END AS completeness, CASE WHEN coalesce(a, false) THEN 'admissible-within-declared-scope' ELSE 'not-admissible' END AS negative_evidence FROM d LEFT JOIN r USING (context)""")
def inventory_assessment(spark: SparkSession, sf: str) -> DataFrame:
    o, cell = table(spark, sf, "orders"), F.col("o_custkey") % 40
    rows = o.select(
        F.concat(F.lit("o"), cell.cast("string")).alias("context"), F.when(F.col("o_orderpriority").startswith("5"), "resolution-graph").otherwise("resolved-inventory").alias("kind"),
        F.when(F.col("o_orderkey") % 97 == 3, "incomplete").when(cell == 7, "unknown").otherwise("complete").alias("completeness"), F.when((F.col("o_orderkey") % 101 == 5) & (cell < 20), "truncated").otherwise("complete").alias("truncation"),
    )
    return dependency.inventory_assessment(rows, rows.select("context").union(spark.range(1).select(F.lit("none").alias("context"))))


SEEDS = "seeds AS (SELECT node FROM nodes WHERE node IN (1, 7, 50))"
FREE = "held AS (SELECT node FROM nodes WHERE marker IS NOT NULL), free AS (SELECT DISTINCT source, target FROM deps WHERE marker IS NULL AND source NOT IN (SELECT node FROM held) AND target NOT IN (SELECT node FROM held)), cond AS (SELECT DISTINCT source, target FROM deps WHERE (source, target) NOT IN (SELECT (source, target) FROM free))"


def _walk_sql(a: str, b: str, depth: int, visits: int) -> str:
    """Levels of at most `depth`, cut before the first level whose edges take the visits past the limit."""
    return f"""w AS (SELECT node, 0 AS depth FROM seeds UNION SELECT f.{b}, w.depth + 1 FROM w JOIN free f ON f.{a} = w.node WHERE w.depth < {depth}), lv AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
cost AS (SELECT depth, count(*) AS n FROM lv JOIN free f ON f.{a} = lv.node WHERE depth < {depth} GROUP BY depth), far AS (SELECT depth, sum(n) OVER (ORDER BY depth) AS total FROM cost), lim AS (SELECT coalesce(min(depth), {depth}) AS d FROM far WHERE total > {visits}),
kept AS (SELECT node, CAST(depth AS INTEGER) AS depth FROM lv WHERE depth <= (SELECT d FROM lim))"""


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1,), (7,), (50,)], "node long")


@query(f"WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {FREE}, {_walk_sql('source', 'target', 8, 60)} SELECT node, depth FROM kept WHERE depth > 0 ORDER BY depth, node LIMIT 20")
def dependencies_bounded(spark: SparkSession, sf: str) -> DataFrame:
    return dependency.bounded_walk(C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf), _seeds(spark), 8, 20, 60)[0]


@query(f"WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {FREE}, {_walk_sql('target', 'source', 5, 200)} SELECT node, depth FROM kept WHERE depth > 0 ORDER BY depth, node LIMIT 30")
def dependents_bounded(spark: SparkSession, sf: str) -> DataFrame:
    return dependency.bounded_walk(C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf), _seeds(spark), 5, 30, 200, reverse=True)[0]


@query(f"""WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {FREE}, {_walk_sql('source', 'target', 8, 60)} SELECT 'conditional-edge' AS reason, node FROM kept WHERE depth < 8 AND node IN (SELECT source FROM cond)
UNION ALL SELECT 'depth-limit', node FROM kept WHERE depth = 8 AND node IN (SELECT source FROM deps) UNION ALL SELECT 'visit-limit', NULL FROM lim WHERE d < 8 AND EXISTS (SELECT 1 FROM far WHERE total > 60) UNION ALL SELECT 'result-limit', NULL WHERE (SELECT count(*) FROM kept WHERE depth > 0) > 20""")
def dependencies_omissions(spark: SparkSession, sf: str) -> DataFrame:
    return dependency.bounded_walk(C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf), _seeds(spark), 8, 20, 60)[1]


@query(f"""WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, e AS (SELECT DISTINCT source, target FROM deps), p AS (SELECT [node] AS path, node AS tip, 0 AS depth FROM seeds
UNION ALL SELECT list_append(p.path, e.target), e.target, p.depth + 1 FROM p JOIN e ON e.source = p.tip WHERE p.depth < 7 AND p.tip <> 10 AND NOT list_contains(p.path, e.target))
SELECT array_to_string(path, '>') AS path, CAST(depth AS INTEGER) AS depth FROM (SELECT * FROM p WHERE tip = 10 ORDER BY depth, path LIMIT 3)""")
def paths_bounded(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = dependency.bounded_paths(C.dependency_edges(spark, sf), _seeds(spark), 10, 7, 3, 100_000)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


#: Six queries over one graph: both directions, other seeds, other limits of depth, results and visits.
WALKS = {"first": (1, 0, 2, 100_000, 100_000), "second": (1, 0, 3, 100_000, 100_000), "up": (1, 1, 4, 25, 100_000), "dear": (2, 0, 6, 100_000, 40), "cheap": (3, 1, 1, 2, 100_000), "still": (2, 0, 0, 5, 5)}
WALKS_SQL = ", ".join(f"('{q}', {m}, {r}, {d}, {n}, {v})" for q, (m, r, d, n, v) in WALKS.items())
BATCH = f"""asked AS (SELECT * FROM (VALUES {WALKS_SQL}) t(query, every, back, max_depth, max_results, max_visits)),
starts AS (SELECT query, node FROM asked, seeds WHERE node % every = 0), steps AS (SELECT 0 AS back, source AS a, target AS b FROM free UNION ALL SELECT 1, target, source FROM free),
w AS (SELECT query, node, 0 AS depth FROM starts UNION SELECT w.query, s.b, w.depth + 1 FROM w JOIN asked USING (query) JOIN steps s ON s.a = w.node AND s.back = asked.back WHERE w.depth < max_depth),
lv AS (SELECT query, node, min(depth) AS depth FROM w GROUP BY ALL), cost AS (SELECT l.query, l.depth + 1 AS depth, count(*) AS n FROM lv l JOIN asked q USING (query) JOIN steps s ON s.a = l.node AND s.back = q.back WHERE l.depth < max_depth GROUP BY ALL),
used AS (SELECT query, depth, sum(n) OVER (PARTITION BY query ORDER BY depth) AS total FROM cost), stop AS (SELECT query, min(depth) AS depth FROM used JOIN asked USING (query) WHERE total > max_visits GROUP BY query),
kept AS (SELECT l.* FROM lv l LEFT JOIN stop USING (query) WHERE stop.depth IS NULL OR l.depth < stop.depth), found AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY depth, node) AS rn FROM kept WHERE depth > 0)"""


def _batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every query in one call: one frontier, one job for each level."""
    starts = reduce(DataFrame.unionByName, [_seeds(spark).where(F.col("node") % every == 0).select(F.lit(q).alias("query"), "node") for q, (every, *_) in WALKS.items()])
    walks = {q: dependency.Walk(depth, results, visits, bool(back)) for q, (_, back, depth, results, visits) in WALKS.items()}
    return dependency.batched_walks(C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf), starts, walks)


@query(f"WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {FREE}, {BATCH} SELECT query, node, CAST(depth AS INTEGER) AS depth FROM found JOIN asked USING (query) WHERE rn <= max_results")
def batch_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _batch(spark, sf)[0]


@query(f"""WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {FREE}, {BATCH}, ends AS (SELECT k.query, k.node, k.depth, max_depth, back FROM kept k JOIN asked USING (query)),
bound AS (SELECT source, target FROM cond EXCEPT SELECT source, target FROM free), held2 AS (SELECT 0 AS back, source AS a FROM bound UNION SELECT 1, target FROM bound)
SELECT query, 'conditional-edge' AS reason, node FROM ends e WHERE depth < max_depth AND EXISTS (SELECT 1 FROM held2 h WHERE h.a = e.node AND h.back = e.back)
UNION ALL SELECT query, 'depth-limit', node FROM ends e WHERE depth = max_depth AND (EXISTS (SELECT 1 FROM held2 h WHERE h.a = e.node AND h.back = e.back) OR EXISTS (SELECT 1 FROM steps s WHERE s.a = e.node AND s.back = e.back))
UNION ALL SELECT query, 'visit-limit', NULL FROM stop UNION ALL SELECT query, 'result-limit', NULL FROM found JOIN asked USING (query) GROUP BY query, max_results HAVING count(*) > max_results""")
def batch_omissions(spark: SparkSession, sf: str) -> DataFrame:
    return _batch(spark, sf)[1]


USES = "uses AS (SELECT DISTINCT 'order/' || l_orderkey AS path, l_partkey AS node FROM lineitem)"


def _uses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_partkey").alias("node")).distinct()


@query(f"""WITH {PACKAGES}, {C.DEPS_SQL}, {USES}, wanted AS (SELECT node, name, version FROM packages WHERE name IN ('red-widget', 'small.ring')), up AS (SELECT DISTINCT target AS node, source FROM deps)
SELECT w.node, name, version, (SELECT count(*) FROM up WHERE up.node = w.node) AS n_dependents, (SELECT array_to_string(list_sort(list(source)), ',') FROM (SELECT source FROM up WHERE up.node = w.node ORDER BY source LIMIT 3)) AS dependents, (SELECT count(*) FROM uses u WHERE u.node = w.node) AS n_files, (SELECT array_to_string(list_sort(list(path)), ',') FROM (SELECT path FROM uses u WHERE u.node = w.node ORDER BY path LIMIT 3)) AS files FROM wanted w""")
def package_projection(spark: SparkSession, sf: str) -> DataFrame:
    p = dependency.projection(_packages(spark, sf), C.dependency_edges(spark, sf), _uses(spark, sf), ["red-widget", "small.ring"], 3)
    return p.select("node", "name", "version", "n_dependents", F.array_join(F.transform("dependents", lambda x: x.cast("string")), ",").alias("dependents"), "n_files", F.array_join("files", ",").alias("files"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'gone' WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'current' END AS state FROM orders")
def requalified_members(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    was = o.select("o_orderkey", F.sha2(F.col("o_totalprice").cast("string"), 256).alias("digest"))
    now = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.sha2((F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).cast("string"), 256).alias("digest"))
    return dependency.requalified(was, now, "o_orderkey")


VERIFIERS = "verifiers AS (SELECT DISTINCT 'order/' || l_orderkey AS path, 'tests/s' || l_suppkey AS verifier FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')"


@query(f"WITH {C.DEPS_SQL}, {USES}, {VERIFIERS}, reach AS (SELECT source AS node, target AS dependency FROM deps UNION SELECT source, source FROM deps) SELECT DISTINCT node, dependency, path, verifier FROM uses JOIN reach USING (node) JOIN verifiers USING (path)")
def verification_chains(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F'").select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"), F.concat(F.lit("tests/s"), F.col("l_suppkey").cast("string")).alias("verifier")).distinct()
    return dependency.verification_chains(_uses(spark, sf), C.dependency_edges(spark, sf), v)


@query(f"""WITH {PACKAGES}, {C.DEPS_SQL}, {RED}, up AS (SELECT target AS node, count(DISTINCT source) AS n, min(source) AS f FROM deps GROUP BY target)
SELECT h.node, CASE WHEN h.node % 11 = 0 THEN 'declared-root' WHEN n > 0 THEN 'transitive' ELSE 'unexplained' END AS derivation, coalesce(n, 0) AS through, f AS first_through FROM hits h LEFT JOIN up USING (node)""")
def selection_explained(spark: SparkSession, sf: str) -> DataFrame:
    hits = dependency.package_matches(_packages(spark, sf), "pypi", "red.widget")
    return dependency.explained(hits, C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf).where("node % 11 = 0"))
