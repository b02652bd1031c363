"""Queries over search stages, structure and schedules, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.operators import retrieval, schedule, structure
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.sources import corpus as C

SUPPLIERS = "sup AS (SELECT 'sup/' || s_suppkey AS path, 's' || s_suppkey AS name, s_nationkey || '.s' || s_suppkey AS qualname, CAST(floor(s_acctbal) AS BIGINT) AS score FROM supplier)"


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf, "supplier").select(F.concat(F.lit("sup/"), k).alias("path"), F.concat(F.lit("s"), k).alias("name"), F.concat(F.col("s_nationkey").cast("string"), F.lit(".s"), k).alias("qualname"), F.floor("s_acctbal").cast("long").alias("score"))


BEST = "best AS (SELECT * FROM sup ORDER BY score DESC, path LIMIT 8)"


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return _suppliers(spark, sf).orderBy(F.desc("score"), "path").limit(8)


@query(f"WITH {C.EDGES_SQL}, {SUPPLIERS}, {BEST}, r AS (SELECT path, kind, row_number() OVER (PARTITION BY target_short ORDER BY path, line, source, kind) AS rn FROM edges WHERE target_short IN (SELECT name FROM best)) SELECT path, CAST(max(CASE kind WHEN 'A' THEN 30 ELSE 18 END) AS DOUBLE) AS boost FROM r WHERE rn <= 30 GROUP BY path")
def caller_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.caller_files(_best(spark, sf), C.edges(spark, sf), 30, call="A")


@query(f"""WITH {C.EDGES_SQL}, {SUPPLIERS}, own AS (SELECT target_short, kind, row_number() OVER (PARTITION BY path, source ORDER BY line, target, kind) AS rn FROM edges WHERE (path, source) IN (SELECT ('order/' || l_orderkey, 'part.' || l_partkey) FROM lineitem WHERE l_partkey % 10 = 4))
SELECT path, name, qualname, CAST(42 AS DOUBLE) AS boost FROM sup WHERE name IN (SELECT target_short FROM own WHERE rn <= 2 AND kind IN ('A', 'R'))""")
def semantic_expansion(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").where("l_partkey % 10 = 4")  # noqa: E741
    chosen = l.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"), F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("qualname"))
    return retrieval.type_targets(chosen, C.edges(spark, sf), _suppliers(spark, sf), 2, ["A", "R"]).select("path", "name", "qualname", "boost")


NATIVE = "def AS (SELECT 'user/' || user_id AS path, event_type AS display_name, event_type || '#' || event_id % 9 AS symbol, event_id % 50 AS line FROM events)"


@query(f"""WITH {NATIVE}, w AS ((SELECT * FROM def WHERE contains(lower(display_name), 'click') OR contains(lower(symbol), 'click') ORDER BY path, line, display_name, symbol LIMIT 24) UNION ALL (SELECT * FROM def WHERE contains(lower(display_name), 'r#3') OR contains(lower(symbol), 'r#3') ORDER BY path, line, display_name, symbol LIMIT 24))
SELECT path, display_name, line, min(symbol) AS symbol, CAST(24 AS DOUBLE) AS boost FROM w WHERE path <> 'user/3' GROUP BY path, display_name, line""")
def native_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    user = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    definitions = e.select(user.alias("path"), F.col("event_type").alias("display_name"), F.concat("event_type", F.lit("#"), (F.col("event_id") % 9).cast("string")).alias("symbol"), (F.col("event_id") % 50).alias("line"))
    files = e.select(user.alias("path")).where("path <> 'user/3'").distinct()
    return retrieval.native_candidates(definitions, files, ["Click", "R#3"]).select("path", "display_name", "line", "symbol", "boost")


@query(f"WITH {C.POSTINGS_SQL}, t AS (SELECT token, count(DISTINCT path) AS df FROM postings GROUP BY token HAVING count(DISTINCT path) <= 2) SELECT path, count(DISTINCT token) AS rare_terms FROM postings WHERE token IN (SELECT token FROM t) GROUP BY path")
def rare_anchors(spark: SparkSession, sf: str) -> DataFrame:
    index = C.index(spark, sf)
    return retrieval.rare_anchor(index.terms(), index.rows(), 2)


@query("""WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 46) THEN 'tests/o' ELSE 'src/o' END || o_orderkey || '.py' AS path FROM orders), p AS (SELECT 'k' || o_custkey AS token, path FROM o UNION ALL SELECT 'z' || o_custkey % 50, path FROM o),
d AS (SELECT token, count(DISTINCT path) AS n FROM p WHERE token IN ('k46', 'z46') GROUP BY token), f AS (SELECT path, count(DISTINCT token) AS rare_terms, starts_with(path, 'tests/') AS test FROM p JOIN d USING (token) WHERE n <= 100000 GROUP BY path HAVING count(DISTINCT token) >= 2)
SELECT * FROM f WHERE (SELECT count(*) FROM f) <= 100000 AND (SELECT count(*) FILTER (WHERE test) FROM f) = 1 AND (SELECT count(*) FROM f) > 1""")
def lexical_island(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    first = o.where("o_custkey = 46").agg(F.min("o_orderkey").alias("_first"))
    o = o.crossJoin(F.broadcast(first))  # one row
    path = F.concat(F.when(F.col("o_orderkey") == F.col("_first"), "tests/o").otherwise("src/o"), F.col("o_orderkey").cast("string"), F.lit(".py"))
    p = o.select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("token"), path.alias("path")).union(o.select(F.concat(F.lit("z"), (F.col("o_custkey") % 50).cast("string")), path)).where("token IN ('k46', 'z46')")
    return retrieval.lexical_island(p.groupBy("token").agg(F.count_distinct("path").alias("df")), p, 100_000, 2)


RANKED = "c AS (SELECT target, count(*) AS n FROM edges GROUP BY target), k AS (SELECT target, n, row_number() OVER (ORDER BY n DESC, target) AS rn FROM c)"


@query(f"""WITH {C.EDGES_SQL}, {RANKED}, d AS (SELECT target, count(*) AS n FROM edges WHERE kind <> 'R' GROUP BY target), m AS (SELECT target, n, row_number() OVER (ORDER BY n DESC, target) AS rn FROM d),
a AS (SELECT target, n FROM k WHERE rn <= 25), b AS (SELECT target, n FROM m WHERE rn <= 25)
SELECT *, 1 AS run FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 2 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def retrieval_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that differ between two runs of one question, of which the second one finds some edges gone."""
    edges = C.edges(spark, sf)
    runs = iter([edges, edges.where("kind <> 'R'")])
    return retrieval.unstable(lambda: next(runs).groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(25))


@query(f"WITH {C.EDGES_SQL}, {RANKED} SELECT target, n FROM k WHERE rn BETWEEN 41 AND 43")
def prefix_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a smaller answer that a larger one doesn't begin with: those that were put in from beyond it."""
    counts = C.edges(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    top = lambda n: counts.orderBy(F.desc("n"), "target").limit(n)
    strangers = top(43).exceptAll(top(40))
    return retrieval.not_a_prefix(top(7).union(strangers), top(40), [F.desc("n"), "target"])


@query("""WITH RECURSIVE i AS (SELECT s_suppkey AS key, CAST(floor(s_acctbal) AS BIGINT) % 500 + 2000 AS weight FROM supplier), o AS (SELECT *, row_number() OVER (ORDER BY weight DESC, key) AS pos FROM i),
w AS (SELECT 0 AS pos, [0, 0, 0, 0, 0] AS loads, 0 AS part UNION ALL SELECT o.pos, list_transform(w.loads, lambda x, j: x + CASE WHEN j = list_position(w.loads, list_min(w.loads)) THEN o.weight ELSE 0 END), list_position(w.loads, list_min(w.loads)) FROM w JOIN o ON o.pos = w.pos + 1)
SELECT CAST(part - 1 AS INTEGER) AS part, CAST(sum(weight) AS BIGINT) AS load, count(*) AS n FROM w JOIN o USING (pos) GROUP BY part""")
def balanced_parts(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (F.floor("s_acctbal").cast("long") % 500 + 2000).alias("weight"))
    return schedule.balanced(items, "key", "weight", 5).groupBy("part").agg(F.sum("weight").alias("load"), F.count(F.lit(1)).alias("n"))


OWNED = "def AS (SELECT p_partkey AS path FROM part WHERE p_size % 3 = 0), ex AS (SELECT DISTINCT source AS path, target AS owner FROM deps WHERE marker IS NULL AND source NOT IN (SELECT path FROM def))"


@query(f"""WITH RECURSIVE {C.DEPS_SQL}, {OWNED}, w AS (SELECT node AS path, node AS pos FROM nodes UNION SELECT w.path, e.owner FROM w JOIN ex e ON e.path = w.pos),
plus AS (SELECT path, owner AS pos FROM ex UNION SELECT p.path, e.owner FROM plus p JOIN ex e ON e.path = p.pos), circle AS (SELECT path FROM plus WHERE path = pos),
hit AS (SELECT path, count(*) AS n, min(pos) AS owner FROM w WHERE pos IN (SELECT path FROM def) GROUP BY path),
loose AS (SELECT DISTINCT path FROM w WHERE pos IN (SELECT path FROM circle) OR (pos NOT IN (SELECT path FROM def) AND pos NOT IN (SELECT path FROM ex)))
SELECT node AS path, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 AND l.path IS NULL THEN 'resolved-unique' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 AND l.path IS NULL THEN owner END AS owner FROM nodes LEFT JOIN hit ON hit.path = node LEFT JOIN loose l ON l.path = node""")
def import_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Every node asks who owns its name, over all unconditional edges."""
    name = F.lit("f").alias("name")
    exports = C.dependency_edges(spark, sf).where("marker IS NULL").select(F.col("source").alias("path"), name, F.col("target").alias("owner"), F.lit("f").alias("owner_name"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), name, "p_size")
    return structure.import_owners(p, exports, p.where("p_size % 3 = 0")).select("path", "status", "owner")


@query("WITH c AS (SELECT DISTINCT l_orderkey AS context, l_linenumber AS ord, l_partkey AS module FROM lineitem), o AS (SELECT DISTINCT p_partkey AS module, p_size % 4 AS node FROM part WHERE p_size % 3 = 0), b AS (SELECT context, module, row_number() OVER (PARTITION BY context ORDER BY ord, module) AS rn FROM c WHERE module IN (SELECT module FROM o)) SELECT context, module, node FROM b JOIN o USING (module) WHERE rn = 1")
def import_correspondence(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("context"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("module")).distinct()
    return structure.first_owned(c, table(spark, sf, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("module"), (F.col("p_size") % 4).alias("node")))


@query(f"WITH {C.EDGES_SQL}, {SUPPLIERS}, imp AS (SELECT DISTINCT 'order/' || l_orderkey AS path, 'sup/' || l_suppkey AS owner FROM lineitem) SELECT DISTINCT e.path, e.target, s.path AS owner FROM edges e JOIN sup s ON s.name = e.target_short JOIN imp i ON i.path = e.path AND i.owner = s.path")
def call_symbols(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    imports = l.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"), F.concat(F.lit("sup/"), F.col("l_suppkey").cast("string")).alias("imported"))
    return structure.call_symbols(C.edges(spark, sf), _suppliers(spark, sf), imports)


FEW = "calls AS (SELECT l_partkey AS source, l_suppkey * 7 % (SELECT count(*) FROM part) AS target FROM lineitem), few AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM (SELECT DISTINCT source, target FROM calls)) WHERE rn <= 3)"
LEVELS = "seeds AS (SELECT p_partkey AS node FROM part WHERE p_partkey IN (1, 7, 50)), w AS (SELECT node, 0 AS depth FROM seeds UNION SELECT f.target, w.depth + 1 FROM w JOIN few f ON f.source = w.node WHERE w.depth < 4), lv AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node)"


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "lineitem").crossJoin(F.broadcast(n)).select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") * 7 % F.col("n")).alias("target"))  # one row


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1,), (7,), (50,)], "node long")


@query(f"WITH RECURSIVE {FEW}, {LEVELS} SELECT node, depth FROM lv")
def locality_levels(spark: SparkSession, sf: str) -> DataFrame:
    return structure.limited_levels(_calls(spark, sf), _seeds(spark), 4, 3, ["target"])[0]


@query(f"WITH RECURSIVE {FEW}, {LEVELS} SELECT source AS node, count(DISTINCT target) AS edges FROM calls WHERE source IN (SELECT node FROM lv WHERE depth < 4) GROUP BY source HAVING count(DISTINCT target) > 3")
def locality_truncations(spark: SparkSession, sf: str) -> DataFrame:
    return structure.limited_levels(_calls(spark, sf), _seeds(spark), 4, 3, ["target"])[1]


@query(f"WITH RECURSIVE {FEW}, {LEVELS}, st AS (SELECT b.node, a.node AS parent, (a.node * 31 + b.node) % 5 AS weight FROM lv a JOIN few f ON f.source = a.node JOIN lv b ON b.node = f.target AND b.depth = a.depth + 1), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, parent) AS rn FROM st) SELECT lv.node, depth, parent, weight FROM lv LEFT JOIN r ON r.node = lv.node AND rn = 1")
def ownership_expansion(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.operators.topk import top_per_group

    calls = _calls(spark, sf)
    levels = structure.limited_levels(calls, _seeds(spark), 4, 3, ["target"])[0]
    few = top_per_group(calls.distinct(), ["source"], ["target"], 3).select("source", "target", ((F.col("source") * 31 + F.col("target")) % 5).alias("weight"))
    return structure.with_parents(few, levels)


@query("WITH d AS (SELECT l_orderkey AS task, l_suppkey AS owner, l_linenumber % 3 AS distance FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT task, min(distance) AS distance FROM d GROUP BY task), f AS (SELECT task, min(owner) AS o FROM d JOIN n USING (task, distance) GROUP BY task HAVING count(DISTINCT owner) = 1) SELECT o_orderkey AS task, coalesce(o, o_custkey) AS owner, CASE WHEN o IS NOT NULL THEN 'delegate' ELSE 'baseline' END AS by FROM orders LEFT JOIN f ON f.task = o_orderkey")
def delegated_owners(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("owner"), (F.col("l_linenumber") % 3).alias("distance"))
    return structure.delegated(table(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("owner")), d)


@query("WITH e AS (SELECT l_orderkey AS source, l_partkey AS target, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pos FROM lineitem), m AS (SELECT source, target, min(pos) AS pos FROM e GROUP BY 1, 2) SELECT source, target, CASE pos WHEN 0 THEN 'adjacent' WHEN 1 THEN 'impact' ELSE 'authority' END AS reason FROM m")
def task_relationships(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), "l_returnflag")
    return structure.task_relationships(*[(reason, e.where(F.col("l_returnflag") == flag)) for reason, flag in (("adjacent", "A"), ("impact", "N"), ("authority", "R"))])


@query(f"WITH RECURSIVE {C.DEPS_SQL}, e AS (SELECT DISTINCT source, target FROM deps), w AS (SELECT source AS s, target AS pos, 1 AS n FROM e UNION SELECT w.s, e.target, n + 1 FROM w JOIN e ON e.source = w.pos WHERE n < 6 AND w.s <> w.pos) SELECT s AS node, CAST(min(n) AS INTEGER) AS length FROM w WHERE s = pos GROUP BY s")
def graph_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return structure.cycles(C.dependency_edges(spark, sf), 6)


@query("""WITH x AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_partkey))) AS a, list_sort(list_distinct(list(l_returnflag))) AS b FROM lineitem GROUP BY 1)
SELECT k, 'symbols' AS surface, sha256('[' || array_to_string(a, ',') || ']') AS digest FROM x UNION ALL SELECT k, 'relations', sha256('["' || array_to_string(b, '","') || '"]') FROM x""")
def surface_digests(spark: SparkSession, sf: str) -> DataFrame:
    return structure.surface_digests(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k"), "k", {"symbols": "l_partkey", "relations": "l_returnflag"})


@query("WITH a AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity > 25 AS inside FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY inside DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM a) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE rn <= 2")
def heap_arguments(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), (F.col("l_quantity") > 25).alias("inside")).distinct()  # noqa: E741
    return structure.spans_first(l, "l_orderkey", "at", "inside", 2).select("l_orderkey", "at.*")
