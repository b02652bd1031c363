"""Queries over dependency graphs, deltas, observations and change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.operators import aggregate, delta, evidence, graph
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.sources import corpus as C
from strataquery.streaming import journal as J

SEEDS = "seeds AS (SELECT node FROM nodes WHERE node IN (1, 7, 50))"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1,), (7,), (50,)], "node long")


def _levels_sql(source: str, target: str, depth: int, edges: str = "deps") -> str:
    return f"w AS (SELECT node, 0 AS depth FROM seeds UNION ALL SELECT d.{target}, w.depth + 1 FROM w JOIN (SELECT DISTINCT source, target FROM {edges}) d ON d.{source} = w.node WHERE w.depth < {depth}), lv AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node)"


@query(f"WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {_levels_sql('target', 'source', 5)} SELECT node, depth FROM lv")
def reverse_levels(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reverse_levels(C.dependency_edges(spark, sf), _seeds(spark), 5)


@query(f"WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {_levels_sql('target', 'source', 6)} SELECT node, depth FROM lv WHERE depth > 0")
def affected_closure(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(C.dependency_edges(spark, sf), _seeds(spark), 6, reverse=True)


@query(f"WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {_levels_sql('target', 'source', 4)} SELECT n.context, count(*) AS n FROM lv JOIN nodes n USING (node) GROUP BY n.context")
def project_dependents(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.closure(C.dependency_edges(spark, sf), _seeds(spark), 4, reverse=True, with_seeds=True)
    return found.join(C.dependency_nodes(spark, sf), "node").groupBy("context").agg(F.count(F.lit(1)).alias("n"))


FREE = "held AS (SELECT node FROM nodes WHERE marker IS NOT NULL), free AS (SELECT DISTINCT source, target FROM deps WHERE marker IS NULL AND source NOT IN (SELECT node FROM held) AND target NOT IN (SELECT node FROM held))"


@query(f"WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {FREE}, {_levels_sql('source', 'target', 6, 'free')} SELECT node, depth FROM lv")
def walk_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return graph.walk(C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf), _seeds(spark), 6)[0]


@query(f"""WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {FREE}, {_levels_sql('source', 'target', 4, 'free')}, cond AS (SELECT DISTINCT source, target FROM deps WHERE marker IS NOT NULL OR source IN (SELECT node FROM held) OR target IN (SELECT node FROM held)),
c2 AS (SELECT DISTINCT source FROM cond c WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.source = c.source AND f.target = c.target))
SELECT 'conditional-selection' AS reason, node FROM lv WHERE depth < 4 AND node IN (SELECT node FROM held)
UNION ALL SELECT 'conditional-edge', node FROM lv WHERE depth < 4 AND node NOT IN (SELECT node FROM held) AND node IN (SELECT source FROM c2)
UNION ALL SELECT 'depth-limit', node FROM lv WHERE depth = 4 AND node IN (SELECT source FROM deps)""")
def walk_omissions(spark: SparkSession, sf: str) -> DataFrame:
    return graph.walk(C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf), _seeds(spark), 4)[1]


@query(f"WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, {FREE}, {_levels_sql('source', 'target', 6, 'free')} SELECT t.node AS target, l.node IS NOT NULL AS reachable FROM nodes t LEFT JOIN lv l USING (node)")
def reachability(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.walk(C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf), _seeds(spark), 6)[0]
    targets = C.dependency_nodes(spark, sf).select("node")
    return targets.join(found.select("node", F.lit(True).alias("hit")), "node", "left").select(F.col("node").alias("target"), F.coalesce("hit", F.lit(False)).alias("reachable"))


@query(f"""WITH RECURSIVE {C.DEPS_SQL}, {SEEDS}, e AS (SELECT DISTINCT source, target FROM deps), p AS (SELECT [node] AS path, node AS tip, 0 AS depth FROM seeds
UNION ALL SELECT list_append(p.path, e.target), e.target, p.depth + 1 FROM p JOIN e ON e.source = p.tip WHERE p.depth < 5 AND p.tip <> 10 AND NOT list_contains(p.path, e.target))
SELECT array_to_string(path, '>') AS path, CAST(depth AS INTEGER) AS depth FROM p WHERE tip = 10""")
def simple_paths(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.simple_paths(C.dependency_edges(spark, sf), _seeds(spark), 10, 5)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


@query("""WITH e AS (SELECT l_partkey AS source, l_suppkey + 1000000 AS target, l_returnflag AS kind FROM lineitem), b AS (SELECT source AS node, target AS neighbour, kind FROM e UNION ALL SELECT target, source, kind FROM e)
SELECT neighbour, CAST(sum(CASE kind WHEN 'A' THEN 42 WHEN 'N' THEN 38 ELSE 0 END) AS DOUBLE) AS weight, count(*) AS n FROM b WHERE node IN (1, 7, 50) GROUP BY neighbour""")
def adjacency_weighted(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1_000_000).alias("target"), F.col("l_returnflag").alias("kind"))
    return graph.adjacency(e, _seeds(spark), {"A": 42.0, "N": 38.0})


@query(f"WITH {C.DEPS_SQL} SELECT DISTINCT n AS node FROM (SELECT source AS n FROM deps UNION SELECT target FROM deps) WHERE n NOT IN (SELECT node FROM nodes WHERE node % 4 <> 0)")
def dangling_ends(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.dangling(C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf).where("node % 4 <> 0"))


SNAPSHOTS = """a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderdate < '1997-01-01'),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderdate >= '1993-06-01')"""


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"), "o_orderdate")
    edited = o.withColumn("s", F.when(F.col("k") % 9 == 0, "X").otherwise(F.col("s")))
    return o.where("o_orderdate < '1997-01-01'").drop("o_orderdate"), edited.where("o_orderdate >= '1993-06-01'").drop("o_orderdate")


@query(f"WITH {SNAPSHOTS} SELECT k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s = b.s AND a.p = b.p THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (k)")
def delta_full(spark: SparkSession, sf: str) -> DataFrame:
    return delta.keyed_delta(*_snapshots(spark, sf), ["k"], ["s", "p"])


@query(f"""WITH {SNAPSHOTS}, x AS (SELECT s, count(*) AS n FROM a GROUP BY s), y AS (SELECT s, count(*) AS n FROM b GROUP BY s)
SELECT s, coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_after, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) AS added, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) AS removed FROM x FULL JOIN y USING (s)""")
def delta_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return delta.multiset_delta(*_snapshots(spark, sf), ["s"])


@query(f"WITH {SNAPSHOTS}, x AS (SELECT p, min(k) AS was_at FROM a GROUP BY p HAVING count(*) = 1), y AS (SELECT p, min(k + k % 2) AS now_at FROM b GROUP BY p HAVING count(*) = 1) SELECT p, was_at, now_at FROM x JOIN y USING (p) WHERE was_at <> now_at")
def relocations(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _snapshots(spark, sf)
    return delta.relocations(a, b.withColumn("k", F.col("k") + F.col("k") % 2), ["p"], "k")


@query(f"WITH {SNAPSHOTS}, o AS (SELECT * FROM b WHERE k % 3 = 0), c AS (SELECT k FROM a WHERE k % 5 = 0) SELECT k, s, p, 'overlay' AS layer FROM o UNION ALL SELECT k, s, p, 'base' FROM a WHERE k NOT IN (SELECT k FROM c) AND k NOT IN (SELECT k FROM o)")
def overlay_shadow(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _snapshots(spark, sf)
    return delta.overlay(a, b.where("k % 3 = 0"), a.where("k % 5 = 0"), "k")


@query(f"WITH {SNAPSHOTS}, n AS (SELECT * FROM b WHERE k % 3 = 0) SELECT * FROM a WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n")
def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _snapshots(spark, sf)
    return delta.replace_children(a, b.where("k % 3 = 0"), ["k"])


@query(f"WITH {SNAPSHOTS} SELECT k, CASE WHEN k IN (SELECT k FROM a WHERE s = 'F') THEN 'direct' WHEN k IN (SELECT k FROM a) THEN 'dependent' ELSE 'uncovered' END AS state FROM b")
def coverage_classification(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _snapshots(spark, sf)
    return delta.coverage(b, a.where("s = 'F'"), a, "k")


@query(f"WITH {SNAPSHOTS} SELECT b.k, CASE WHEN a.k IS NULL THEN 'new' WHEN a.s = b.s AND a.p = b.p THEN 'reuse' ELSE 'refresh' END AS action FROM b LEFT JOIN a USING (k)")
def reuse_classification(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _snapshots(spark, sf)
    return delta.reuse(b, a, "k", ["s", "p"])


@query(f"WITH {SNAPSHOTS} SELECT a.k, CASE WHEN b.k IS NOT NULL THEN sha256(a.s) = sha256(b.s) END AS fresh FROM a LEFT JOIN b USING (k)")
def freshness_map(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _snapshots(spark, sf)
    return delta.freshness(a.withColumn("digest", F.sha2("s", 256)), b.withColumn("digest", F.sha2("s", 256)), "k")


@query("""WITH x AS (SELECT l_suppkey AS component, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS was FROM lineitem WHERE l_shipdate < '1996-01-01' AND l_suppkey % 2 = 0 GROUP BY 1),
y AS (SELECT l_suppkey AS component, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS now FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_suppkey % 3 = 0 GROUP BY 1)
SELECT component, was, now, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was = now THEN 'unchanged' ELSE 'changed' END AS state FROM x FULL JOIN y USING (component)""")
def selection_transitions(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("component"), F.col("l_returnflag").alias("version"), "l_shipdate")  # noqa: E741
    return evidence.transitions(l.where("l_shipdate < '1996-01-01' AND component % 2 = 0"), l.where("l_shipdate >= '1996-01-01' AND component % 3 = 0"))


@query("""WITH r AS (SELECT p_brand AS concept, p_type AS scope, p_partkey AS subject, p_size % 3 AS value FROM part), g AS (SELECT concept, scope, count(DISTINCT subject) AS subjects, count(DISTINCT value) AS "values" FROM r GROUP BY 1, 2)
SELECT concept, scope, subjects, "values", CASE WHEN "values" > 1 THEN 'disagreement' WHEN subjects = 1 THEN 'single' ELSE 'equivalent' END AS state FROM g""")
def declaration_groups(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_brand").alias("concept"), F.col("p_type").alias("scope"), F.col("p_partkey").alias("subject"), (F.col("p_size") % 3).alias("value"))
    return evidence.declaration_groups(p, ["concept", "scope"])


COVER = "cov AS (SELECT n_name AS context, CASE WHEN n_regionkey % 2 = 0 THEN 'graph' ELSE 'inventory' END AS kind, CASE WHEN n_nationkey = 3 THEN 'partial' ELSE 'complete' END AS completeness, 'complete' AS truncation FROM nation)"


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("context"), F.when(F.col("n_regionkey") % 2 == 0, "graph").otherwise("inventory").alias("kind"), F.when(F.col("n_nationkey") == 3, "partial").otherwise("complete").alias("completeness"), F.lit("complete").alias("truncation"))


@query(f"WITH {COVER} SELECT kind, bool_and(completeness = 'complete' AND truncation = 'complete') AS complete FROM cov GROUP BY kind")
def coverage_assessment(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.coverage_complete(_coverage(spark, sf))


@query(f"""WITH RECURSIVE {C.DEPS_SQL}, {COVER}, {SEEDS}, {FREE}, {_levels_sql('source', 'target', 3, 'free')}, c AS (SELECT bool_and(completeness = 'complete' AND truncation = 'complete') AS ok FROM cov WHERE kind = 'graph')
SELECT n.node, CASE WHEN l.node IS NOT NULL THEN 'not-applicable' WHEN c.ok THEN 'admissible' ELSE 'inadmissible' END AS evidence FROM nodes n LEFT JOIN lv l USING (node), c""")
def negative_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.walk(C.dependency_edges(spark, sf), C.dependency_nodes(spark, sf), _seeds(spark), 3)[0].select("node", F.lit(1).alias("hit"))
    ok = evidence.coverage_complete(_coverage(spark, sf)).where("kind = 'graph'").select("complete")
    n = C.dependency_nodes(spark, sf).select("node").join(found, "node", "left").crossJoin(F.broadcast(ok))  # one row
    return n.select("node", evidence.negative_evidence(F.coalesce("hit", F.lit(0)), F.col("complete"), F.lit(0)).alias("evidence"))


@query(f"""WITH {C.NODES_SQL}, v AS (SELECT node, version, CAST(string_split(version, '.')[1] AS INTEGER) AS a, CAST(string_split(version, '.')[2] AS INTEGER) AS b FROM nodes)
SELECT node, version, CASE WHEN (a, b) >= (1, 2) AND a < 4 THEN 'match' ELSE 'nonmatch' END AS pypi, CASE WHEN a = 2 AND b >= 3 THEN 'match' ELSE 'nonmatch' END AS npm FROM v""")
def version_filter(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.functions.versions import version_state

    n = C.dependency_nodes(spark, sf).select("node", "version")
    return n.select("node", "version", version_state("version", ">=1.2,<4").alias("pypi"), version_state("version", "^2.3.0", "npm").alias("npm"))


@query(f"""WITH {C.NODES_SQL}, v AS (SELECT node, CAST(string_split(version, '.')[1] AS INTEGER) AS a, CAST(string_split(version, '.')[2] AS INTEGER) AS b, node % 3 AS pre FROM nodes), w AS (SELECT node, a, b, pre, CASE pre WHEN 0 THEN '' WHEN 1 THEN 'b2' ELSE 'b4' END AS p FROM v)
SELECT node, CASE WHEN pre = 0 AND (a, b) >= (1, 2) THEN 'match' ELSE 'nonmatch' END AS released, CASE WHEN (a, b) > (1, 2) OR ((a, b) = (1, 2) AND pre = 0) THEN 'match' ELSE 'nonmatch' END AS with_prereleases,
CASE WHEN pre = 0 AND a = 2 AND b >= 3 OR a = 2 AND b = 3 AND pre = 2 THEN 'match' ELSE 'nonmatch' END AS npm FROM w""")
def version_prereleases(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.functions.versions import version_state

    pre = F.col("node") % 3
    n = C.dependency_nodes(spark, sf).select("node", F.concat("version", F.when(pre == 0, "").when(pre == 1, "b2").otherwise("b4")).alias("pypi"), F.concat("version", F.when(pre == 0, "").when(pre == 1, "-beta.2").otherwise("-beta.4")).alias("npm"))
    return n.select("node", version_state("pypi", ">=1.2").alias("released"), version_state("pypi", ">=1.2", prereleases=True).alias("with_prereleases"), version_state("npm", "^2.3.0-beta.3", "npm").alias("npm"))


@query("""WITH o AS (SELECT l_orderkey AS claim, l_suppkey AS v FROM lineitem) SELECT claim, CASE WHEN count(DISTINCT v) = 1 THEN 'resolved-unique' ELSE 'claim-conflict' END AS status, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS v FROM o GROUP BY claim""")
def correlated_claims(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_suppkey").alias("v"))
    return evidence.unique_claims(o, "claim", "v")


@query("""WITH own AS (SELECT l_partkey AS module, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS node FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)
SELECT DISTINCT l_orderkey AS path, node FROM lineitem JOIN own ON own.module = l_partkey WHERE l_returnflag = 'A' AND node IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def consumer_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    imports = l.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("module"))
    owners = l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("module"), F.col("l_suppkey").alias("node"))
    return evidence.consumers(imports, owners, table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node")))


@query(f"""WITH {C.DEPS_SQL} SELECT n.node, n.context, CAST(count(i.source) AS BIGINT) AS incoming, CASE WHEN n.node % 11 = 0 THEN 1 ELSE 0 END AS roots, 1 AS inventory FROM nodes n LEFT JOIN deps i ON i.target = n.node GROUP BY n.node, n.context""")
def endpoint_assembly(spark: SparkSession, sf: str) -> DataFrame:
    n = C.dependency_nodes(spark, sf).select("node", "context")
    return evidence.endpoints(n, n, C.dependency_edges(spark, sf).select(F.col("target").alias("node")), n.where("node % 11 = 0")).select("node", "context", "incoming", F.col("roots").cast("int").alias("roots"), F.col("inventory").cast("int").alias("inventory"))


EVENTS = "ev AS (SELECT event_id // 100 AS source, event_id % 100 AS seq, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS path FROM events WHERE event_id % 57 <> 9)"


@query(f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN seq - coalesce(lag(seq) OVER w, -1) <> 1 THEN 1 ELSE 0 END AS gap, CASE WHEN path = '' THEN 1 ELSE 0 END AS ok FROM ev WINDOW w AS (PARTITION BY source ORDER BY seq)),
e AS (SELECT *, sum(ok) OVER (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING) AS era FROM s), g AS (SELECT source, era, sum(CASE WHEN ok = 0 THEN gap ELSE 0 END) AS gaps, sum(1 - ok) AS pending, count(*) AS n FROM e GROUP BY 1, 2),
z AS (SELECT source, era, gaps, pending, sum(n) OVER (PARTITION BY source) AS generation, row_number() OVER (PARTITION BY source ORDER BY era DESC) AS rn FROM g)
SELECT source, CASE WHEN gaps > 0 THEN 'UNKNOWN' WHEN pending > 0 THEN 'DIRTY' ELSE 'CLEAN' END AS state, CAST(generation AS BIGINT) AS generation, CAST(pending AS BIGINT) AS pending FROM z WHERE rn = 1""")
def change_journal(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_id % 57 <> 9")
    rows = e.select(F.expr("event_id DIV 100").alias("source"), (F.col("event_id") % 100).alias("seq"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("path"))
    return J.journal_batch(rows, "source", "seq", "path")


@query("SELECT CAST(floor(epoch_ms(ts) / 60000) AS BIGINT) AS slot, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def debounced_batches(spark: SparkSession, sf: str) -> DataFrame:
    return J.debounced(table(spark, sf, "events"), "ts", "event_type", 60_000)


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS span, count(*) AS n FROM y GROUP BY user_id, s""")
def extra_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """An extra: session windows."""
    s = J.sessions(table(spark, sf, "events"), "ts", "user_id", 3600)
    return s.select("user_id", (J.epoch_micros(s, "last") - J.epoch_micros(s, "first")).alias("span"), "n")


@query(f"""WITH {C.DEPS_SQL}, m AS (SELECT node, CASE WHEN node % 4 = 0 THEN 'tests/test_m' || node || '.py' WHEN node % 4 = 1 THEN 'docs/m' || node || '.md' WHEN node % 4 = 2 THEN 'schemas/m' || node || '.json' ELSE 'src/m' || node || '.py' END AS path FROM nodes),
x AS (SELECT path, CASE node % 4 WHEN 0 THEN 'verification' WHEN 1 THEN 'orientation' WHEN 2 THEN 'contract' ELSE 'implementation' END AS role FROM m), y AS (SELECT role, path, row_number() OVER (PARTITION BY role ORDER BY path) AS rn FROM x) SELECT role, path, rn FROM y WHERE rn <= 5""")
def impact_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.functions.text import impact_role
    from strataquery.operators.topk import top_per_group

    s = F.col("node").cast("string")
    m = F.col("node") % 4
    path = F.when(m == 0, F.concat(F.lit("tests/test_m"), s, F.lit(".py"))).when(m == 1, F.concat(F.lit("docs/m"), s, F.lit(".md"))).when(m == 2, F.concat(F.lit("schemas/m"), s, F.lit(".json"))).otherwise(F.concat(F.lit("src/m"), s, F.lit(".py")))
    n = C.dependency_nodes(spark, sf).select(path.alias("path"))
    return top_per_group(n.select(impact_role(F.col("path")).alias("role"), "path"), ["role"], ["path"], 5)


@query(f"""WITH {C.LINES_SQL}, a AS (SELECT path, content, count(*) AS n, min(line) AS was_line FROM lines GROUP BY 1, 2), b AS (SELECT path, content, count(*) AS n, min(line + 2) AS now_line FROM lines WHERE line > 1 GROUP BY 1, 2)
SELECT path, was_line, CAST(now_line AS INTEGER) AS now_line FROM a JOIN b USING (path, content) WHERE a.n = 1 AND b.n = 1""")
def line_moves(spark: SparkSession, sf: str) -> DataFrame:
    l = C.lines(C.files(spark, sf))  # noqa: E741
    return evidence.line_moves(l, l.where("line > 1").withColumn("line", F.col("line") + 2))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.category_counts(table(spark, sf, "lineitem"), "l_returnflag")
