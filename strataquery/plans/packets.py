"""Queries over evidence packets, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.operators import incremental, packets
from strataquery.operators.graph import cut
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.sources import corpus as C


@query(f"WITH {C.EDGES_SQL} SELECT line, target, kind FROM edges WHERE path = 'order/42' AND (source = 'part' OR starts_with(source, 'part.')) ORDER BY line, target, kind LIMIT 5")
def edges_from_source(spark: SparkSession, sf: str) -> DataFrame:
    return packets.edges_from(C.edges(spark, sf), "order/42", "part", 5).select("line", "target", "kind")


@query("WITH c AS (SELECT o_custkey AS folder, o_orderkey AS generation, sha256(o_orderpriority) AS digest FROM orders) SELECT folder, max(generation) AS generation, arg_max(digest, generation) AS digest FROM c GROUP BY folder")
def directory_digests(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("generation"), F.sha2("o_orderpriority", 256).alias("digest"))
    return packets.latest_digests(c)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN l_suppkey > l_quantity END AS stale FROM lineitem")
def staleness_projection(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("known", F.col("l_linestatus") == "F")  # noqa: E741
    return packets.staleness(l, "l_quantity", "l_suppkey", "known").select("l_orderkey", "l_linenumber", "stale")


@query(f"""WITH {C.FILES_SQL}, s AS (SELECT doc_id AS scope, CASE WHEN doc_id % 10 = 3 THEN 'no/such' ELSE path END AS path, CAST(doc_id % 50 AS INTEGER) AS start, CAST(doc_id % 50 + 20 + doc_id % 7 AS INTEGER) AS "end" FROM files)
SELECT scope, s.path, start, "end", CASE WHEN f.path IS NULL THEN 'missing-path' WHEN "end" > strlen(text) THEN 'out-of-range' ELSE 'observed' END AS state, CASE WHEN f.path IS NOT NULL AND "end" <= strlen(text) THEN sha256(array_slice(encode(text), start + 1, "end")) END AS digest FROM s LEFT JOIN files f ON f.path = s.path""")
def observed_bindings(spark: SparkSession, sf: str) -> DataFrame:
    f, d = C.files(spark, sf), F.col("doc_id")
    s = f.select(d.alias("scope"), F.when(d % 10 == 3, "no/such").otherwise(F.col("path")).alias("path"), (d % 50).cast("int").alias("start"), (d % 50 + 20 + d % 7).cast("int").alias("end"))
    return packets.observed_spans(s, f)


FACTS = "d AS (SELECT DISTINCT p_type AS concept, p_brand AS subject, CAST(p_size % 4 AS VARCHAR) AS value, p_partkey % 2 AS side FROM part)"


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_type").alias("concept"), F.col("p_brand").alias("subject"), (F.col("p_size") % 4).cast("string").alias("value"), (F.col("p_partkey") % 2).alias("side")).distinct()


@query(f"WITH {FACTS}, p AS (SELECT DISTINCT CASE side WHEN 0 THEN 'even' ELSE 'odd' END AS provider, concept, subject, value FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY concept, subject, value) AS rn FROM p) SELECT provider, concept, subject, value, CASE WHEN rn <= 100 THEN 'qualified' ELSE 'beyond-bound' END AS state FROM r")
def provider_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return packets.discovered(spark, {name: (lambda s, k=k: _facts(s, sf).where(F.col("side") == k)) for name, k in (("even", 0), ("odd", 1))}, 100)


CLAIMS = "c AS (SELECT 'p' || l_partkey AS subject, l_linestatus AS kind, 's' || l_suppkey AS object, CASE l_returnflag WHEN 'A' THEN 'scip' ELSE 'lsp' END AS producer FROM lineitem)"


@query(f"WITH {CLAIMS} SELECT subject, kind, object, string_agg(DISTINCT producer, ',' ORDER BY producer) AS producers, count(DISTINCT producer) AS n FROM c WHERE subject = 's7' OR object = 's7' GROUP BY subject, kind, object")
def semantic_relationships(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c = l.select(text("p", "l_partkey").alias("subject"), F.col("l_linestatus").alias("kind"), text("s", "l_suppkey").alias("object"), F.when(F.col("l_returnflag") == "A", "scip").otherwise("lsp").alias("producer"))
    return packets.relationships(c, "s7")


@query("""WITH i AS (SELECT n_name AS repository, s_suppkey AS path, s_nationkey AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey), l AS (SELECT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 3 + 1) % 25),
o AS (SELECT repository, count(DISTINCT path) AS own FROM i GROUP BY 1), r AS (SELECT l.target AS repository, count(DISTINCT (i.repository, i.path)) AS linked, count(DISTINCT i.repository) AS repositories FROM l JOIN i ON i.repository = l.source GROUP BY 1)
SELECT repository, coalesce(own, 0) AS own, coalesce(linked, 0) AS linked, coalesce(repositories, 0) AS repositories FROM o FULL JOIN r USING (repository)""")
def cross_repository_impact(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    i = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("repository"), F.col("s_suppkey").alias("path"))
    links = n.select(F.col("n_name").alias("source"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("k")).join(n.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("target")), "k")
    return packets.cross_repository(i, links.select("source", "target"))


@query("WITH o AS (SELECT l_partkey AS module, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS owner FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT DISTINCT l_orderkey AS path, l_partkey AS module, CASE WHEN n IS NULL THEN 'unowned' WHEN n = 1 THEN 'qualified' ELSE 'shared' END AS state, CASE WHEN n = 1 THEN owner END AS owner FROM lineitem LEFT JOIN o ON o.module = l_partkey")
def qualified_imports(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    return packets.qualified_identity(l.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("module")), l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("module"), F.col("l_suppkey").alias("owner")))


@query("SELECT o_orderkey, sha256('context' || length(o_custkey || '') || ':' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE length(o_orderstatus) || ':' || o_orderstatus END) AS identity FROM orders")
def context_identity(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", packets.context_identity({"z": status, "a": F.col("o_custkey")}, "context").alias("identity"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'unobserved' WHEN o_orderkey % 5 = 0 THEN 'contradicted' ELSE 'confirmed' END AS state FROM orders")
def reacquired_claims(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return packets.reacquired(o, o.where(k % 7 != 0).withColumn("v", F.when(k % 5 == 0, "?").otherwise(F.col("v"))), ["k"], "v")


@query(f"WITH {FACTS}, o AS (SELECT value, count(DISTINCT subject) AS subjects, min(subject) AS first_subject FROM d WHERE concept = 'ECONOMY' GROUP BY value) SELECT *, CASE WHEN (SELECT count(*) FROM o) = 1 THEN 'sole' WHEN subjects = (SELECT max(subjects) FROM o) THEN 'leading-or-tied' ELSE 'outnumbered' END AS state FROM o")
def declaration_explain(spark: SparkSession, sf: str) -> DataFrame:
    return packets.declaration_explained(_facts(spark, sf), "ECONOMY")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS task, l_suppkey AS owner, l_suppkey % 3 AS score FROM lineitem), a AS (SELECT s_suppkey AS owner FROM supplier WHERE s_acctbal > 1000), r AS (SELECT s_suppkey AS owner, CASE WHEN s_suppkey % 22 = 0 THEN 'a-stale' ELSE 'external' END AS reason FROM supplier WHERE s_suppkey % 11 = 0),
x AS (SELECT c.*, a.owner IS NOT NULL AS ok, r.reason FROM c LEFT JOIN a USING (owner) LEFT JOIN r USING (owner)), b AS (SELECT task, max(score) AS best FROM x WHERE ok AND reason IS NULL GROUP BY task), t AS (SELECT task, count(*) AS n FROM x JOIN b USING (task) WHERE ok AND reason IS NULL AND score = best GROUP BY task),
s AS (SELECT x.task, owner, reason, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN NOT ok THEN 'not-admitted' WHEN score = best AND n = 1 THEN 'admitted' WHEN score = best THEN 'competing' ELSE 'outscored' END AS status FROM x LEFT JOIN b USING (task) LEFT JOIN t USING (task))
SELECT task, owner, status, reason, sha256('trace' || length(task || '') || ':' || task || length(owner || '') || ':' || owner || length(status) || ':' || status || coalesce(length(reason) || ':' || reason, '-')) AS proof FROM s""")
def ownership_trace(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("owner"), (F.col("l_suppkey") % 3).alias("score")).distinct()
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("owner"), "s_acctbal")
    rejected = s.where("owner % 11 = 0").select("owner", F.when(F.col("owner") % 22 == 0, "a-stale").otherwise("external").alias("reason"))
    return packets.decision_trace(c, s.where("s_acctbal > 1000"), rejected)


@query(f"WITH {C.FILES_SQL}, a AS (SELECT language, count(*) AS n FROM files GROUP BY language), b AS (SELECT language, count(*) AS n FROM files WHERE doc_id % 9 <> 0 GROUP BY language) SELECT *, 'cold' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'warm' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def cold_and_warm(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in which a written answer differs from one made anew, some files having come since."""
    from strataquery.operators.aggregate import category_counts

    files = C.files(spark, sf)
    return packets.unequal(category_counts(files, "language"), cut(category_counts(files.where("doc_id % 9 <> 0"), "language")))


@query(f"""WITH {C.DEPS_SQL}, ch AS (SELECT node AS path FROM nodes WHERE marker IS NOT NULL), e AS (SELECT DISTINCT target AS path, source AS dependent FROM deps), near AS (SELECT path, path AS dependent, 0 AS distance FROM ch UNION ALL SELECT path, dependent, 1 FROM ch JOIN e USING (path)),
v AS (SELECT DISTINCT l_partkey AS dependent, 't' || l_suppkey AS verifier FROM lineitem), f AS (SELECT path, verifier, min(distance) AS distance FROM near JOIN v USING (dependent) GROUP BY path, verifier),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY distance, verifier) AS rn, count(*) OVER (PARTITION BY path) AS total FROM f) SELECT path, verifier, distance, total FROM r WHERE rn <= 3""")
def changed_set_verification(spark: SparkSession, sf: str) -> DataFrame:
    n = C.dependency_nodes(spark, sf).where("marker IS NOT NULL").select(F.col("node").alias("path"))
    reach = C.dependency_edges(spark, sf).select(F.col("target").alias("path"), F.col("source").alias("dependent"), F.lit(1).alias("distance")).distinct()
    v = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("verifier")).distinct()
    return packets.changed_set(n, reach, v, 3)


TREE = "t AS (SELECT p_partkey AS node, p_partkey // 3 AS up, CAST(p_size AS BIGINT) AS v FROM part)"


@query(f"WITH RECURSIVE {TREE}, w AS (SELECT node AS root, node FROM t UNION ALL SELECT w.root, t.node FROM w JOIN t ON t.up = w.node AND t.node > 0 AND t.node <> w.node) SELECT root AS node, CAST(sum(v) AS BIGINT) AS value, true AS settled FROM w JOIN t ON t.node = w.node GROUP BY root")
def evaluated_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over a tree, by a caller's function, from the leaves up."""
    p = table(spark, sf, "part")
    edges = p.where("p_partkey > 0").select(F.expr("p_partkey DIV 3").alias("source"), F.col("p_partkey").alias("target"))
    nodes = p.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("v"))
    return packets.evaluated(nodes, edges, "v", lambda own, theirs: F.aggregate(theirs, own, lambda a, x: a + x), 30).drop("height")


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS node, p_partkey // 3 AS up, CAST(p_size AS BIGINT) AS was, CAST(CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_size + 40 ELSE p_size // 2 END ELSE p_size END AS BIGINT) AS now FROM part),
w AS (SELECT node AS root, node FROM t UNION ALL SELECT w.root, t.node FROM w JOIN t ON t.up = w.node AND t.node > 0 AND t.node <> w.node), v AS (SELECT root AS node, max(was) AS was, max(now) AS now FROM w JOIN t ON t.node = w.node GROUP BY root),
hit AS (SELECT node FROM t WHERE node % 7 = 0 UNION SELECT t.up FROM t JOIN v USING (node) WHERE t.node > 0 AND v.was <> v.now) SELECT node, now AS value, was <> now AS changed FROM v JOIN hit USING (node)""")
def equality_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Maxima over a tree after the values of a seventh of its nodes have changed: what is computed again ends where a
    maximum stays what it was."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    edges = p.where("p_partkey > 0").select(F.expr("p_partkey DIV 3").alias("source"), k.alias("target"))
    was = p.select(k.alias("node"), F.col("p_size").cast("long").alias("v"))
    now = p.select(k.alias("node"), F.when(k % 7 == 0, F.when(k % 2 == 0, F.col("p_size") + 40).otherwise(F.expr("p_size DIV 2"))).otherwise(F.col("p_size")).cast("long").alias("v"))
    most = lambda own, theirs: F.greatest(own, F.array_max(theirs))
    before = cut(packets.evaluated(was, edges, "v", most, 30))
    return incremental.recomputed(now, edges, before, now.where("node % 7 = 0"), "v", most)


@query(f"WITH {C.POSTINGS_SQL} SELECT token, count(DISTINCT path) AS n FROM postings GROUP BY token")
def kept_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies, first of an older state of the collection, then brought up to date by what changed since: some
    files had another text, some weren't there, some are gone."""
    files, d = C.files(spark, sf), F.col("doc_id")
    old = files.where(d % 13 != 0).withColumn("text", F.when(d % 11 == 0, F.concat(F.lit("olderWords of_the file "), F.substring("text", 1, 200))).otherwise(F.col("text")))
    gone = files.where(d % 17 == 0).withColumn("path", F.concat("path", F.lit(".bak"))).withColumn("text", F.lit("goneWord of the past"))
    old = old.unionByName(gone)
    touched = files.where((d % 11 == 0) | (d % 13 == 0)).select("path").unionByName(gone.select("path"))
    kept = incremental.KeptCounts(C.file_terms(old), ["token"])
    kept.change(C.file_terms(incremental.changed_rows(old, touched)), C.file_terms(incremental.changed_rows(files, touched)))
    return kept.df
