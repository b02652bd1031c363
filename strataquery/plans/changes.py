"""Queries over values and changes of evidence, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.functions import jsons as J
from strataquery.functions import values as V
from strataquery.operators import changes, dependency
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.sources import corpus as C

SIDES = """x AS (SELECT o_orderkey AS k, o_orderstatus AS definition, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderpriority END AS resolution, CAST(o_custkey AS VARCHAR) AS inputs FROM orders WHERE o_orderkey % 6 <> 0),
y AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS definition, CASE WHEN o_orderkey % 8 > 1 THEN o_orderpriority END AS resolution, CAST(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS inputs FROM orders WHERE o_orderkey % 7 <> 0)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    x = o.where(k % 6 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("definition"), F.when(k % 4 != 1, F.col("o_orderpriority")).alias("resolution"), F.col("o_custkey").cast("string").alias("inputs"))
    y = o.where(k % 7 != 0).select(k.alias("k"), F.when(k % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("definition"), F.when(k % 8 > 1, F.col("o_orderpriority")).alias("resolution"), (F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0)).cast("string").alias("inputs"))
    return x, y


def _axis(a: str) -> str:
    return f"SELECT k, '{a}' AS axis, CASE WHEN x.{a} IS NULL AND y.{a} IS NULL THEN 'unknown' WHEN x.{a} IS NULL OR y.{a} IS NULL THEN 'not-comparable' WHEN x.{a} = y.{a} THEN 'unchanged' ELSE 'changed' END AS state FROM x JOIN y USING (k)"


@query(f"WITH {SIDES} " + " UNION ALL ".join(map(_axis, ("definition", "resolution", "inputs"))))
def change_axes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.change_axes(*_sides(spark, sf), "k", ["definition", "resolution", "inputs"])


JSONS = """e AS (SELECT event_id AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS n, event_id % 3 AS m FROM events),
d AS (
SELECT k, '/n' AS path, 'replace' AS op, CAST(n + 1 AS VARCHAR) AS value FROM e WHERE k % 5 = 0
UNION ALL SELECT k, '/in/m', CASE WHEN k % 4 = 1 THEN 'replace' ELSE 'delete' END, CASE WHEN k % 4 = 1 THEN '"' || m || '"' END FROM e WHERE k % 4 < 2
UNION ALL SELECT k, '/in/t', 'replace', '[' || m || ',2' || CASE WHEN k % 7 = 0 THEN '.0' ELSE ',null' END || ']' FROM e WHERE k % 7 < 2
UNION ALL SELECT k, '/w', 'add', '{"x":[],"y":"{z"}' FROM e WHERE k % 11 = 0
UNION ALL SELECT k, '/a~1b~0', 'delete', NULL FROM e WHERE k % 13 = 0 UNION ALL SELECT k, '/a', 'add', '{"b~":null}' FROM e WHERE k % 13 = 0
UNION ALL SELECT k, '/f', 'replace', CASE k % 17 WHEN 0 THEN '1' WHEN 1 THEN '100.0' ELSE '{}' END FROM e WHERE k % 17 < 3)"""


@query(f"""WITH {JSONS} SELECT k, path, op, value FROM d WHERE k % 19 > 2 UNION ALL SELECT k, '', CASE k % 19 WHEN 0 THEN 'not-json' WHEN 1 THEN 'delete' ELSE 'add' END, CASE WHEN k % 19 = 2 THEN '[' || n || ']' END FROM e WHERE k % 19 < 3""")
def semantic_change_set(spark: SparkSession, sf: str) -> DataFrame:
    """Documents before and after: numbers that change value or only their kind or their writing, keys in another order,
    names with slashes, texts that look like objects, documents that come, go or aren't JSON."""
    k = F.col("k")
    e = table(spark, sf, "events").select(F.col("event_id").alias("k"), F.from_json("props", "k long")["k"].alias("n"), (F.col("event_id") % 3).alias("m"))
    before = e.where("k % 19 <> 2").select("k", F.format_string('{"n": %d, "in": {"m": %d, "t": [%d,2]}, "f": 1.0, "a/b~": null, "s": "{x"}', "n", "m", "m").alias("value"))
    m = F.when(k % 4 == 0, "").when(k % 4 == 1, F.format_string('"m": "%d",', "m")).otherwise(F.format_string('"m":%d,', "m"))
    t = F.concat(F.lit("["), F.col("m").cast("string"), F.when(k % 7 == 0, ",2.0]").when(k % 7 == 1, ",2,null]").otherwise(", 2 ]"))
    f = F.when(k % 17 == 0, "1").when(k % 17 == 1, "1e2").when(k % 17 == 2, "{}").otherwise("1.00")
    parts = [F.lit('{"s":"\\u007bx","in":{'), m, F.lit('"t":'), t, F.lit('},"f":'), f, F.when(k % 11 == 0, ',"w":{"y":"{z","x":[]}').otherwise(""), F.when(k % 13 == 0, ',"a":{"b~":null}').otherwise(',"a/b~":null'), F.lit(',"n":'), (F.col("n") + (k % 5 == 0).cast("long")).cast("string"), F.when(k % 19 == 0, ",,}").otherwise("}")]
    after = e.where("k % 19 <> 1").select("k", F.when(k % 19 == 2, F.format_string("[%d]", "n")).otherwise(F.concat(*parts)).alias("value"))
    return changes.semantic_changes(before, after, "k", "value")


BIND = "p AS (SELECT l_orderkey AS scope, l_linenumber AS ordinal, min(l_returnflag) AS state, min(l_suppkey) AS target FROM lineitem GROUP BY 1, 2), q AS (SELECT scope, ordinal, CASE WHEN scope % 9 = 0 THEN 'Z' ELSE state END AS state, target + CASE WHEN scope % 5 = 0 THEN 1 ELSE 0 END AS target FROM p WHERE scope % 4 <> 0), p2 AS (SELECT * FROM p WHERE ordinal <> 3)"


@query(f"WITH {BIND} SELECT scope, ordinal, CASE WHEN p2.state IS NULL THEN 'added' WHEN q.state IS NULL THEN 'removed' WHEN p2.state <> q.state THEN 'state-changed' WHEN p2.target <> q.target THEN 'changed' ELSE 'unchanged' END AS status FROM p2 FULL JOIN q USING (scope, ordinal)")
def binding_delta(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("ordinal")).agg(F.min("l_returnflag").alias("state"), F.min("l_suppkey").alias("target"))
    s = F.col("scope")
    q = p.where(s % 4 != 0).select("scope", "ordinal", F.when(s % 9 == 0, "Z").otherwise(F.col("state")).alias("state"), (F.col("target") + F.when(s % 5 == 0, 1).otherwise(0)).alias("target"))
    return changes.binding_delta(p.where("ordinal <> 3"), q, ["scope", "ordinal"], "state", ["target"])


DECL = "d AS (SELECT p_type AS concept, p_brand AS subject, p_size % 4 AS value, p_partkey AS k FROM part), d1 AS (SELECT concept, subject, list_sort(list_distinct(list(value))) AS was FROM d WHERE k % 3 <> 0 GROUP BY 1, 2), d2 AS (SELECT concept, subject, list_sort(list_distinct(list(value))) AS now FROM d WHERE k % 5 <> 0 GROUP BY 1, 2)"


@query(f"WITH {DECL} SELECT concept, count(*) FILTER (WHERE was IS NULL) AS subjects_added, count(*) FILTER (WHERE now IS NULL) AS subjects_removed, count(*) FILTER (WHERE was <> now) AS values_changed, count(*) FILTER (WHERE was = now) AS unchanged FROM d1 FULL JOIN d2 USING (concept, subject) GROUP BY concept")
def declaration_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "part").select(F.col("p_type").alias("concept"), F.col("p_brand").alias("subject"), (F.col("p_size") % 4).alias("value"), "p_partkey")
    return changes.declaration_delta(d.where("p_partkey % 3 <> 0"), d.where("p_partkey % 5 <> 0"), "concept")


CLAIMS = "c AS (SELECT DISTINCT l_returnflag AS producer, l_partkey AS subject, l_suppkey AS object FROM lineitem), c1 AS (SELECT * FROM c WHERE subject % 3 <> 0), c2 AS (SELECT * FROM c WHERE object % 4 <> 0)"


@query(f"WITH {CLAIMS}, j AS (SELECT coalesce(c1.producer, c2.producer) AS producer, c1.subject AS l, c2.subject AS r FROM c1 FULL JOIN c2 ON c1.producer = c2.producer AND c1.subject = c2.subject AND c1.object = c2.object) SELECT producer, count(*) FILTER (WHERE l IS NULL) AS added, count(*) FILTER (WHERE r IS NULL) AS removed, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS kept FROM j GROUP BY producer")
def claim_delta(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("producer"), F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"))
    return changes.claim_delta(c.where("subject % 3 <> 0"), c.where("object % 4 <> 0"), ["subject", "object"])


@query(f"WITH {C.DEPS_SQL}, b AS (SELECT source, count(DISTINCT target) AS n FROM deps WHERE target % 3 <> 0 GROUP BY source), a AS (SELECT source, count(DISTINCT target) AS n FROM deps WHERE target % 5 <> 0 GROUP BY source) SELECT node, coalesce(b.n, 0) AS was, coalesce(a.n, 0) AS now, CASE WHEN marker IS NULL THEN coalesce(a.n, 0) - coalesce(b.n, 0) END AS difference, CASE WHEN marker IS NOT NULL THEN 'truncated-endpoint' END AS reason FROM nodes LEFT JOIN b ON b.source = node LEFT JOIN a ON a.source = node")
def locality_delta(spark: SparkSession, sf: str) -> DataFrame:
    e = C.dependency_edges(spark, sf)
    n = C.dependency_nodes(spark, sf).select("node", F.col("marker").isNull().alias("comparable"))
    return changes.locality_delta(e.where("target % 3 <> 0"), e.where("target % 5 <> 0"), n)


@query("SELECT 'only-recomputed' AS side, o_orderkey AS k, 'changed' AS status FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'only-retained', o_orderkey, 'unchanged' FROM orders WHERE o_orderkey % 50 = 0")
def delta_replay(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    status = F.when(F.col("k") % 5 == 0, "changed").otherwise("unchanged")
    kept = F.when(F.col("k") % 50 == 0, "unchanged").otherwise(status)
    return dependency.replayed(o.withColumn("status", kept), o.withColumn("status", status)).select("side", "k", "status")


@query("""SELECT o_orderkey, '{"a":' || o_custkey || ',"b":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || ',"z":' || o_orderkey || '}' AS json FROM orders""")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", V.canonical_json({"z": F.col("o_orderkey"), "b": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), "a": F.col("o_custkey")}).alias("json"))


@query("SELECT event_id, (event_id - 100) BETWEEN 0 AND 9007199254740991 AS portable, trim(CASE event_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN '' ELSE event_type END) <> '' AS said FROM events")
def portable_scalars(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", V.portable_integer(i - 100).alias("portable"), V.nonblank(F.when(i % 3 == 0, "  ").when(i % 3 == 1, "").otherwise(F.col("event_type"))).alias("said"))


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN event_type = 'view' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE amount = floor(amount) END AS same, CASE event_id % 8 WHEN 3 THEN 'array' WHEN 4 THEN 'string' WHEN 5 THEN NULL WHEN 7 THEN 'float' ELSE 'object' END AS kind FROM (SELECT event_id, event_type, CAST(value AS DECIMAL(12, 2)) AS amount FROM events)")
def json_values_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Documents made of each event, against the same in another writing or with a small change: keys in another order,
    1.50 for 1.5, an integer for a float, another order in an array, escapes, what isn't JSON."""
    i, amount = F.col("event_id"), F.col("value").cast("decimal(12, 2)")
    kind, whole = F.col("event_type"), F.floor(amount).cast("string")
    pick = lambda *cases: F.element_at(F.array(*cases), (i % 8 + 1).cast("int"))
    doc = F.concat(F.lit('{"p":'), "props", F.lit(',"t":"'), kind, F.lit('","v":'), amount.cast("string"), F.lit("}"))
    turned = F.concat(F.lit('{ "v":'), amount.cast("string"), F.lit('0, "t" : "'), kind, F.lit('","p":'), "props", F.lit("}"))
    left = pick(doc, doc, F.lit('{"v":1}'), F.concat(F.lit("[1,"), i.cast("string"), F.lit(",null]")), F.concat(F.lit('"'), kind, F.lit('"')), F.lit("[1,,}"), doc, amount.cast("string"))
    right = pick(doc, turned, F.lit('{"v":1.0}'), F.concat(F.lit("[null,"), i.cast("string"), F.lit(",1]")), F.lit('"\\u0076iew"'), F.lit("[1,,}"), F.concat(doc, F.lit(" x")), F.concat(whole, F.lit(".0")))
    return table(spark, sf, "events").select("event_id", J.json_equal(left, right).alias("same"), J.kind_of(left).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, l_partkey + 1099511627776 * l_linenumber + 4503599627370496 * (l_suppkey % 200) AS packed, l_partkey AS size, CAST(l_linenumber AS BIGINT) AS mode, l_suppkey % 200 AS flags FROM lineitem")
def packed_metadata(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.pack_metadata(F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey") % 200).alias("packed"))  # noqa: E741
    return l.select("*", V.unpack_metadata(F.col("packed")).alias("u")).select("l_orderkey", "l_linenumber", "packed", "u.size", "u.mode", "u.flags")


@query("SELECT p_partkey, array_to_string(list_distinct_in_order, '|') AS terms FROM (SELECT p_partkey, [w || 'Of' || upper(v[1]) || v[2:], w || '_of_' || v, w || '-of-' || v, upper(w[1]) || w[2:] || 'Of' || upper(v[1]) || v[2:]] AS list_distinct_in_order FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS w, string_split(p_name, ' ')[2] AS v FROM part))")
def symbolic_terms(spark: SparkSession, sf: str) -> DataFrame:
    word = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(V.symbolic_terms(F.concat(word[0], F.lit("Of"), F.initcap(word[1]))), "|").alias("terms"))


PATHS = ["src/a.py", "tests/a.py", "docs/x.txt", "README.md", "package.json", "web/x.spec.ts", "gen/q.go", "locale/de.po", "x/y.bin", "cfg.yaml", "package-lock.json", "src/test_x.rs", "a/test_x.rs", "api/openapi-3.yml", "t/__snapshots__/a.ts", "fixtures/a.py", "b.lock", "x/foo_generated.py"]
LABELS = ["source", "test", "docs", "docs", "config", "test", "generated", "translation", "other", "config", "lockfile", "source", "test", "openapi", "snapshot", "fixture", "lockfile", "generated"]


@query(f"SELECT surface, count(*) AS n FROM (SELECT {LABELS}[event_id % {len(PATHS)} + 1] AS surface FROM events) GROUP BY surface")
def surface_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("event_id") % len(PATHS) + 1).cast("int"))
    return table(spark, sf, "events").select(V.surface_of(path).alias("surface")).groupBy("surface").agg(F.count(F.lit(1)).alias("n"))
