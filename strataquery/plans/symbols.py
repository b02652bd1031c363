"""Queries over symbols, edges and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.operators import aggregate, lookup, rank, topk
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.sources import corpus as C


@query(f"WITH {C.SYMBOLS_SQL} SELECT path, qualname, end_line - start_line AS width FROM symbols WHERE start_line <= 250 AND end_line >= 250 ORDER BY width, start_line, qualname LIMIT 20")
def symbols_containing_line(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.containing(C.symbols(spark, sf), 250).orderBy("width", "start_line", "qualname").limit(20).select("path", "qualname", "width")


@query(f"WITH {C.SYMBOLS_SQL} SELECT path, qualname FROM symbols WHERE start_line <= 120 AND end_line >= 100")
def symbols_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.overlapping(C.symbols(spark, sf), 100, 120).select("path", "qualname")


POINTS = "points AS (SELECT event_id, 'user/' || user_id AS path, CAST(event_id % 520 AS INTEGER) AS site_line FROM events)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), (F.col("event_id") % 520).cast("int").alias("site_line"))


@query(f"""WITH {C.SYMBOLS_SQL}, {POINTS}, m AS (SELECT event_id, qualname, rank() OVER (PARTITION BY event_id ORDER BY end_line - start_line) AS r FROM points p JOIN symbols s ON p.path = s.path AND site_line BETWEEN start_line AND end_line),
b AS (SELECT event_id, count(*) AS ties, min(qualname) AS q FROM m WHERE r = 1 GROUP BY event_id)
SELECT p.event_id, CASE WHEN ties IS NULL THEN 'no-containing-symbol' WHEN ties = 1 THEN 'resolved-unique' ELSE 'resolved-ambiguous' END AS status, CASE WHEN ties = 1 THEN q END AS qualname FROM points p LEFT JOIN b USING (event_id)""")
def innermost_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.innermost(_points(spark, sf), C.symbols(spark, sf), "path", "site_line", "event_id")


@query(f"""WITH {C.SYMBOLS_SQL}, a AS (SELECT path, start_line, end_line, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM symbols),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR start_line > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS i FROM a), c AS (SELECT path, i, max(end_line) - min(start_line) + 1 AS n FROM b GROUP BY path, i)
SELECT path, CAST(sum(n) AS BIGINT) AS covered, count(*) AS islands FROM c GROUP BY path""")
def interval_union_length(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.interval_union(C.symbols(spark, sf))


@query(f"WITH {C.SYMBOLS_SQL} SELECT path, qualname, CASE WHEN qualname = 'click' THEN 0 ELSE 1 END AS kind_of_match FROM symbols WHERE name = 'click' OR qualname = 'click' ORDER BY kind_of_match, path, start_line, qualname LIMIT 30")
def exact_symbol_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.exact_symbol(C.symbols(spark, sf), "click", 30).select("path", "qualname", "kind_of_match")


@query(f"WITH {C.SYMBOLS_SQL} SELECT path, qualname FROM symbols WHERE lower(name) IN ('signup', 'error') OR lower(qualname) IN ('signup', 'error')")
def exact_symbol_in(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.symbol_in(C.symbols(spark, sf), ["SignUp", "error"]).select("path", "qualname")


@query(f"""WITH {C.SYMBOLS_SQL}, {C.FILES_SQL}, u AS (SELECT path, qualname, 'symbol' AS row_type FROM symbols WHERE contains(lower(name), 'src1') OR contains(lower(qualname), 'src1') OR contains(lower(signature), 'src1') OR contains(lower(path), 'src1')
UNION ALL SELECT path, NULL, 'file' FROM files WHERE contains(lower(path), 'src1')) SELECT path, qualname, row_type FROM u ORDER BY path, row_type, coalesce(qualname, '') LIMIT 60""")
def search_candidates_union(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.indexed_candidates(C.symbols(spark, sf), C.files(spark, sf), C.grams(spark, sf), "SRC1", 60)


@query(f"WITH {C.SYMBOLS_SQL}, x AS (SELECT path, qualname, start_line, row_number() OVER (PARTITION BY path ORDER BY start_line, qualname) AS rn FROM symbols) SELECT path, qualname, start_line, rn FROM x WHERE rn <= 3")
def symbols_topn_per_path(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_per_group(C.symbols(spark, sf).select("path", "qualname", "start_line"), ["path"], ["start_line", "qualname"], 3)


@query(f"WITH {C.EDGES_SQL}, x AS (SELECT path, source, target, line FROM edges WHERE target_short = 's7' ORDER BY path, line, source LIMIT 41), y AS (SELECT *, count(*) OVER () > 40 AS truncated, row_number() OVER (ORDER BY path, line, source) AS rn FROM x) SELECT path, source, target, line, truncated FROM y WHERE rn <= 40")
def refs_topn(spark: SparkSession, sf: str) -> DataFrame:
    return topk.bounded(lookup.references(C.edges(spark, sf), "other.s7").select("path", "source", "target", "line"), ["path", "line", "source"], 40)


PREFERRED = "pref AS (SELECT DISTINCT 'order/' || o_orderkey AS path FROM orders WHERE o_orderpriority LIKE '1%')"


@query(f"""WITH {C.EDGES_SQL}, {PREFERRED}, x AS (SELECT e.target_short, e.path, e.line, e.source, p.path IS NOT NULL AS preferred, row_number() OVER (PARTITION BY target_short ORDER BY CASE WHEN p.path IS NULL THEN 0 ELSE 1 END DESC, e.path, line, source) AS rn FROM edges e LEFT JOIN pref p ON p.path = e.path)
SELECT target_short, path, line, source, preferred, rn FROM x WHERE rn <= 5""")
def refs_preferred_first(spark: SparkSession, sf: str) -> DataFrame:
    pref = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return lookup.preferred_first(C.edges(spark, sf), pref, 5).select("target_short", "path", "line", "source", "preferred", "rn")


@query(f"WITH {C.EDGES_SQL}, {PREFERRED} SELECT path, source, target_short FROM edges WHERE path IN (SELECT path FROM pref) AND target_short IN ('s1', 's2', 's3')")
def refs_scoped(spark: SparkSession, sf: str) -> DataFrame:
    pref = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return C.edges(spark, sf).where(F.col("target_short").isin("s1", "s2", "s3")).join(pref, "path", "left_semi").select("path", "source", "target_short")


@query(f"WITH {C.EDGES_SQL}, x AS (SELECT source, line, target, kind, path, row_number() OVER (PARTITION BY source ORDER BY line, target, kind, path) AS rn FROM edges WHERE source LIKE 'part.1%') SELECT source, line, target, kind, path, rn FROM x WHERE rn <= 4")
def edges_topn_per_seed(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_per_group(C.edges(spark, sf).where(F.col("source").startswith("part.1")).select("source", "line", "target", "kind", "path"), ["source"], ["line", "target", "kind", "path"], 4)


@query(f"WITH {C.EDGES_SQL}, x AS (SELECT path, line, target, kind, row_number() OVER (PARTITION BY path ORDER BY line, target, kind) AS rn FROM edges) SELECT path, line, target, kind, rn FROM x WHERE rn <= 2")
def edges_topn_per_path(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_per_group(C.edges(spark, sf).select("path", "line", "target", "kind"), ["path"], ["line", "target", "kind"], 2)


@query(f"WITH {C.EDGES_SQL} SELECT target, count(*) AS n FROM edges GROUP BY target ORDER BY n DESC, target LIMIT 20")
def top_targets(spark: SparkSession, sf: str) -> DataFrame:
    return C.edges(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(20)


@query(f"WITH {C.EDGES_SQL}, t AS (SELECT path, kind, count(*) AS n FROM edges GROUP BY path, kind), x AS (SELECT path, kind, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, path) AS rn FROM t), o AS (SELECT kind, greatest(count(*) - 10, 0) AS omitted FROM t GROUP BY kind) SELECT kind, path, n, rn, omitted FROM x JOIN o USING (kind) WHERE rn <= 10")
def bounded_rerank(spark: SparkSession, sf: str) -> DataFrame:
    t = C.edges(spark, sf).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    return topk.with_omissions(t, ["kind"], [F.desc("n"), "path"], 10)


@query(f"""WITH {C.SYMBOLS_SQL}, {POINTS}, m AS (SELECT s.path, s.qualname, site_line, row_number() OVER (PARTITION BY p.path, site_line ORDER BY end_line - start_line, qualname) AS close FROM points p JOIN symbols s ON p.path = s.path AND site_line BETWEEN start_line AND end_line),
f AS (SELECT path, qualname, site_line, row_number() OVER (PARTITION BY path, qualname ORDER BY site_line) AS site FROM m WHERE close = 1) SELECT path, qualname, site_line FROM f WHERE site = 1""")
def declaration_context(spark: SparkSession, sf: str) -> DataFrame:
    """The innermost symbol of each site, then each symbol's first site."""
    found = lookup.interval_join(_points(spark, sf).select("path", "site_line"), C.symbols(spark, sf), "path", "site_line").withColumn("_w", F.col("end_line") - F.col("start_line"))
    inner = topk.best_per_group(found, ["path", "site_line"], ["_w", "qualname"])
    return topk.best_per_group(inner, ["path", "qualname"], ["site_line"]).select("path", "qualname", "site_line")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def json_relationships(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return e.where(F.col("k").between(10, 20))


@query(f"""WITH {C.EDGES_SQL}, e AS (SELECT DISTINCT source, string_split(target, '.') AS t FROM edges), m AS (SELECT DISTINCT 'supplier' AS module UNION SELECT DISTINCT target FROM edges WHERE target_short LIKE 's1%')
SELECT n.name, arg_max(module, length(module)) AS module, CAST(max(length(n.name) - length(replace(n.name, '.', ''))) - max(length(module) - length(replace(module, '.', ''))) AS INTEGER) AS dropped FROM (SELECT DISTINCT target || '.attr' AS name FROM edges) n JOIN m ON n.name = module OR starts_with(n.name, module || '.') GROUP BY n.name""")
def module_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    e = C.edges(spark, sf)
    modules = e.where(F.col("target_short").startswith("s1")).select(F.col("target").alias("module")).distinct().union(spark.range(1).select(F.lit("supplier").alias("module")))
    names = e.select(F.concat("target", F.lit(".attr")).alias("name")).distinct()
    return lookup.longest_prefix(names, modules, "name", "module")


@query(f"""WITH {C.SYMBOLS_SQL}, s AS (SELECT path, qualname, name,
(CASE WHEN lower(qualname) = 'click user' THEN 120 ELSE 0 END) + (CASE WHEN lower(name) = 'click user' THEN 100 ELSE 0 END)
+ (CASE WHEN name = 'click' THEN 30 WHEN contains(name, 'click') THEN 20 ELSE 0 END) + (CASE WHEN contains(path, 'click') THEN 12 ELSE 0 END) + (CASE WHEN contains(qualname, 'click') THEN 15 ELSE 0 END) + (CASE WHEN contains(lower(signature), 'click') THEN 8 ELSE 0 END)
+ (CASE WHEN name = 'user' THEN 30 WHEN contains(name, 'user') THEN 20 ELSE 0 END) + (CASE WHEN contains(path, 'user') THEN 12 ELSE 0 END) + (CASE WHEN contains(qualname, 'user') THEN 15 ELSE 0 END) + (CASE WHEN contains(lower(signature), 'user') THEN 8 ELSE 0 END)
AS score, start_line FROM symbols) SELECT path, qualname, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, path, start_line, qualname LIMIT 50""")
def score_find(spark: SparkSession, sf: str) -> DataFrame:
    s = C.symbols(spark, sf).withColumn("score", rank.score("click user"))
    return s.where("score > 0").orderBy(F.desc("score"), "path", "start_line", "qualname").limit(50).select("path", "qualname", "score")


@query(f"WITH {C.SYMBOLS_SQL}, {C.EDGES_SQL}, {C.FILES_SQL} SELECT 'symbol' AS name, count(*) AS n FROM symbols UNION ALL SELECT 'edge', count(*) FROM edges UNION ALL SELECT 'edge_final', count(*) FROM edges WHERE confidence = 'F' UNION ALL SELECT 'file', count(*) FROM files")
def table_stats(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    e = C.edges(spark, sf)
    return one("symbol", C.symbols(spark, sf)).union(one("edge", e)).union(one("edge_final", e.where("confidence = 'F'"))).union(one("file", C.files(spark, sf)))


@query(f"WITH {C.EDGES_SQL}, {C.SYMBOLS_SQL} SELECT path, count(*) AS n FROM (SELECT path, qualname FROM symbols WHERE name = 'click' OR qualname LIKE 'error.1%') GROUP BY path")
def visible_matches(spark: SparkSession, sf: str) -> DataFrame:
    s = C.symbols(spark, sf)
    return s.where((F.col("name") == "click") | F.col("qualname").startswith("error.1")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {C.SYMBOLS_SQL}, x AS (SELECT path, qualname, end_line - start_line AS width FROM symbols), b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY width DESC, path, qualname) AS rn FROM x), r AS (SELECT path, qualname, width FROM b WHERE rn = 1 ORDER BY width DESC, path, qualname LIMIT 20), f AS (SELECT path, qualname, width FROM x ORDER BY width DESC, path, qualname LIMIT 60),
u AS (SELECT *, 0 AS tier FROM r UNION ALL SELECT *, 1 FROM f), g AS (SELECT path, qualname, width, min(tier) AS tier FROM u GROUP BY ALL) SELECT path, qualname, width, tier FROM g ORDER BY tier, width DESC, path, qualname LIMIT 40""")
def path_diverse_topk(spark: SparkSession, sf: str) -> DataFrame:
    s = C.symbols(spark, sf).select("path", "qualname", (F.col("end_line") - F.col("start_line")).alias("width"))
    return topk.path_diverse(s, "path", "width", ["qualname"], 40, 20)


@query(f"WITH {C.SYMBOLS_SQL}, x AS (SELECT path, name, start_line, row_number() OVER (PARTITION BY path, name ORDER BY start_line, qualname) AS n FROM symbols) SELECT path, CASE WHEN n = 1 THEN name ELSE name || '@L' || start_line || CASE WHEN n > 2 THEN '-' || n ELSE '' END END AS unique_name, n FROM x")
def unique_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("path", "name").orderBy("start_line", "qualname"))
    s = C.symbols(spark, sf).withColumn("n", n)
    suffix = F.when(F.col("n") > 2, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")
    return s.select("path", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("@L"), F.col("start_line").cast("string"), suffix)).alias("unique_name"), "n")


@query(f"""WITH {C.EDGES_SQL}, x AS (SELECT view, path, min(r) AS first FROM (SELECT kind AS view, path, row_number() OVER (PARTITION BY kind ORDER BY line, path, source, target) AS r FROM edges) GROUP BY view, path), y AS (SELECT view, path, row_number() OVER (PARTITION BY view ORDER BY first, path) AS path_rank FROM x) SELECT view, path, path_rank FROM y WHERE path_rank <= 50""")
def first_seen_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = C.edges(spark, sf).select(F.col("kind").alias("view"), "path", F.struct("line", "path", "source", "target").alias("r"))
    return topk.first_seen_rank(e, ["view"], "path", "r").where("path_rank <= 50")
