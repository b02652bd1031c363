"""Queries over point reads, predicates, bindings and context, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.functions import text as T
from strataquery.operators import binding, context, delta, lookup, topk
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.sources import corpus as C
from strataquery.streaming.journal import epoch_micros


def _str(letter: str, column: str) -> F.Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


@query(f"WITH {C.FILES_SQL} SELECT path, language, full_tokens FROM files WHERE path IN ('src0/fr/0.txt', 'src3/en/3.txt', 'no/such')")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return C.files(spark, sf).where(F.col("path").isin("src0/fr/0.txt", "src3/en/3.txt", "no/such")).select("path", "language", "full_tokens")


@query(f"WITH {C.EDGES_SQL} SELECT path, source, kind, target, line FROM edges")
def full_scan(spark: SparkSession, sf: str) -> DataFrame:
    return C.edges(spark, sf).select("path", "source", "kind", "target", "line")


@query(f"WITH {C.EDGES_SQL} SELECT path, target, line FROM edges WHERE target = 'supplier.s7' OR starts_with(target, 'supplier.s7.') OR target = 'supplier.s1' OR starts_with(target, 'supplier.s1.')")
def module_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return C.edges(spark, sf).where(lookup.under_module("target", ["supplier.s7", "supplier.s1"])).select("path", "target", "line")


@query("SELECT event_id, user_id FROM events WHERE (contains(lower(event_type), 'sign') OR contains(lower(props), '\"k\": 42')) AND user_id % 2 = 0 AND value > 5")
def dynamic_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    terms = lookup.any_term("event_type", ["SIGN"]) | lookup.any_term("props", ['"k": 42'])
    return e.where(lookup.all_of(terms, F.col("user_id") % 2 == 0, None, F.col("value") > 5)).select("event_id", "user_id")


@query("WITH r AS (SELECT event_id, [{'s': event_type, 'k': 'a'}, {'s': 'local ' || user_id, 'k': 'b'}, {'s': 'u' || user_id % 50, 'k': 'c'}] AS rel FROM events), x AS (SELECT event_id, unnest(rel) AS r FROM r) SELECT DISTINCT event_id, r.s AS symbol, r.k AS kind FROM x WHERE r.s IN ('click', 'u7', 'local 3') AND r.s NOT LIKE 'local %'")
def lateral_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols mentioned in a JSON array of each row."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    one = lambda s, k: F.struct(s.alias("s"), F.lit(k).alias("k"))
    packed = e.select("event_id", F.to_json(F.array(one(F.col("event_type"), "a"), one(_str("local ", "user_id"), "b"), one(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")), "c"))).alias("json"))
    rows = packed.select("event_id", F.explode(F.from_json("json", "array<struct<s:string,k:string>>")).alias("r"))
    return rows.where(F.col("r.s").isin("click", "u7", "local 3") & ~F.col("r.s").startswith("local ")).select("event_id", F.col("r.s").alias("symbol"), F.col("r.k").alias("kind")).distinct()


@query(f"WITH {C.SYMBOLS_SQL}, v AS (SELECT 'user/' || user_id AS path, CASE WHEN count(*) % 5 = 0 THEN 'deny' ELSE 'source' END AS evidence_visibility FROM events GROUP BY 1) SELECT path, count(*) AS n FROM symbols JOIN v USING (path) WHERE evidence_visibility <> 'deny' AND name = 'click' GROUP BY path")
def visible_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of files that may be shown."""
    s = C.symbols(spark, sf)
    v = s.groupBy("path").agg(F.when(F.count(F.lit(1)) % 5 == 0, "deny").otherwise("source").alias("evidence_visibility"))
    return s.where("name = 'click'").join(v.where("evidence_visibility <> 'deny'"), "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


PATHS = ["src/a.py", "tests/test_a.py", "docs/x.md", "pyproject.toml", ".github/workflows/ci.yml", "schemas/o.json", "docs/tests/x.proto", "x/AGENTS.md"]
ROLES = ["implementation", "test", "documentation", "build_config", "ci", "contract", "test,documentation,contract", "documentation"]
LANGS = ["python", "python", "markdown", "toml", "yaml", "json", "text", "markdown"]
MODULES = ["a", "tests.test_a", None, None, None, None, None, None]


def _sql(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"SELECT event_id, {_sql(PATHS)}[event_id % 8 + 1] AS path, {_sql(ROLES)}[event_id % 8 + 1] AS roles, {_sql(LANGS)}[event_id % 8 + 1] AS language, {_sql(MODULES)}[event_id % 8 + 1] AS module, event_id % 8 = 7 AS instruction FROM events")
def path_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, PATHS)), (F.col("event_id") % 8 + 1).cast("int")).alias("path"))
    path = F.col("path")
    return p.select("event_id", "path", F.array_join(T.path_roles(path), ",").alias("roles"), T.language_of(path).alias("language"), T.module_name(path).alias("module"), path.rlike(r"(^|/)AGENTS(\.override)?\.md$").alias("instruction"))


@query(f"WITH x AS (SELECT event_id, {_sql(['./a//b/', 'a/./b', '/abs', 'a/../b', 'a\\b', 'a/b'])}[event_id % 6 + 1] AS raw FROM events) SELECT event_id, CASE event_id % 6 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'a/b' END AS path FROM x")
def normal_paths(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["./a//b/", "a/./b", "/abs", "a/../b", "a\\b", "a/b"])), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", T.normal_path(raw).alias("path"))


@query(f"WITH {C.SYMBOLS_SQL}, f AS (SELECT 'user/' || user_id AS path, max(ts) AS changed FROM events GROUP BY 1) SELECT s.path, qualname, CAST(epoch_us(changed) AS BIGINT) AS changed FROM symbols s JOIN f USING (path) WHERE s.path IN ('user/3', 'user/8')")
def symbols_of_files(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    f = e.groupBy(_str("user/", "user_id").alias("path")).agg(F.max(epoch_micros(e, "ts")).alias("changed"))
    return C.symbols(spark, sf).where(F.col("path").isin("user/3", "user/8")).join(f, "path").select("path", "qualname", "changed")


@query(f"WITH {C.FILES_SQL}, t AS (SELECT unnest(['licensed under', 'copyright', 'warranty']) AS term) SELECT path, term FROM files JOIN t ON contains(lower(text), term)")
def contained_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = spark.createDataFrame([("licensed under",), ("copyright",), ("warranty",)], "term string")
    return lookup.contains_join(C.files(spark, sf).select("path", "text"), F.col("text"), terms, "term").select("path", "term")


SPEC = "s AS (SELECT DISTINCT 'lib/m' || l_partkey % 90 AS specifier FROM lineitem), f AS (SELECT 'lib/m' || p_partkey || ['.ts', '/index.js', '.jsx'][p_partkey % 3 + 1] AS path FROM part), e AS (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS ending, generate_subscripts(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'], 1) AS ord)"


@query(f"WITH {SPEC} SELECT specifier, arg_min(path, ord) AS path FROM s, e JOIN f ON f.path = s.specifier || e.ending GROUP BY specifier")
def script_specifiers(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select(F.concat(F.lit("lib/m"), (F.col("l_partkey") % 90).cast("string")).alias("specifier")).distinct()
    f = table(spark, sf, "part").select(F.concat(F.lit("lib/m"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, [".ts", "/index.js", ".jsx"])), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("path"))
    tried = s.select("specifier", F.posexplode(lookup.script_candidates(F.col("specifier"))).alias("ord", "path"))
    return tried.join(f, "path").groupBy("specifier").agg(F.min_by("path", "ord").alias("path"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'new/' || l_partkey WHEN l_returnflag = 'N' THEN 'pkg/n/' || l_partkey END AS path FROM lineitem")
def mapped_paths(spark: SparkSession, sf: str) -> DataFrame:
    old = F.concat(F.when(F.col("l_returnflag") == "A", "old/a/").when(F.col("l_returnflag") == "N", "old/").otherwise("other/"), F.when(F.col("l_returnflag") == "N", "n/").otherwise(""), F.col("l_partkey").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", lookup.mapped_path(old, [("old/a/", "new/"), ("old/", "pkg/")]).alias("path"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS path, l_suppkey % 40 AS short, l_linenumber AS line FROM lineitem), s AS (SELECT s_suppkey AS to_path, s_suppkey % 60 AS name, s_nationkey AS q FROM supplier), i AS (SELECT DISTINCT l_orderkey AS path, l_suppkey AS to_path FROM lineitem WHERE l_returnflag = 'A'),
r AS (SELECT c.*, s.to_path, q, CASE WHEN i.path IS NOT NULL THEN 2 ELSE 3 END AS rule FROM c JOIN s ON s.name = c.short LEFT JOIN i ON i.path = c.path AND i.to_path = s.to_path), m AS (SELECT path, short, line, min(rule) AS rule FROM r GROUP BY ALL), b AS (SELECT path, short, line, m.rule, count(*) AS n, min(to_path) AS to_path FROM m JOIN r USING (path, short, line, rule) GROUP BY ALL)
SELECT c.path, c.short, c.line, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE rule WHEN 2 THEN 'import' WHEN 3 THEN 'unique' END AS rule, CASE WHEN n = 1 THEN to_path END AS to_path FROM c LEFT JOIN b USING (path, short, line)""")
def bound_calls(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    calls = l.select(_str("o", "l_orderkey").alias("path"), F.lit(None).cast("string").alias("source"), F.concat(F.lit("m.n"), (F.col("l_suppkey") % 40).cast("string")).alias("target"), F.col("l_linenumber").alias("line")).distinct()
    symbols = table(spark, sf, "supplier").select(_str("s", "s_suppkey").alias("path"), F.concat(F.lit("n"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), F.concat(F.lit("q."), F.col("s_suppkey").cast("string")).alias("qualname"))
    imports = l.where("l_returnflag = 'A'").select(_str("o", "l_orderkey").alias("source"), _str("s", "l_suppkey").alias("target")).distinct()
    bound = binding.bind_calls(calls, symbols, imports)
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    return bound.select(number("path").alias("path"), number("target").alias("short"), "line", "status", "rule", F.when(F.col("to_path").isNotNull(), number("to_path")).alias("to_path"))


@query(f"WITH {C.SYMBOLS_SQL}, x AS (SELECT kind AS module, path, qualname, row_number() OVER (PARTITION BY kind ORDER BY end_line - start_line DESC, path, qualname) AS rn FROM symbols) SELECT module, path, qualname, rn FROM x WHERE rn <= 20")
def module_top20(spark: SparkSession, sf: str) -> DataFrame:
    s = C.symbols(spark, sf).select(F.col("kind").alias("module"), "path", "qualname", (F.col("end_line") - F.col("start_line")).alias("w"))
    return topk.top_per_group(s, ["module"], [F.desc("w"), "path", "qualname"], 20).select("module", "path", "qualname", "rn")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS producer FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey + 1, 'R' FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1")
def producer_replace(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("producer"))  # noqa: E741
    new = l.where("producer = 'R' AND l_linenumber = 1").withColumn("l_suppkey", F.col("l_suppkey") + 1)
    return delta.replace_children(l, new, ["producer"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def deleted_paths(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")  # noqa: E741
    return delta.delete_paths(l, table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


IMPORTS = "f AS (SELECT 'm' || p_partkey || '.py' AS path, 'pkg.m' || p_partkey AS module FROM part), e AS (SELECT DISTINCT 'm' || l_suppkey || '.py' AS path, 'pkg.m' || l_partkey || '.name' AS name FROM lineitem)"


@query(f"""WITH {IMPORTS} SELECT DISTINCT e.path AS source, f.path AS target FROM e JOIN f ON e.name = f.module || '.name' WHERE e.path <> f.path
UNION SELECT 'web/s' || l_suppkey || '.ts', 'web/' || CASE WHEN l_partkey % 2 = 0 THEN 's' || l_partkey || '.ts' ELSE 's' || l_partkey || '/index.js' END FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey <> l_partkey OR l_partkey % 2 = 1
UNION SELECT 'native/' || s_nationkey, 'm' || s_suppkey || '.py' FROM supplier""")
def file_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Python imports, half of them relative, scripts' relative specifiers with and without an ending, native edges."""
    p, l = table(spark, sf, "part"), table(spark, sf, "lineitem")  # noqa: E741
    even = F.col("p_partkey") % 2 == 0
    files = p.select(F.concat(_str("m", "p_partkey"), F.lit(".py")).alias("path"), _str("pkg.m", "p_partkey").alias("module_name"))
    scripts = p.select(F.concat(_str("web/s", "p_partkey"), F.when(even, ".ts").otherwise("/index.js")).alias("path"), F.lit(None).cast("string").alias("module_name"))
    kind, own = F.lit("import").alias("kind"), F.concat(_str("m", "l_suppkey"), F.lit(".py"))
    imports = l.select(own.alias("path"), kind, F.concat(F.when(F.col("l_linenumber") % 2 == 0, ".").otherwise("pkg."), _str("m", "l_partkey"), F.lit(".name")).alias("target"))
    specifier = F.when(F.col("l_linenumber") % 2 == 0, _str("./s", "l_partkey")).otherwise(_str("../web/./s", "l_partkey"))
    loads = l.select(F.concat(_str("web/s", "l_suppkey"), F.lit(".ts")).alias("path"), kind, specifier.alias("target"))
    native = table(spark, sf, "supplier").select(_str("native/", "s_nationkey").alias("source"), F.concat(_str("m", "s_suppkey"), F.lit(".py")).alias("target"))
    return context.import_graph(files.union(scripts), imports.union(loads), native)


@query(f"WITH {C.SYMBOLS_SQL}, c AS (SELECT 'user/' || user_id AS path, CAST(min(event_id % 500) AS INTEGER) AS from_line, CAST(min(event_id % 500) + 10 AS INTEGER) AS to_line FROM events GROUP BY 1) SELECT DISTINCT s.path, qualname FROM symbols s JOIN c ON c.path = s.path AND start_line <= to_line AND end_line >= from_line")
def changed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    s = C.symbols(spark, sf)
    c = s.groupBy("path").agg(F.min("start_line").alias("from_line"), (F.min("start_line") + 10).alias("to_line"))
    return context.touched_symbols(c, s)


@query("WITH i AS (SELECT p_type AS role, CAST(floor(p_retailprice) AS BIGINT) AS cost FROM part), m AS (SELECT role, min(cost) AS cost FROM i GROUP BY role) SELECT CAST(sum(cost) AS BIGINT) AS budget, count(*) AS roles FROM m")
def safe_budget(spark: SparkSession, sf: str) -> DataFrame:
    return context.smallest_safe_budget(table(spark, sf, "part").select(F.col("p_type").alias("role"), F.floor("p_retailprice").cast("long").alias("cost")))


@query("""WITH i AS (SELECT p_brand AS task, p_type AS role, p_partkey AS path, CAST(p_size AS BIGINT) AS cost, p_retailprice AS gain, p_partkey % 5 = 0 AS mandatory FROM part),
t AS (SELECT *, CASE WHEN mandatory THEN row_number() OVER (PARTITION BY task, role, mandatory ORDER BY gain DESC, path) ELSE 0 END AS turn FROM i),
u AS (SELECT *, sum(cost) OVER (PARTITION BY task ORDER BY NOT mandatory, turn, CASE WHEN mandatory THEN 0 ELSE -gain END, role, path ROWS UNBOUNDED PRECEDING) AS used FROM t), b AS (SELECT unnest([64, 192, 512, 2048]) AS budget),
n AS (SELECT task, count(DISTINCT role) FILTER (mandatory) AS needed FROM i GROUP BY task), h AS (SELECT task, budget, count(*) AS items, max(used) AS used, count(DISTINCT role) FILTER (mandatory) AS roles FROM u JOIN b ON used <= budget GROUP BY ALL)
SELECT task, budget, coalesce(items, 0) AS items, CAST(coalesce(used, 0) AS BIGINT) AS used, coalesce(roles, 0) AS roles, needed - coalesce(roles, 0) AS missing, needed = coalesce(roles, 0) AS safe FROM n CROSS JOIN b LEFT JOIN h USING (task, budget)""")
def budget_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """What packets of several budgets hold, for every task at once."""
    p = table(spark, sf, "part")
    items = p.select(F.col("p_brand").alias("task"), F.col("p_type").alias("role"), F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("cost"), F.col("p_retailprice").alias("gain"), (F.col("p_partkey") % 5 == 0).alias("mandatory"))
    return context.budget_sweep(items, [64, 192, 512, 2048])


@query("WITH s AS (SELECT p_brand || p_size AS name, 'f' || p_partkey AS path, p_brand || '.' || p_partkey AS qualname FROM part), n AS (SELECT DISTINCT p_brand || (p_size + 1) AS name FROM part) SELECT n.name, CASE count(qualname) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved-unique' ELSE 'ambiguous' END AS status, CASE WHEN count(qualname) = 1 THEN min(qualname) END AS qualname, CASE WHEN count(qualname) = 1 THEN min(path) END AS path FROM n LEFT JOIN s USING (name) GROUP BY n.name")
def nominated_symbols(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    named = lambda size: F.concat("p_brand", size.cast("string")).alias("name")
    s = p.select(named(F.col("p_size")), _str("f", "p_partkey").alias("path"), F.concat("p_brand", F.lit("."), F.col("p_partkey").cast("string")).alias("qualname"))
    return context.nominations(s, p.select(named(F.col("p_size") + 1)).distinct())


@query(f"WITH {C.FILES_SQL}, i AS (SELECT surface || '/AGENTS.md' AS instruction, surface AS root, 1 AS depth FROM files GROUP BY surface UNION ALL SELECT 'AGENTS.md', '', 0 UNION ALL SELECT surface || '/en/AGENTS.override.md', surface || '/en', 2 FROM files GROUP BY surface), m AS (SELECT path, instruction, depth FROM files JOIN i ON root = '' OR starts_with(path, root || '/')) SELECT path, instruction, row_number() OVER (PARTITION BY path ORDER BY depth DESC, instruction) AS precedence FROM m")
def instruction_scopes(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf)
    roots = f.select("surface").distinct()
    i = roots.select(F.concat("surface", F.lit("/AGENTS.md")).alias("path")).union(roots.select(F.concat("surface", F.lit("/en/AGENTS.override.md")))).union(spark.range(1).select(F.lit("AGENTS.md")))
    return context.instruction_scope(f.select("path"), i)


@query(f"""WITH {C.FILES_SQL}, t AS (SELECT path, regexp_extract_all(lower(text), '[a-z0-9_]+') AS b, regexp_extract_all(lower(path), '[a-z0-9_]+') AS p FROM files), x AS (SELECT path, len(b) AS lb, len(p) AS lp, list_transform(['the', 'en', 'license'], lambda w: len(list_filter(b, lambda y: y = w))) AS tb, list_transform(['the', 'en', 'license'], lambda w: len(list_filter(p, lambda y: y = w))) AS tp FROM t WHERE len(b) > 0 OR len(p) > 0),
s AS (SELECT count(*) AS n, avg(lb) AS ab, avg(lp) AS ap, [count(*) FILTER (WHERE tb[1] > 0 OR tp[1] > 0), count(*) FILTER (WHERE tb[2] > 0 OR tp[2] > 0), count(*) FILTER (WHERE tb[3] > 0 OR tp[3] > 0)] AS df FROM x),
k AS (SELECT path, n, df, i, 1.0 * tb[i] / (0.25 + 0.75 * lb / ab) + 3.0 * tp[i] / (0.25 + 0.75 * lp / ap) AS tf FROM x, s, (SELECT unnest([1, 2, 3]) AS i))
SELECT path, round(sum(ln(1 + (n - df[i] + 0.5) / (df[i] + 0.5)) * tf * 2.2 / (tf + 1.2)), 6) AS bm25 FROM k GROUP BY path HAVING sum(tf) > 0""")
def fielded_bm25(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.operators import rank

    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))
    docs = C.files(spark, sf).select("path", tokens("text").alias("body"), tokens("path").alias("place"))
    return rank.fielded_bm25(docs, ["the", "en", "license"], {"body": 1.0, "place": 3.0})


@query(f"WITH {C.POSTINGS_SQL}, m AS (SELECT path, count(DISTINCT token) AS n FROM postings WHERE token IN ('the', 'license', 'copyright') GROUP BY path) SELECT path, round(least(72, 6.0 * n + 30.0 * n / 3), 6) AS boost FROM m")
def lexical_boost(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.operators import rank

    words = ["the", "license", "copyright"]
    m = C.index(spark, sf).of(words).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return m.select("path", F.round(rank.file_boost(F.col("n"), 3), 6).alias("boost"))


@query("SELECT event_id, CAST(least(60, greatest(16, 42 - 7 * (event_id % 7)) + CASE WHEN event_id % 3 = 0 THEN 12 ELSE 0 END) AS INTEGER) AS boost FROM events")
def domain_boosts(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.operators import rank

    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", rank.domain_boost(i % 7, i % 3 == 0).cast("int").alias("boost"))


@query(f"WITH RECURSIVE {C.DEPS_SQL}, e AS (SELECT DISTINCT source, target FROM deps), w AS (SELECT node, 0 AS depth FROM nodes WHERE node IN (1, 7, 50) UNION SELECT e.source, w.depth + 1 FROM w JOIN e ON e.target = w.node WHERE w.depth < 6) SELECT 'tests/test_m' || node || '.py' AS path, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE depth > 0 AND node % 4 = 0 AND node NOT IN (1, 7, 50) GROUP BY node")
def affected_tests(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.operators import graph

    found = graph.closure(C.dependency_edges(spark, sf), spark.createDataFrame([(1,), (7,), (50,)], "node long"), 6, reverse=True)
    path = F.when(F.col("node") % 4 == 0, F.concat(_str("tests/test_m", "node"), F.lit(".py"))).otherwise(F.concat(_str("src/m", "node"), F.lit(".py")))
    return found.select(path.alias("path"), "depth").where(T.is_test_path(F.col("path")))


@query(f"WITH {C.LINES_SQL} SELECT path, line, CAST(instr(lower(content), 'license') AS INTEGER) AS at_column, CAST((length(content) - length(replace(lower(content), 'license', ''))) // 7 AS INTEGER) AS n FROM lines WHERE contains(lower(content), 'license')")
def literal_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where a literal stands: line, first column, and how often in the line. Files without it aren't cut into lines."""
    files = C.files(spark, sf).where(F.contains(F.lower("text"), F.lit("license")))
    low = F.lower("content")
    hit = C.lines(files).where(F.contains(low, F.lit("license")))
    return hit.select("path", "line", F.instr(low, "license").alias("at_column"), (F.size(F.split(low, "license", -1)) - 1).alias("n"))
