"""Queries over files, lines and postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.functions import text as T
from strataquery.operators import aggregate, lookup, rank, topk
from strataquery.operators import task as tasks
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.sources import corpus as C

PROBE = ["the", "license", "and"]
IN = "('the', 'license', 'and')"


@query(f"WITH {C.POSTINGS_SQL}, m AS (SELECT path, count(DISTINCT token) AS matches FROM postings WHERE token IN {IN} GROUP BY path ORDER BY matches DESC, path LIMIT 50) SELECT m.path, matches, language, full_tokens FROM m JOIN files USING (path)")
def lexical_file_candidates(spark: SparkSession, sf: str) -> DataFrame:
    files = C.files(spark, sf).select("path", "language", "full_tokens")
    return aggregate.match_counts(C.index(spark, sf).of(PROBE), PROBE, 50).join(files, "path")


@query(f"WITH {C.POSTINGS_SQL} SELECT path, line FROM postings WHERE token IN ('the', 'and') GROUP BY path, line HAVING count(DISTINCT token) = 2")
def lexical_line_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.conjunctive_lines(C.index(spark, sf).lines_of(["the", "and"]), ["the", "and"])


@query(f"WITH {C.POSTINGS_SQL} SELECT token, count(DISTINCT path) AS df FROM postings GROUP BY token")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return C.index(spark, sf).terms().select("token", "df")


@query(f"WITH {C.POSTINGS_SQL}, d AS (SELECT token, count(DISTINCT path) AS df FROM postings GROUP BY token) SELECT token, df, round(ln((greatest((SELECT count(*) FROM files), 1) + 1) / (df + 1)) + 1, 6) AS idf FROM d WHERE df >= 5")
def idf_terms(spark: SparkSession, sf: str) -> DataFrame:
    n = C.files(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return rank.idf(C.index(spark, sf).terms().where("df >= 5").crossJoin(F.broadcast(n)), F.col("n")).select("token", "df", "idf")  # one row


@query(f"WITH {C.POSTINGS_SQL} SELECT path, string_agg(DISTINCT token, ',' ORDER BY token) AS terms FROM postings WHERE token IN {IN} GROUP BY path")
def collected_terms(spark: SparkSession, sf: str) -> DataFrame:
    return C.index(spark, sf).of(PROBE).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("terms"))


@query(f"WITH {C.POSTINGS_SQL} SELECT path, count(DISTINCT CASE WHEN token = 'the' THEN line END) AS with_the, count(DISTINCT line) AS n_lines FROM postings GROUP BY path HAVING count(DISTINCT CASE WHEN token = 'the' THEN line END) >= 3")
def conditional_distinct(spark: SparkSession, sf: str) -> DataFrame:
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    the = C.index(spark, sf).of(["the"]).groupBy("path").agg(distinct("lines").alias("with_the"))
    # A line has a posting where it has a token: its number is told in the row, and no posting of another word is read.
    told = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike(T.TOKEN), i)), lambda i: i.isNotNull())
    return the.where("with_the >= 3").join(C.files(spark, sf).select("path", told.alias("told")), "path").groupBy("path", "with_the").agg(distinct("told").alias("n_lines"))


@query(f"WITH {C.POSTINGS_SQL} SELECT token, count(*) AS n FROM postings GROUP BY token ORDER BY n DESC, token LIMIT 25")
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return C.index(spark, sf).rows().groupBy("token").agg(F.sum(F.size("lines")).alias("n")).orderBy(F.desc("n"), "token").limit(25)


@query(f"WITH {C.LINES_SQL}, c AS (SELECT path, line, content, lag(content) OVER w AS before, lead(content) OVER w AS after FROM lines WINDOW w AS (PARTITION BY path ORDER BY line)) SELECT path, line, content, before, after FROM c WHERE contains(lower(content), 'licensed under')")
def grep_context(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line")
    files = C.files(spark, sf).join(C.index(spark, sf).files_with("licensed under"), "path", "left_semi")
    c = C.lines(files.where(F.contains(F.lower("text"), F.lit("licensed under")))).withColumn("before", F.lag("content").over(w)).withColumn("after", F.lead("content").over(w))
    return c.where(F.contains(F.lower("content"), F.lit("licensed under"))).select("path", "line", "content", "before", "after")


@query(f"WITH {C.FILES_SQL}, l AS (SELECT unnest(['the ', 'Licensed', '@', 'que']) AS literal) SELECT literal, path, CAST((length(text) - length(replace(text, literal, ''))) // length(literal) AS BIGINT) AS n FROM files, l WHERE contains(text, literal)")
def literal_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = F.explode(F.array(*[F.struct(F.lit(x).alias("literal"), F.floor((F.length("text") - F.length(F.replace("text", F.lit(x), F.lit("")))) / len(x)).cast("long").alias("n")) for x in ("the ", "Licensed", "@", "que")]))
    return C.files(spark, sf).select("path", found.alias("f")).select("f.literal", "path", "f.n").where("n > 0")


@query(f"WITH {C.FILES_SQL}, x AS (SELECT language, path, full_tokens, row_number() OVER (PARTITION BY language ORDER BY full_tokens DESC, path) AS turn FROM files) SELECT language, path, full_tokens, turn FROM x ORDER BY turn, language LIMIT 30")
def rr_truncation(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.files(spark, sf).select("language", "path", "full_tokens")
    return topk.round_robin(rows, "language", [F.desc("full_tokens"), "path"], 30)


@query(f"WITH {C.FILES_SQL} SELECT language, count(*) AS n FROM files GROUP BY language")
def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.category_counts(C.files(spark, sf), "language")


@query(f"WITH {C.FILES_SQL} SELECT string_split(path, '/')[1] AS top, count(*) AS n FROM files GROUP BY 1")
def top_level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.category_counts(C.files(spark, sf).select(F.substring_index("path", "/", 1).alias("top")), "top")


@query(f"WITH {C.FILES_SQL} SELECT surface, count(*) AS n_files, CAST(sum(full_tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN language = 'en' THEN full_tokens ELSE 0 END) AS BIGINT) AS en_tokens FROM files GROUP BY ROLLUP (surface)")
def surface_economics(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).select("surface", "language", "full_tokens")
    return f.rollup("surface").agg(F.count(F.lit(1)).alias("n_files"), F.sum("full_tokens").alias("tokens"), F.sum(F.when(F.col("language") == "en", F.col("full_tokens")).otherwise(0)).alias("en_tokens"))


@query(f"WITH {C.FILES_SQL} SELECT path, full_tokens, language FROM files WHERE path = 'src1' OR starts_with(path, 'src1/')")
def path_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return C.files(spark, sf).where(lookup.under("path", "src1")).select("path", "full_tokens", "language")


@query(f"WITH {C.FILES_SQL} SELECT path FROM files WHERE suffix(path, '7.txt') AND contains(lower(path), 'src1')")
def path_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return C.files(spark, sf).where(lookup.all_of(F.col("path").endswith("7.txt"), lookup.any_term("path", ["SRC1"]), None)).select("path")


@query(f"WITH {C.FILES_SQL} SELECT path, full_tokens FROM files WHERE string_split(path, '/')[-1] = '42.txt'")
def basename_scan(spark: SparkSession, sf: str) -> DataFrame:
    return C.files(spark, sf).where(T.basename(F.col("path")) == "42.txt").select("path", "full_tokens")


@query(f"WITH {C.FILES_SQL}, r AS (SELECT DISTINCT surface AS root FROM files UNION SELECT DISTINCT surface || '/' || language FROM files WHERE language IN ('en', 'fr')), m AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS rn FROM files JOIN r ON path = root OR starts_with(path, root || '/')) SELECT path, root FROM m WHERE rn = 1")
def segment_prefix_projects(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf)
    roots = f.select(F.col("surface").alias("root")).union(f.where(F.col("language").isin("en", "fr")).select(F.concat_ws("/", "surface", "language")))
    return lookup.nearest_root(f, roots, "path", "root")


@query(f"""WITH {C.FILES_SQL}, d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, string_split(path, '/')[-1] AS name, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size FROM files),
c AS (SELECT folder, left(md5(name), 3) AS cell, sha256(string_agg(strlen(name) || ':' || name || digest || size, chr(10) ORDER BY name)) AS digest, sum(size) AS size, count(*) AS n FROM d GROUP BY ALL)
SELECT folder, sha256(string_agg(cell || ':' || digest, chr(10) ORDER BY cell)) AS digest, CAST(sum(size) AS BIGINT) AS size, CAST(sum(n) AS BIGINT) AS children FROM c GROUP BY folder""")
def merkle_level(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), T.basename(F.col("path")).alias("name"), F.sha2("text", 256).alias("d"), F.octet_length("text").cast("long").alias("s"))
    return aggregate.merkle_level(f, "folder", "name", "d", "s")


@query(f"WITH {C.FILES_SQL} SELECT surface, sha256('members' || chr(10) || string_agg(DISTINCT language, chr(10) ORDER BY language)) AS identity, count(DISTINCT language) AS members FROM files GROUP BY surface")
def membership_identity(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.membership_identity(C.files(spark, sf), ["surface"], "language", "members")


@query(f"WITH {C.FILES_SQL} SELECT path, sha256('file' || strlen(path) || ':' || path || strlen(text) || ':' || text) AS identity FROM files")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return C.files(spark, sf).select("path", T.digest(F.col("path"), F.col("text"), domain="file").alias("identity"))


@query(f"""WITH {C.LINES_SQL}, t AS (SELECT path, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS token FROM lines), c AS (SELECT path, token, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT path, sum(tf) AS dl FROM c GROUP BY path), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), d AS (SELECT token, count(*) AS df FROM c WHERE token IN {IN} GROUP BY token)
SELECT path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM c JOIN d USING (token) JOIN l USING (path), s GROUP BY path""")
def bm25(spark: SparkSession, sf: str) -> DataFrame:
    words = C.files(spark, sf).select("path", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)).alias("tokens"))
    return rank.bm25(words, PROBE)


@query(f"""WITH {C.FILES_SQL}, v AS (
SELECT 'base' AS view, path, row_number() OVER (ORDER BY full_tokens DESC, path) AS path_rank FROM files UNION ALL SELECT 'governance', path, row_number() OVER (ORDER BY path) FROM files
UNION ALL SELECT 'evidence', path, row_number() OVER (ORDER BY doc_id DESC, path) FROM files)
SELECT path, round(sum(CASE view WHEN 'base' THEN 1.2 WHEN 'governance' THEN 1.0 ELSE 0.8 END / (60 + path_rank)) * 1000, 6) AS score, count(*) AS views FROM v WHERE path_rank <= 100 GROUP BY path""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).select("path", "full_tokens", "doc_id")
    lists = {"base": [F.desc("full_tokens"), "path"], "governance": ["path"], "evidence": [F.desc("doc_id"), "path"]}
    views = [f.orderBy(*o).limit(100).select(F.lit(v).alias("view"), "path", F.row_number().over(Window.orderBy(*o)).alias("path_rank")) for v, o in lists.items()]  # windows over 100 rows
    return aggregate.fuse_ranks(views[0].union(views[1]).union(views[2]), {"base": 1.2, "governance": 1.0, "evidence": 0.8})


@query(f"WITH {C.LINES_SQL} SELECT path, count(*) AS n_lines, count(*) FILTER (length(content) > 200) AS long_lines, count(DISTINCT content) AS distinct_lines FROM lines GROUP BY path")
def source_shape(spark: SparkSession, sf: str) -> DataFrame:
    return C.files(spark, sf).select("path", F.split("text", "\n").alias("l")).select("path", F.size("l").cast("long").alias("n_lines"), F.size(F.filter("l", lambda x: F.length(x) > 200)).cast("long").alias("long_lines"), F.size(F.array_distinct("l")).cast("long").alias("distinct_lines"))


@query(f"WITH {C.FILES_SQL} SELECT path, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS slice FROM files WHERE len(string_split(text, chr(10))) >= 4")
def source_slice(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).withColumn("l", F.split("text", "\n"))
    return f.where(F.size("l") >= 4).select("path", F.array_join(F.slice("l", 2, 3), "\n").alias("slice"))


@query(f"WITH {C.FILES_SQL} SELECT path, sha256(array_slice(encode(text), 11, 60)) AS digest FROM files WHERE strlen(text) >= 60")
def byte_range_receipt(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).where(F.octet_length("text") >= 60)
    return f.select("path", F.sha2(F.substring(F.col("text").cast("binary"), 11, 50), 256).alias("digest"))


@query(f"""WITH {C.FILES_SQL}, p AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'config/.env' WHEN doc_id % 7 = 1 THEN 'keys/a' || doc_id || '.pem' WHEN doc_id % 7 = 2 THEN 'docs/' || doc_id || '.md' WHEN doc_id % 7 = 3 THEN 'vendor/x/' || doc_id || '.py' ELSE 'src/m' || doc_id || '.py' END AS name FROM files)
SELECT path, name, CASE WHEN starts_with(name, 'config/') OR starts_with(name, 'keys/') OR starts_with(name, 'vendor/') THEN 'deny' WHEN starts_with(name, 'docs/') THEN 'outline' ELSE 'source' END AS visibility FROM p""")
def policy_admission(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.sources.repository import admission

    d = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 7
    name = F.when(m == 0, "config/.env").when(m == 1, F.concat(F.lit("keys/a"), d, F.lit(".pem"))).when(m == 2, F.concat(F.lit("docs/"), d, F.lit(".md"))).when(m == 3, F.concat(F.lit("vendor/x/"), d, F.lit(".py"))).otherwise(F.concat(F.lit("src/m"), d, F.lit(".py")))
    rules = [("vendor/**", False, None), ("docs/*", None, "outline"), ("**/x/**", True, None), ("vendor/**", False, None)]
    return C.files(spark, sf).withColumn("name", name).select("path", "name", admission(F.col("name"), rules)[1].alias("visibility"))


@query(f"WITH {C.FILES_SQL}, p AS (SELECT DISTINCT surface AS path FROM files WHERE surface < 'src15' UNION SELECT path FROM files) SELECT path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE starts_with(a.path, b.path || '/'))")
def descendant_collapse(spark: SparkSession, sf: str) -> DataFrame:
    from strataquery.operators.delta import collapse_descendants

    f = C.files(spark, sf)
    return collapse_descendants(f.where("surface < 'src15'").select(F.col("surface").alias("path")).union(f.select("path")).distinct())


@query("SELECT p.page_id, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS links, CASE WHEN html LIKE '%lang=\"en\"%' THEN 'en' ELSE 'other' END AS lang FROM pages p")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.when(F.contains("html", F.lit('lang="en"')), "en").otherwise("other").alias("lang"))


@query(f"""WITH {C.FILES_SQL}, x AS (SELECT language, path, full_tokens, sum(full_tokens) OVER (PARTITION BY language ORDER BY full_tokens, path ROWS UNBOUNDED PRECEDING) AS used FROM files) SELECT language, path, full_tokens, CAST(used AS BIGINT) AS used FROM x WHERE used <= 4000""")
def prefix_budget(spark: SparkSession, sf: str) -> DataFrame:
    return topk.prefix_budget(C.files(spark, sf).select("language", "path", "full_tokens"), ["language"], ["full_tokens", "path"], "full_tokens", 4000)


TASK = "Which public license and copyright notice should software include, que der the license of einer"
#: What the task's cues add to its terms.
ADDED = "('governance', 'ownership'), ('governance', 'authority'), ('governance', 'architecture'), ('governance', 'contract'), ('governance', 'agents'), ('governance', 'readme'), ('evidence', 'privacy'), ('evidence', 'security'), ('evidence', 'confidentiality'), ('evidence', 'redaction'), ('evidence', 'exposure')"


@query(f"""WITH {C.POSTINGS_SQL}, d AS (SELECT token, count(DISTINCT path) AS df FROM postings WHERE token IN ('public', 'license', 'copyright', 'notice', 'software', 'que', 'der', 'einer') GROUP BY token),
b AS (SELECT token FROM d ORDER BY ln(((SELECT count(*) FROM files) + 1) / (df + 1)) DESC, length(token) DESC, token DESC LIMIT 4),
w AS (SELECT * FROM (VALUES ('base', 1.2, 80, 0), ('governance', 1.0, 80, 1), ('evidence', 0.8, 40, 2)) t(view, weight, most, nr)),
v AS (SELECT view, token FROM b, w UNION SELECT view, token FROM (VALUES {ADDED}) t(view, token)),
h AS (SELECT view, path, line, count(*) AS score FROM postings JOIN v USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY score DESC, path, line) AS place FROM h), k AS (SELECT r.*, weight, nr FROM r JOIN w USING (view) WHERE place <= most),
f AS (SELECT view, weight, path, row_number() OVER (PARTITION BY view ORDER BY min(place)) AS path_rank FROM k GROUP BY view, weight, path),
s AS (SELECT path, round(sum(weight / (60 + path_rank)) * 1000, 6) AS score, count(*) AS views FROM f GROUP BY path),
m AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY score DESC, nr, place) AS rn FROM k)
SELECT s.path, score, views, line FROM s JOIN m ON m.path = s.path AND rn = 1 ORDER BY score DESC, path LIMIT 20""")
def task_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Three views of a task over all documents: its four most telling words, then with what its cues ask for."""
    index = C.index(spark, sf)
    df = {r["token"]: r["df"] for r in index.frequencies(list(tasks.words(TASK))).collect()}
    chosen = tasks.views(TASK, df, C.files(spark, sf).count(), 20, 4)
    hits = reduce(DataFrame.unionByName, [tasks.line_hits(index, v) for v in chosen])
    return tasks.fused(hits, chosen, 20).select("path", "score", "views", "line")


@query(f"""WITH RECURSIVE {C.FILES_SQL}, o AS (SELECT language, path, full_tokens, row_number() OVER (PARTITION BY language ORDER BY full_tokens DESC, path) AS rn FROM files),
w AS (SELECT DISTINCT language, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, '' AS path, CAST(0 AS BIGINT) AS full_tokens, false AS took FROM files
UNION ALL SELECT o.language, o.rn, CASE WHEN used + o.full_tokens <= 20000 THEN used + o.full_tokens ELSE used END, o.path, o.full_tokens, used + o.full_tokens <= 20000 FROM w JOIN o ON o.language = w.language AND o.rn = w.rn + 1)
SELECT language, path, full_tokens, CAST(rn AS INTEGER) AS rn FROM w WHERE took""")
def skip_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy with skips over all files of each language, the largest first; rn is a file's place among them."""
    f = C.files(spark, sf).select("language", "path", "full_tokens")
    taken = topk.fill_budget(f.withColumn("_o", -F.col("full_tokens")), "language", ["_o", "path"], "full_tokens", 20_000).drop("_o")
    sizes = f.groupBy("language", F.col("full_tokens").alias("_size")).agg(F.count(F.lit(1)).alias("_n"))
    larger = taken.join(sizes, "language").where("_size > full_tokens").groupBy("language", "path").agg(F.sum("_n").alias("_larger"))
    equal = taken.join(f.withColumnRenamed("path", "_path"), ["language", "full_tokens"]).where("_path <= path").groupBy("language", "path").agg(F.count(F.lit(1)).alias("_equal"))
    placed = taken.join(larger, ["language", "path"], "left").join(equal, ["language", "path"])
    return placed.select("language", "path", "full_tokens", (F.coalesce("_larger", F.lit(0)) + F.col("_equal")).cast("int").alias("rn"))


def _cover_sql(n: int) -> str:
    """n picks for each language, each the file with most terms that no earlier pick has."""
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT language, path, token FROM postings JOIN files USING (path)), i0 AS MATERIALIZED (SELECT language, path, count(token) AS n_terms FROM l0 GROUP BY ALL)"]
    for k in range(1, n + 1):
        left = f"l{k - 1} x LEFT JOIN (SELECT DISTINCT c.language, c.token, true AS hit FROM l{k - 1} c JOIN p{k} USING (language, path)) h USING (language, token) WHERE h.hit IS NULL"
        steps.append(f"p{k} AS MATERIALIZED (SELECT language, path, n_terms FROM (SELECT i.*, row_number() OVER (PARTITION BY i.language ORDER BY coalesce(g.gain, 0) DESC, i.path) AS rn FROM i{k - 1} i LEFT JOIN (SELECT language, path, count(*) AS gain FROM l{k - 1} GROUP BY ALL) g USING (language, path)) WHERE rn = 1)")
        steps.append(f"l{k} AS MATERIALIZED (SELECT x.language, x.path, x.token FROM {left}), i{k} AS MATERIALIZED (SELECT i.* FROM i{k - 1} i ANTI JOIN p{k} USING (language, path))")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT language, path, {k} AS pick, CAST(n_terms AS INTEGER) AS n_terms FROM p{k}" for k in range(1, n + 1))


@query(f"WITH {C.POSTINGS_SQL}, {_cover_sql(8)}")
def diversity_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Per language, the files that cover most terms not covered yet, out of all files and all their terms."""
    f = C.files(spark, sf)
    terms = C.index(spark, sf).rows().groupBy("path").agg(F.collect_set("token").alias("terms"))
    return topk.greedy_cover(f.select("language", "path").join(terms, "path"), "language", "path", "terms", 8)
