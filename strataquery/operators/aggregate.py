"""Aggregations over postings, intervals, rankings and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.countDistinct("path").alias("df"))


def term_frequency(file_terms: DataFrame) -> DataFrame:
    """Document frequencies from (path, token) rows that are distinct already: a plain count, combined before the shuffle."""
    return file_terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def match_counts(postings: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Paths by the number of distinct terms they hold: the k first."""
    hits = postings.where(F.col("token").isin(terms)).select("token", "path").distinct()
    return hits.groupBy("path").agg(F.count(F.lit(1)).alias("matches")).orderBy(F.desc("matches"), "path").limit(k)


def conjunctive_lines(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Lines that hold all of the terms."""
    hits = postings.where(F.col("token").isin(terms)).groupBy("path", "line").agg(F.countDistinct("token").alias("n"))
    return hits.where(F.col("n") == len(set(terms))).select("path", "line")


def interval_union(spans: DataFrame, key: str = "path", width: int = 4096) -> DataFrame:
    """Total length of the union of closed integer intervals per key, and its islands; adjacent intervals join.

    Intervals are cut at the borders of line buckets of `width` and merged inside each, so a key with very many intervals
    is spread; lengths add up over buckets, and islands that touch across a border are one."""
    low, high = F.col("_b") * width, F.col("_b") * width + width - 1
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    parts = cut.select(key, "_b", F.greatest("start_line", low).alias("_s"), F.least("end_line", high).alias("_e"))
    w = Window.partitionBy(key, "_b").orderBy("_s", "_e")
    before = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("_new", (before.isNull() | (F.col("_s") > before + 1)).cast("int"))
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(key, "_b", "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    bucket = merged.groupBy(key, "_b").agg(F.sum(F.col("_e") - F.col("_s") + 1).alias("_len"), F.count(F.lit(1)).alias("_n"), (F.min("_s") == F.first(low)).alias("_left"), (F.max("_e") == F.first(high)).alias("_right"))
    row = Window.partitionBy(key).orderBy("_b")
    joined = F.col("_left") & (F.lag("_b").over(row) == F.col("_b") - 1) & F.lag("_right").over(row)
    return bucket.withColumn("_joined", F.coalesce(joined.cast("int"), F.lit(0))).groupBy(key).agg(F.sum("_len").cast("long").alias("covered"), F.sum(F.col("_n") - F.col("_joined")).cast("long").alias("islands"))


def fuse_ranks(ranked: DataFrame, weights: dict[str, float], k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion of lists (view, path, path_rank): the sum of weight / (k + rank) per path."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("view")]
    return ranked.groupBy("path").agg(F.round(F.sum(weight / (F.lit(k) + F.col("path_rank"))) * 1000, 6).alias("score"), F.count(F.lit(1)).alias("views"))


def membership_identity(df: DataFrame, keys: list[str], member: str, domain: str) -> DataFrame:
    """A digest of each group's set of members, whatever their order and repetition."""
    members = F.array_sort(F.collect_set(F.col(member).cast("string")))
    return df.groupBy(*keys).agg(F.sha2(F.concat(F.lit(domain + "\n"), F.array_join(members, "\n")), 256).alias("identity"), F.countDistinct(member).alias("members"))


def merkle_level(children: DataFrame, parent: str, name: str, digest: str, size: str) -> DataFrame:
    """One level of a tree digest: a folder's digest out of its children's names, digests and sizes, and their total size.

    Children are dealt to 4,096 cells by the digest of their name; a cell's digest is of its children in the order of
    names, a folder's of its cells in their order. So a folder of any number of children is cut into cells of many tasks,
    which meet as 4,096 rows at most, and the digest depends on the children alone."""
    line = F.concat(F.octet_length(name).cast("string"), F.lit(":"), F.col(name), F.col(digest), F.col(size).cast("string"))
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda r: r["v"]), "\n")
    dealt = children.withColumn("_cell", F.substring(F.md5(F.col(name).cast("binary")), 1, 3))
    cells = dealt.groupBy(parent, "_cell").agg(F.sha2(ordered(name, line), 256).alias("_d"), F.sum(size).alias("_s"), F.count(F.lit(1)).alias("_n"))
    whole = ordered("_cell", F.concat(F.col("_cell"), F.lit(":"), F.col("_d")))
    return cells.groupBy(parent).agg(F.sha2(whole, 256).alias("digest"), F.sum("_s").alias("size"), F.sum("_n").alias("children"))


def merkle_tree(files: DataFrame, path: str, digest: str, size: str) -> DataFrame:
    """Digests of every folder, bottom-up; one aggregation per depth of the tree."""
    spark_path = F.col(path)
    level = files.select(spark_path.alias("path"), F.col(digest).alias("digest"), F.col(size).alias("size"), F.size(F.split(spark_path, "/")).alias("depth"))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    out = None
    for depth in range(deepest, 0, -1):
        here = level.where(F.col("depth") == depth)
        folders = here.withColumn("parent", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")).withColumn("name", F.substring_index("path", "/", -1))
        made = merkle_level(folders, "parent", "name", "digest", "size").select(F.col("parent").alias("path"), "digest", "size", F.lit(depth - 1).alias("depth"), "children")
        out = made if out is None else out.unionByName(made)
        level = level.where(F.col("depth") < depth).unionByName(made.drop("children"))
    return out


def category_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def all_true(df: DataFrame, keys: list[str], condition: F.Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_and(condition).alias("complete"), F.count(F.lit(1)).alias("rows"))
