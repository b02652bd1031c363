"""Bounded lookups and the joins behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions.text import dotted_prefixes, folder_prefixes, short_name
from strataquery.sources.grams import Grams


def exact_symbol(symbols: DataFrame, query: str, n: int) -> DataFrame:
    """Name or qualified name; qualified matches first."""
    hit = symbols.where((F.col("qualname") == query) | (F.col("name") == query))
    return hit.withColumn("kind_of_match", F.when(F.col("qualname") == query, 0).otherwise(1)).orderBy("kind_of_match", "path", "start_line", "qualname").limit(n)


def symbol_in(symbols: DataFrame, terms: list[str]) -> DataFrame:
    low = [t.lower() for t in terms]
    return symbols.where(F.lower("name").isin(low) | F.lower("qualname").isin(low))


def substring_candidates(symbols: DataFrame, files: DataFrame, term: str, n: int) -> DataFrame:
    """Symbols and files that contain a term, as rows of one shape."""
    has = lambda c: F.contains(F.lower(c), F.lit(term.lower()))
    s = symbols.where(has("name") | has("qualname") | has("signature") | has("path")).select("path", "qualname", F.lit("symbol").alias("row_type"))
    f = files.where(has("path")).select("path", F.lit("file").alias("row_type"))
    return s.unionByName(f, allowMissingColumns=True).orderBy("path", "row_type", F.coalesce("qualname", F.lit(""))).limit(n)


def indexed_candidates(symbols: DataFrame, files: DataFrame, index: Grams, term: str, n: int) -> DataFrame:
    """`substring_candidates` by an index of trigrams over names, qualified names, signatures and paths."""
    s = index.rows_with(symbols, ["name", "qualname", "signature", "path"], term).select("path", "qualname", F.lit("symbol").alias("row_type"))
    f = index.rows_with(files.select("path"), ["path"], term).select("path", F.lit("file").alias("row_type"))
    return s.unionByName(f, allowMissingColumns=True).orderBy("path", "row_type", F.coalesce("qualname", F.lit(""))).limit(n)


def under(column: str, prefix: str) -> Column:
    """Equal to a path or below it: whole segments, so `src` doesn't take in `src2`. Pushed down as a prefix filter."""
    return (F.col(column) == prefix) | F.col(column).startswith(prefix + "/")


def under_module(column: str, modules: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col(column) == m) | F.col(column).startswith(m + ".") for m in modules], F.lit(False))


def any_term(column: str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(column), F.lit(t.lower())) for t in terms if len(t) >= 2], F.lit(False))


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, joined by and."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def containing(symbols: DataFrame, line: int) -> DataFrame:
    """Symbols around a line, innermost first."""
    return symbols.where((F.col("start_line") <= line) & (F.col("end_line") >= line)).withColumn("width", F.col("end_line") - F.col("start_line"))


def overlapping(symbols: DataFrame, start: int, end: int) -> DataFrame:
    return symbols.where((F.col("start_line") <= end) & (F.col("end_line") >= start))


def interval_join(points: DataFrame, spans: DataFrame, key: str, point: str, width: int = 64) -> DataFrame:
    """Points inside closed intervals of the same key. Both sides are dealt to line buckets of `width`, so a key with
    very many rows is spread, and a bucket meets only the intervals that cross it."""
    s = spans.withColumn("_bucket", F.explode(F.sequence((F.col("start_line") / width).cast("long"), (F.col("end_line") / width).cast("long"))))
    p = points.withColumn("_bucket", (F.col(point) / width).cast("long"))
    return p.join(s, [key, "_bucket"]).where(F.col(point).between(F.col("start_line"), F.col("end_line"))).drop("_bucket")


def innermost(points: DataFrame, spans: DataFrame, key: str, point: str, id_: str) -> DataFrame:
    """For every point: the smallest interval around it, and whether it is unique, tied or missing."""
    found = interval_join(points, spans, key, point).withColumn("_w", F.col("end_line") - F.col("start_line"))
    best = found.withColumn("_r", F.rank().over(Window.partitionBy(id_).orderBy("_w"))).where("_r = 1").groupBy(id_).agg(F.count(F.lit(1)).alias("ties"), F.min("qualname").alias("qualname"))
    status = F.when(F.col("ties").isNull(), "no-containing-symbol").when(F.col("ties") == 1, "resolved-unique").otherwise("resolved-ambiguous")
    return points.join(best, id_, "left").select(id_, status.alias("status"), F.when(F.col("ties") == 1, F.col("qualname")).alias("qualname"))


def references(edges: DataFrame, name: str) -> DataFrame:
    """Edges to a short name: qualifiers are not compared."""
    return edges.where(F.col("target_short") == short_name(F.lit(name)))


def preferred_first(edges: DataFrame, preferred: DataFrame, n: int, keys: tuple[str, ...] = ("target_short",)) -> DataFrame:
    """Per target, the first n rows, those of preferred paths before the others."""
    marked = edges.join(preferred.select("path").distinct().withColumn("_p", F.lit(1)), "path", "left")
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("_p", F.lit(0)).desc(), "path", "line", "source"))
    return marked.withColumn("rn", rn).where(F.col("rn") <= n).withColumn("preferred", F.col("_p").isNotNull()).drop("_p")


def longest_prefix(names: DataFrame, modules: DataFrame, name: str, module: str) -> DataFrame:
    """Each name with the longest of its dotted prefixes that is a module (an equality join on exploded prefixes)."""
    tried = names.select(name, F.posexplode(dotted_prefixes(F.col(name))).alias("_at", module))
    return tried.join(modules, module).groupBy(name).agg(F.min_by(module, "_at").alias(module), F.min("_at").alias("dropped"))


def nearest_root(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Each path with its deepest root: an equality join on the path's folders."""
    tried = paths.select(path, F.explode(F.concat(folder_prefixes(F.col(path)), F.array(path))).alias(root))
    return tried.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))


#: Fixed value: endings that a script's relative import leaves out, in the order in which they are tried.
SCRIPT_ENDS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def script_candidates(specifier: Column) -> Column:
    """Files that a script's relative import may mean, in order."""
    return F.array(*[F.concat(specifier, F.lit(e)) for e in SCRIPT_ENDS])


def script_files(files: DataFrame, path: str, base: str) -> DataFrame:
    """(base, path): the first of the `script_candidates` of a base that is a file, for every base that has one, a slash put
    before it. Endings are taken off the files, so that a join on the base has one row for each import instead of one for
    each candidate."""
    col = F.col(path)
    cut_ = lambda e: F.when(col.endswith(e), F.concat(F.lit("/"), F.substring(col, F.lit(1), F.length(col) - len(e))))
    ends = files.select(path, F.posexplode(F.array(*map(cut_, SCRIPT_ENDS))).alias("_at", base)).where(F.col(base).isNotNull())
    return ends.groupBy(base).agg(F.min_by(path, "_at").alias(path))


def contains_join(texts: DataFrame, text: Column, terms: DataFrame, term: str) -> DataFrame:
    """Rows whose text contains a term; for a table of terms that is small by construction (a query's own terms)."""
    return texts.join(F.broadcast(terms), F.instr(F.lower(text), F.col(term)) > 0)


def mapped_path(path: Column, rules: list[tuple[str, str]]) -> Column:
    """A path after the first rule whose prefix it has."""
    out = F.lit(None).cast("string")
    for old, new in reversed(rules):
        out = F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 100_000))).otherwise(out)
    return out
