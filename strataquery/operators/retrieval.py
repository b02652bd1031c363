"""Candidate stages of a search: exact names, definitions of producers, callers, types; short-cuts, and the whole search.

Candidates are (row_type, path, qualname, name, signature, start_line, boost); stages bound what they bring, as a
feature of the answer, and a row brought by several stages keeps its largest boost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.functions.text import is_test_path
from strataquery.operators import lookup, rank
from strataquery.operators.graph import cut
from strataquery.operators.topk import path_diverse, top_per_group

CANDIDATE = ["row_type", "path", "qualname", "name", "signature", "start_line", "boost"]
#: Boosts of stages; edges that name types.
CALL, REFERENCE, TYPE, NATIVE = 30.0, 18.0, 42.0, 24.0
TYPE_KINDS = ["return-type", "parameter-type", "inherits", "attribute-type"]


def seeds(symbols: DataFrame, query: str, n: int) -> DataFrame:
    """The n best symbols by the score of the query."""
    return symbols.withColumn("score", rank.score(query)).orderBy(F.desc("score"), "path", "qualname").limit(n)


def caller_files(names: DataFrame, edges: DataFrame, per_seed: int = 30, call: str = "call") -> DataFrame:
    """(path, boost): files that refer to the seeds (name), per_seed references each; calls weigh more."""
    refs = edges.join(names.select(F.col("name").alias("target_short")).distinct(), "target_short", "left_semi").select("target_short", "path", "line", "source", "kind")
    some = top_per_group(refs, ["target_short"], ["path", "line", "source", "kind"], per_seed)
    return some.groupBy("path").agg(F.max(F.when(F.col("kind") == call, CALL).otherwise(REFERENCE)).alias("boost"))


def type_targets(chosen: DataFrame, edges: DataFrame, symbols: DataFrame, per_seed: int = 24, kinds: list[str] = TYPE_KINDS) -> DataFrame:
    """Symbols that the seeds (path, qualname) name as types: their first per_seed edges, then symbols of those names."""
    own = edges.join(chosen.select("path", F.col("qualname").alias("source")).distinct(), ["path", "source"], "left_semi").select("path", "source", "line", "target", "kind")
    some = top_per_group(own, ["path", "source"], ["line", "target", "kind"], per_seed).where(F.col("kind").isin(kinds))
    names = some.select(F.lower(F.substring_index("target", ".", -1)).alias("_n")).distinct()
    hits = symbols.withColumn("_n", F.lower("name")).join(names, "_n", "left_semi").drop("_n")
    return hits.withColumn("boost", F.lit(TYPE))


def native_candidates(definitions: DataFrame, files: DataFrame, words: list[str], per_word: int = 24) -> DataFrame:
    """Definitions that producers reported (path, display_name, symbol, line) for each raw word, once for each place,
    with their files."""
    parts = None
    for w in words:
        low = F.lit(w.lower())
        hit = definitions.where(F.contains(F.lower("display_name"), low) | F.contains(F.lower("symbol"), low)).orderBy("path", "line", "display_name", "symbol").limit(per_word)
        parts = hit if parts is None else parts.union(hit)
    if parts is None:
        parts = definitions.limit(0)
    once = parts.groupBy("path", "display_name", "line").agg(F.min("symbol").alias("symbol"))
    return once.join(files.select("path"), "path", "left_semi").withColumn("boost", F.lit(NATIVE))


def rare_anchor(df: DataFrame, postings: DataFrame, most: int = 3) -> DataFrame:
    """Files that hold a query term of at most `most` documents, with how many such terms each holds. df: (token, df)."""
    rare = df.where(F.col("df").between(1, most)).select("token")
    return postings.select("token", "path").join(rare, "token", "left_semi").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("rare_terms"))


def lexical_island(df: DataFrame, postings: DataFrame, most: int = 16, least_terms: int = 2) -> DataFrame:
    """The files that hold least_terms or more rare terms, if they are at most `most`, exactly one of them a test and at
    least one not; else none."""
    found = rare_anchor(df, postings, most).where(F.col("rare_terms") >= least_terms).withColumn("test", is_test_path(F.col("path")))
    found = cut(found.select("path", "rare_terms", "test"))  # read by the sums and by the answer
    sums = found.agg(F.count(F.lit(1)).alias("_n"), F.count_if("test").alias("_t"))
    return found.crossJoin(F.broadcast(sums)).where(f"_n <= {most} AND _t = 1 AND _n > _t").select("path", "rare_terms", "test")  # one row


def find(query: str, symbols: DataFrame, edges: DataFrame, files: DataFrame, n: int = 20, definitions: DataFrame | None = None, lexical: DataFrame | None = None) -> DataFrame:
    """Hybrid search: exact symbols, lexical files (path, boost), producers' definitions, callers and types; each path
    is shown before any is shown twice. Stages follow the query's route."""
    plan, terms = rank.route(query), rank.query_terms(query)
    wide = plan["intent"] in ("relationship", "structural")
    symbol_rows = symbols.select(F.lit("symbol").alias("row_type"), "path", "qualname", "name", "signature", F.col("start_line").cast("long").alias("start_line"))
    file_rows = lambda df: df.select(F.lit("file").alias("row_type"), "path", F.lit("").alias("qualname"), F.lit("").alias("name"), F.lit("").alias("signature"), F.lit(0).cast("long").alias("start_line"), "boost")
    exact = lookup.symbol_in(symbol_rows, terms).orderBy("path", "start_line", "qualname").limit(max(100, n * 8)).withColumn("boost", F.lit(0.0))
    parts = [exact.select(CANDIDATE)]
    if lexical is not None:
        parts.append(file_rows(lexical))
    if plan["native_definitions"] and definitions is not None:
        native = native_candidates(definitions, files, query.split())
        parts.append(native.select(F.lit("native-definition").alias("row_type"), "path", F.col("display_name").alias("qualname"), F.col("display_name").alias("name"), F.col("display_name").alias("signature"), F.col("line").cast("long").alias("start_line"), "boost"))
    if plan["caller_expansion"]:
        parts.append(file_rows(caller_files(seeds(exact, query, 12 if plan["intent"] == "relationship" else 8), edges)))
    parts.append(type_targets(seeds(exact, query, 12 if wide else 8), edges, symbol_rows).select(CANDIDATE))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    once = rows.groupBy(*CANDIDATE[:-1]).agg(F.max("boost").alias("boost"))
    scored = once.withColumn("score", rank.score(query, boost=F.col("boost"))).where("score > 0")
    return path_diverse(scored.select("row_type", "path", "qualname", "start_line", "score"), "path", "score", ["row_type", "qualname", "start_line"], n, n // 2)


def unstable(run) -> DataFrame:
    """Rows that tell two runs of the same question apart; none for a deterministic one."""
    a, b = run(), run()
    return a.exceptAll(b).withColumn("run", F.lit(1)).unionByName(b.exceptAll(a).withColumn("run", F.lit(2)))


def not_a_prefix(small: DataFrame, large: DataFrame, order: list) -> DataFrame:
    """Rows of a smaller answer that aren't the first rows of a larger one; none where limits only cut."""
    n = small.count()
    return small.exceptAll(large.orderBy(*order).limit(n))
