"""Dependency observations, declarations and correlated evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_complete(coverage: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Per kind: every row complete and untruncated, and (where contexts are declared) every context covered."""
    rows = coverage.groupBy("kind").agg(F.bool_and((F.col("completeness") == "complete") & (F.col("truncation") == "complete")).alias("rows_complete"), F.count_distinct("context").alias("covered"))
    if declared is None:
        return rows.select("kind", F.col("rows_complete").alias("complete"))
    known = coverage.join(declared.select("context").distinct(), "context", "left_semi").groupBy("kind").agg(F.count_distinct("context").alias("known"))
    n = declared.select("context").distinct().agg(F.count(F.lit(1)).alias("declared"))
    return rows.join(known, "kind", "left").crossJoin(F.broadcast(n)).select("kind", (F.col("rows_complete") & (F.coalesce("known", F.lit(0)) == F.col("declared"))).alias("complete"))  # one row


def negative_evidence(found: Column, complete: Column, omissions: Column) -> Column:
    """Absence counts only where coverage is complete and nothing was left out."""
    return F.when(found > 0, "not-applicable").when(complete & (omissions == 0), "admissible").otherwise("inadmissible")


def declaration_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per concept: how many subjects declare it and whether their values agree. No winner is chosen."""
    agreed = F.when(F.col("values") == 1, F.when(F.col("subjects") == 1, "single").otherwise("equivalent")).otherwise("disagreement")
    return rows.groupBy(*keys).agg(F.countDistinct("subject").alias("subjects"), F.countDistinct("value").alias("values")).withColumn("state", agreed)


def endpoints(selections: DataFrame, inventory: DataFrame, incoming: DataFrame, roots: DataFrame) -> DataFrame:
    """Each selected node with how often it stands in the inventory, is depended on, and is a root."""
    n = lambda df, name: df.groupBy("node").agg(F.count(F.lit(1)).alias(name))
    out = selections
    for df, name in ((inventory, "inventory"), (incoming, "incoming"), (roots, "roots")):
        out = out.join(n(df, name), "node", "left")
    return out.na.fill(0, ["inventory", "incoming", "roots"])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Referential integrity: ends of edges that no node row has."""
    ends = edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Selected versions (component, version) before and after, per component."""
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    join = lambda df, name: df.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias(name))
    return join(before, "was").join(join(after, "now"), "component", "full_outer").select("component", "was", "now", state.alias("state"))


def consumers(imports: DataFrame, owners: DataFrame, selected: DataFrame) -> DataFrame:
    """(path, node): files whose import's module is owned by exactly one selected node."""
    unique = owners.groupBy("module").agg(F.count_distinct("node").alias("n"), F.min("node").alias("node")).where("n = 1").drop("n")
    return imports.join(unique, "module").join(selected.select("node"), "node", "left_semi").select("path", "node").distinct()


def unique_claims(claims: DataFrame, key: str, value: str) -> DataFrame:
    """resolved-unique where all claims agree, claim-conflict otherwise."""
    return claims.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v")).select(key, F.when(F.col("n") == 1, "resolved-unique").otherwise("claim-conflict").alias("status"), F.when(F.col("n") == 1, F.col("v")).alias(value))


def line_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines whose content stands once on either side: (path, was_line, now_line)."""
    once = lambda df, name: df.groupBy("path", "content").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias(name)).where("n = 1").drop("n")
    return once(before, "was_line").join(once(after, "now_line"), ["path", "content"]).select("path", "was_line", "now_line")
