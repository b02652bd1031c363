"""Bounded results: deterministic prefixes, per-group top-n, truncation flags, diversity and budgets."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.operators import graph
from strataquery.sources.stored import Parts


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group; Spark cuts each task's groups to n before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def best_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_rn").drop("_rn")


def bounded(df: DataFrame, order: list, n: int) -> DataFrame:
    """An ordered prefix of n rows, each with the flag whether rows were left out; one row more than n is looked at."""
    ahead = df.orderBy(*order).limit(n + 1)
    w = Window.orderBy(*order)  # over n + 1 rows
    return ahead.withColumn("_at", F.row_number().over(w)).withColumn("truncated", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > n).where(F.col("_at") <= n).drop("_at")


def with_omissions(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """Per group: the first n rows and how many were left out."""
    total = df.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("omitted"))
    return top_per_group(df, keys, order, n).join(total, keys)


def round_robin(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """n rows taken from the groups in turn, each group in its own order."""
    ranked = top_per_group(df, [key], order, n, "turn")
    return ranked.orderBy("turn", key).limit(n)


def path_diverse(df: DataFrame, path: str, score: str, tie: list, n: int, reserve: int) -> DataFrame:
    """First the best row of each of `reserve` paths, then the best of all, n in total."""
    order = [F.desc(score), path, *tie]
    best = best_per_group(df, [path], order).orderBy(*order).limit(reserve).withColumn("tier", F.lit(0))
    fill = df.orderBy(*order).limit(n + reserve).withColumn("tier", F.lit(1))
    cols = [c for c in best.columns if c != "tier"]
    return best.unionByName(fill).groupBy(*cols).agg(F.min("tier").alias("tier")).orderBy("tier", *order).limit(n)


def within_budget(df: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Greedy fill with skips inside each group: a row too dear for what is left is passed over. Groups must be bounded
    (callers cut them to a top-n first), for the choice depends on all rows before."""

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        used, keep = 0, []
        for c in g[cost]:
            ok = used + c <= budget
            used += c if ok else 0
            keep.append(ok)
        return g[keep]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return fill(g.sort_values(order, kind="stable"))

    return df.groupBy(key).applyInPandas(run, df.schema)


def fill_budget(df: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """`within_budget` for groups of any size: `order` is a total order of a group's rows without nulls, costs are whole
    numbers from 0.

    Each pass takes the rows while their running cost fits; then whatever is dearer than the rest of the budget can't fit
    any more. Rows of cost 0 always fit, so b + 1 others are enough to find where a budget of b ends."""
    at = F.struct(*order)
    rows = graph.cut(df.where((F.col(cost) >= 0) & (F.col(cost) <= budget)))
    free, left = rows.where(F.col(cost) == 0), rows.where(F.col(cost) > 0).withColumn("_left", F.lit(budget).cast("long"))
    taken = [free]
    while True:
        ahead = top_per_group(left, [key], [at], budget + 1, "_rn")
        w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        now = graph.cut(ahead.withColumn("_used", F.sum(cost).over(w)).where(F.col("_used") <= F.col("_left")))
        if now.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        taken.append(now.select(*df.columns))
        spent = now.groupBy(key).agg(F.max("_used").alias("_spent"), F.max(at).alias("_last"))
        rest = left.join(spent, key).where((at > F.col("_last")) & (F.col(cost) <= F.col("_left") - F.col("_spent")))
        left = graph.cut(rest.select(*df.columns, (F.col("_left") - F.col("_spent")).alias("_left")))


def prefix_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows while the running cost (whole numbers from 0) stays within the budget, with the cost `used` up to each.

    The first budget + 1 rows that cost something tell where each group ends, and Spark cuts groups to so many before the
    shuffle; only rows before that place are added up."""
    at = F.struct(*order)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = top_per_group(df.where(F.col(cost) > 0), keys, order, budget + 1, "_rn").withColumn("used", F.sum(cost).over(w))
    stop = ahead.where(F.col("used") > budget).groupBy(*keys).agg(F.min(at).alias("_stop"))
    kept = df.join(stop, keys, "left").where(F.col("_stop").isNull() | (at < F.col("_stop"))).drop("_stop")
    return kept.withColumn("used", F.sum(cost).over(w))


def greedy_cover(df: DataFrame, group: str, item: str, terms: str, n: int) -> DataFrame:
    """Per group, up to n items, each time the one that covers most terms not yet covered (ties: smaller item). Groups may
    be of any size: terms are written once, a row for each item; a pick reads them past a table of what is covered, which
    is as small as the items picked so far, and sends one row an item to where the best is found."""
    merged = df.groupBy(group, item).agg(F.array_distinct(F.flatten(F.collect_list(terms))).alias("_ts"))
    items = graph.cut(merged.withColumn("n_terms", F.size("_ts")))
    picks, covered = Parts(df.sparkSession, "picks"), Parts(df.sparkSession, "covered")
    for k in range(n):
        left = items.join(picks.df.select(group, item), [group, item], "left_anti") if k else items
        each = left.select(group, item, "n_terms", F.explode_outer("_ts").alias("_t"))
        hit = each.join(covered.df.select(group, "_t", F.lit(True).alias("_hit")), [group, "_t"], "left") if k else each.withColumn("_hit", F.lit(None))
        gain = hit.groupBy(group, item, "n_terms").agg(F.count_if(F.col("_t").isNotNull() & F.col("_hit").isNull()).alias("_gain"))
        best = gain.groupBy(group).agg(F.min_by(F.struct(item, "n_terms"), F.struct(-F.col("_gain"), item)).alias("_b"))
        if not picks.add(best.select(group, F.col("_b")[item].alias(item), F.lit(k + 1).alias("pick"), "_b.n_terms")):
            break
        new = items.join(picks.part(-1).select(group, item), [group, item]).select(group, F.explode("_ts").alias("_t"))
        covered.add(new.join(covered.df, [group, "_t"], "left_anti").distinct() if k else new)
    return picks.df


def first_seen_rank(df: DataFrame, keys: list[str], path: str, rank: str) -> DataFrame:
    """Paths of each list in the order of their first row, numbered from 1."""
    first = df.groupBy(*keys, path).agg(F.min(rank).alias("_first"))
    return first.withColumn("path_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", path))).drop("_first")


def shortest(df: DataFrame, width: Column, keys: list[str], tie: list) -> DataFrame:
    """Rows of the smallest width per key, with the number of rows that share it."""
    ranked = df.withColumn("_w", width).withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy("_w"))).where("_r = 1")
    return ranked.withColumn("n_best", F.count(F.lit(1)).over(Window.partitionBy(*keys))).drop("_w", "_r")
