"""Work that costs what has changed: values recomputed with equality cutoff, and counts kept by signed deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.operators.graph import cut
from strataquery.sources.stored import Parts


def recomputed(nodes: DataFrame, edges: DataFrame, before: DataFrame, changed: DataFrame, value: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """(node, value, changed): the nodes that had to be computed again after the own values of some (`changed`: node) have
    changed, and whether their value came out another one.

    before: (node, value, height) of `packets.evaluated`, over the same edges (source depends on target). Heights are gone
    through from below: a node is computed once, when all that it depends on is settled, and only if one of these has
    really changed; where the value stays the same, what depends on it isn't looked at. Nodes that were not settled
    before (on circles) stay out. A wave is one job for its values and one for what it calls upon. It meets the nodes and
    edges of its height alone, and its joins are merged, never broadcast, for each of them would send up to a broadcast's
    size through the driver."""
    spark = nodes.sparkSession
    known = cut(before.where("height IS NOT NULL").select("node", F.col("value").alias("was"), "height"))
    named = lambda name, *columns: known.select(F.col("node").alias(name), *columns).hint("merge")
    old = cut(known.join(nodes.select("node", F.col(value).alias("own")).hint("merge"), "node"))
    e = edges.select("source", "target").distinct().join(named("source", F.col("height").alias("at")), "source")
    e = cut(e.join(named("target", "was", F.col("height").alias("below")), "target"))
    asked, done = Parts(spark, "asked"), Parts(spark, "again")
    heights = lambda df: asked.add(df, [F.collect_set("height").alias("at")])[1]["at"]  # noqa: E731  as many as the graph is high
    open_ = set(heights(old.join(changed.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "height")))
    kind = dict(before.dtypes)["value"]
    while open_:
        at = min(open_)
        open_.discard(at)
        wave = asked.df.where(F.col("height") == at).select("node").distinct()
        now = done.df.where("changed").select(F.col("node").alias("target"), F.col("value").alias("_now")) if done.rows else old.limit(0).select(F.col("node").alias("target"), F.col("was").alias("_now"))
        needs = e.where(F.col("at") == at).join(wave.withColumnRenamed("node", "source").hint("merge"), "source", "left_semi")
        theirs = needs.join(now.hint("merge"), "target", "left").groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_list(F.coalesce("_now", "was"))).alias("_vs"))
        again = old.where(F.col("height") == at).join(wave.hint("merge"), "node").join(theirs.hint("merge"), "node", "left").withColumn("value", combine(F.col("own"), F.coalesce("_vs", F.array().cast(f"array<{kind}>"))))
        done.add(again.select("node", "value", (~F.col("value").eqNullSafe(F.col("was"))).alias("changed")))
        upon = e.where(F.col("below") == at).join(done.part(-1).where("changed").select(F.col("node").alias("target")).hint("merge"), "target", "left_semi")
        open_ |= set(heights(upon.select(F.col("source").alias("node"), F.col("at").alias("height")).distinct()))
    return done.df if done.rows else old.limit(0).select("node", F.col("was").alias("value"), F.lit(True).alias("changed"))


def overlaid(before: DataFrame, again: DataFrame) -> DataFrame:
    """(node, value) after a recomputation."""
    new = again.where("changed").select("node", F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    return before.join(new, "node", "left").select("node", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def signed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): by how much each key's count changes when old rows go and new ones come; keys that don't change are
    left out."""
    rows = old.select(*keys, F.lit(-1).alias("_s")).unionByName(new.select(*keys, F.lit(1).alias("_s")))
    return rows.groupBy(*keys).agg(F.sum("_s").alias("n")).where("n <> 0")


class KeptCounts:
    """Counts by key that are kept up to date: what was counted first, and a small signed part for each change since.

    A change costs its own rows, before and after; nothing else is read. The counts are the sums over all parts; when many
    have gathered, `compacted` writes them as one."""

    def __init__(self, rows: DataFrame, keys: list[str]) -> None:
        self.keys, self.parts = keys, Parts(rows.sparkSession, "counts")
        self.parts.add(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))

    def change(self, old: DataFrame, new: DataFrame) -> int:
        """Takes the old rows of what changed out and the new ones in; by how many keys the counts differ."""
        return self.parts.add(signed(old, new, self.keys))

    @property
    def df(self) -> DataFrame:
        """(keys, n) of all keys that have rows."""
        return self.parts.df.groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def compacted(self) -> KeptCounts:
        kept = KeptCounts.__new__(KeptCounts)
        kept.keys, kept.parts = self.keys, Parts(self.parts.spark, "counts")
        kept.parts.add(self.df)
        return kept


def changed_rows(table: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    return table.join(paths.select(key).distinct(), key, "left_semi")


def refresh_all(counts: dict[str, KeptCounts], before: dict[str, DataFrame], after: dict[str, DataFrame], paths: DataFrame) -> dict[str, int]:
    """Brings several kept counts up to date for some paths: before and after hold each one's rows (with a path)."""
    return {name: kept.change(changed_rows(before[name], paths), changed_rows(after[name], paths)) for name, kept in counts.items()}
