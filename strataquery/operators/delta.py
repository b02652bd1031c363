"""Deltas between two snapshots, overlays and table maintenance without MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_delta(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison by key: added, removed, changed or unchanged; columns besides `values` don't count."""
    l = before.select(*keys, F.struct(*values).alias("_l"))  # noqa: E741
    r = after.select(*keys, F.struct(*values).alias("_r"))
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.col("_l").eqNullSafe(F.col("_r")), "unchanged").otherwise("changed")
    return l.join(r, keys, "full_outer").select(*keys, status.alias("status"))


def multiset_delta(before: DataFrame, after: DataFrame, identity: list[str]) -> DataFrame:
    """How often each identity occurs before and after."""
    b = before.groupBy(*identity).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(*identity).agg(F.count(F.lit(1)).alias("n_after"))
    both = b.join(a, identity, "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("added", F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0))).withColumn("removed", F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0)))


def relocations(before: DataFrame, after: DataFrame, facts: list[str], place: str) -> DataFrame:
    """Facts that stand exactly once on either side, at different places."""
    once = lambda df, name: df.groupBy(*facts).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias(name)).where("_n = 1").drop("_n")
    return once(before, "was_at").join(once(after, "now_at"), facts).where("was_at <> now_at")


def overlay(base: DataFrame, over: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Overlay rows, then base rows whose key is neither changed nor overlaid."""
    kept = base.join(changed.select(key).union(over.select(key)).distinct(), key, "left_anti")
    return over.withColumn("layer", F.lit("overlay")).unionByName(kept.withColumn("layer", F.lit("base")))


def replace_children(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after all rows of the keys that `new` names are replaced by those in `new`."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_paths(df: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    return df.join(paths.select(key), key, "left_anti")


def collapse_descendants(paths: DataFrame) -> DataFrame:
    """Paths none of whose folders is itself selected: each path's own folder prefixes meet the paths by equality."""
    from strataquery.functions.text import folder_prefixes

    inside = paths.select("path", F.explode(folder_prefixes(F.col("path"))).alias("folder")).join(paths.select(F.col("path").alias("folder")).distinct(), "folder", "left_semi")
    return paths.join(inside.select("path").distinct(), "path", "left_anti")


def coverage(changed: DataFrame, evidence: DataFrame, depends: DataFrame, key: str = "path") -> DataFrame:
    """Changed keys as direct (in the evidence), dependent (only in its dependencies) or uncovered."""
    e, d = evidence.select(key).distinct().withColumn("_e", F.lit(True)), depends.select(key).distinct().withColumn("_d", F.lit(True))
    state = F.when(F.col("_e"), "direct").when(F.col("_d"), "dependent").otherwise("uncovered")
    return changed.join(e, key, "left").join(d, key, "left").select(key, state.alias("state"))


def reuse(current: DataFrame, cached: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Whether a cached row still holds: every field equal, nulls included."""
    c = cached.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_hit"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return current.join(c, key, "left").select(key, F.when(F.col("_hit").isNull(), "new").when(same, "reuse").otherwise("refresh").alias("action"))


def freshness(recorded: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Three-valued: true for an equal digest, false for another, null where there is no observation."""
    return recorded.join(observed.select(key, F.col("digest").alias("_now")), key, "left").select(key, F.when(F.col("_now").isNotNull(), F.col("digest") == F.col("_now")).alias("fresh"))
