"""Deltas of evidence: axes, structured values, bindings, declarations, claims and graphs. All are full outer
comparisons by key; what can't be compared is said, never guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.functions.jsons import json_changes

#: The axes along which two observations of one thing may differ.
AXES = "repository_identity repository_generation definition resolution observation adapter provenance inputs topology content qualification coverage ownership".split()


def axis_state(before: Column, after: Column) -> Column:
    """changed, unchanged, unknown (neither side tells) or not-comparable (one side tells)."""
    return F.when(before.isNull() & after.isNull(), "unknown").when(before.isNull() | after.isNull(), "not-comparable").when(before == after, "unchanged").otherwise("changed")


def change_axes(before: DataFrame, after: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(key, axis, state) for keys of both sides, over the named columns."""
    l = before.select(key, F.struct(*axes).alias("_l"))  # noqa: E741
    both = l.join(after.select(key, F.struct(*axes).alias("_r")), key)
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), axis_state(F.col("_l")[a].cast("string"), F.col("_r")[a].cast("string")).alias("state")) for a in axes])
    return both.select(key, F.explode(rows).alias("x")).select(key, "x.axis", "x.state")


def semantic_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, path, op, value): what adds, replaces or deletes parts of the JSON before so that it becomes the JSON after,
    by JSON pointers and canonical values. A key of one side only adds or deletes the whole document, at the path ''; a
    null key is a key. Keys should be unique on either side."""
    l = before.select(F.col(key).alias("_key"), F.col(value).alias("_l"))  # noqa: E741
    r = after.select(F.col(key).alias("_other"), F.col(value).alias("_r"))
    both = l.join(r, F.col("_key").eqNullSafe(F.col("_other")), "full_outer")
    return json_changes(both.select(F.coalesce("_key", "_other").alias(key), "_l", "_r"), key, "_l", "_r")


def binding_delta(before: DataFrame, after: DataFrame, keys: list[str], state: str, values: list[str]) -> DataFrame:
    """Bindings by key: added, removed, state-changed (another resolution), changed (another target) or unchanged. A null
    in a key is a value like any other."""
    l = before.select(F.struct(*keys).alias("_k"), F.struct(state, *values).alias("_l"))  # noqa: E741
    r = after.select(F.struct(*keys).alias("_o"), F.struct(state, *values).alias("_r"))
    both = l.join(r, reduce(lambda a, b: a & b, [F.col("_k")[k].eqNullSafe(F.col("_o")[k]) for k in keys]), "full_outer").select(*[F.coalesce(F.col("_k")[k], F.col("_o")[k]).alias(k) for k in keys], "_l", "_r")
    same = lambda names: F.struct(*[F.col("_l")[n] for n in names]).eqNullSafe(F.struct(*[F.col("_r")[n] for n in names]))
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~same([state]), "state-changed").when(~same(values), "changed").otherwise("unchanged")
    return both.select(*keys, status.alias("status"))


def declaration_delta(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """Groups of declarations (group, subject, value): how many subjects came, went or changed their value, and how the
    set of values changed."""
    l = before.groupBy(group, "subject").agg(F.array_sort(F.collect_set("value")).alias("was"))  # noqa: E741
    both = l.join(after.groupBy(group, "subject").agg(F.array_sort(F.collect_set("value")).alias("now")), [group, "subject"], "full_outer")
    n = lambda c, name: F.count_if(c).alias(name)
    return both.groupBy(group).agg(
        n(F.col("was").isNull(), "subjects_added"), n(F.col("now").isNull(), "subjects_removed"), n(F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now")), "values_changed"), n(F.col("was") == F.col("now"), "unchanged"),
    )


def claim_delta(before: DataFrame, after: DataFrame, keys: list[str], producer: str = "producer") -> DataFrame:
    """Per producer: claims added, removed and kept. Producers are never mixed, and no cause is inferred. A claim with a null
    is like no other, so it isn't kept. Both sides are counted in one grouping, without a join of them."""
    side = lambda df, l, r: df.select(producer, *keys, F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    both = side(before, True, False).union(side(after, False, True)).groupBy(producer, *keys).agg(F.bool_or("_l").alias("_l"), F.bool_or("_r").alias("_r"))
    l, r = F.col("_l"), F.col("_r")  # noqa: E741
    alike = l & r & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [producer, *keys]])
    return both.groupBy(producer).agg(F.count_if(r & ~alike).alias("added"), F.count_if(l & ~alike).alias("removed"), F.count_if(alike).alias("kept"))


def locality_delta(before: DataFrame, after: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degrees of nodes of two edge tables (source, target), by `nodes` (node, comparable): nodes marked as not
    comparable (truncated on either side) get no difference, only the reason."""
    degree = lambda e, name: e.select("source", "target").distinct().groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias(name))
    rows = nodes.join(degree(before, "was"), "node", "left").join(degree(after, "now"), "node", "left").na.fill(0, ["was", "now"])
    difference = F.when(F.col("comparable"), F.col("now") - F.col("was"))
    return rows.select("node", "was", "now", difference.alias("difference"), F.when(~F.col("comparable"), "truncated-endpoint").alias("reason"))
