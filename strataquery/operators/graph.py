"""Bounded graph questions over edge tables (source, target). Loops run on the driver, one join per level; each level is
written as a table of its own, so plans stay short and nothing is written twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.sources.stored import Parts, stored


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the folder that all executors share and read from there: its lineage ends, and plans over it
    know its size."""
    return stored(df, "graph")


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of all nodes within max_depth steps from the seeds (node), each at its least depth. Distinct edges
    are written once; each level is one job, which writes its new nodes as a part of the answer and tells their number."""
    e = cut(edges.select("source", "target").distinct())
    seen = Parts(e.sparkSession, "levels")
    seen.add(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        nxt = seen.part(-1).join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        if not seen.add(nxt.join(seen.df.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))):
            break
    return seen.df


def reverse_levels(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    return levels(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), seeds, max_depth)


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False, with_seeds: bool = False) -> DataFrame:
    found = (reverse_levels if reverse else levels)(edges, seeds, max_depth)
    return found if with_seeds else found.where("depth > 0")


def unconditional(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without a condition on them or on either end, and the others (unless an unconditional twin exists)."""
    held = nodes.where("marker IS NOT NULL").select(F.col("node").alias("n")).distinct()
    e = edges.join(held.select(F.col("n").alias("source"), F.lit(True).alias("_s")), "source", "left").join(held.select(F.col("n").alias("target"), F.lit(True).alias("_t")), "target", "left")
    cond = F.col("marker").isNotNull() | F.col("_s").isNotNull() | F.col("_t").isNotNull()
    free = e.where(~cond).select("source", "target").distinct()
    return free, e.where(cond).select("source", "target").distinct().join(free, ["source", "target"], "left_anti")


def walk(edges: DataFrame, nodes: DataFrame, start: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes reached over unconditional edges, and what was left out: (reason, node)."""
    free, cond = unconditional(edges, nodes)
    found = levels(free, start, max_depth)
    inner = found.where(F.col("depth") < max_depth).select("node")
    held = inner.join(nodes.where("marker IS NOT NULL").select("node").distinct(), "node", "left_semi").withColumn("reason", F.lit("conditional-selection"))
    edge = inner.join(held.select("node"), "node", "left_anti").join(cond.select(F.col("source").alias("node")).distinct(), "node", "left_semi").withColumn("reason", F.lit("conditional-edge"))
    out = edges.select(F.col("source").alias("node")).distinct()
    deep = found.where(F.col("depth") == max_depth).select("node").join(out, "node", "left_semi").withColumn("reason", F.lit("depth-limit"))
    return found, held.unionByName(edge).unionByName(deep).select("reason", "node")


def simple_paths(edges: DataFrame, start: DataFrame, target: int | str, max_depth: int) -> DataFrame:
    """Paths without repeated nodes from the start nodes to the target, shortest first by depth: (path, depth). All of them:
    `dependency.bounded_paths` has limits."""
    e = cut(edges.select("source", "target").distinct())
    now = start.select(F.array("node").alias("path"))
    out = now.where(F.element_at("path", -1) == target).withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = now.where(F.element_at("path", -1) != target).join(e, F.element_at("path", -1) == F.col("source"))
        now = cut(step.where(~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path")))
        if now.isEmpty():
            break
        out = out.union(now.where(F.element_at("path", -1) == target).withColumn("depth", F.lit(depth)))
    return out


def adjacency(edges: DataFrame, seeds: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Neighbours of the seeds on either side of an edge, with the summed weights of its kinds."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("kind")], F.lit(0.0))
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "kind").union(edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "kind"))
    return both.join(seeds, "node", "left_semi").groupBy("neighbour").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n"))


def stale_nodes(nodes: DataFrame, before: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Equality cutoff: nodes whose own digest changed, and what depends on them within max_depth."""
    changed = nodes.join(before.select("node", F.col("digest").alias("was")), "node", "left").where(~F.col("digest").eqNullSafe(F.col("was"))).select("node")
    return reverse_levels(edges, changed, max_depth)
