"""Longest-processing-time scheduling into a fixed number of parts.

Items of equal weight are alike to the heap, so a run of them is placed at once, with the very loads that one item at a
time would give."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def place_run(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n items of one size each part gets when each goes to the least-loaded one, ties by part number.

    The heap hands out the n smallest of the pairs (load + j x size, part), j = 0, 1, ..; a binary search finds the
    load up to which all are handed out."""
    if n <= 4 * len(loads):
        heap, counts = [(v, s) for s, v in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(n):
            v, s = heap[0]
            counts[s] += 1
            heapq.heapreplace(heap, (v + size, s))
        return counts
    taken = lambda top: [max(0, (top - v) // size + 1) if top >= v else 0 for v in loads]
    low, high = min(loads) - 1, max(loads) + size * n
    while high - low > 1:  # the largest load up to which at most n are taken
        mid = (low + high) // 2
        low, high = (mid, high) if sum(taken(mid)) <= n else (low, mid)
    counts = taken(low)
    rest = n - sum(counts)
    for s, v in enumerate(loads):
        if rest and v <= high and (high - v) % size == 0:
            counts[s] += 1
            rest -= 1
    return counts


def lpt_plan(runs: list[tuple[int, int]], parts: int) -> list[list[int]]:
    """For runs (size, items) in descending order of size: the rank below which each part's share of the run ends."""
    loads, out = [0] * parts, []
    for size, n in runs:
        counts = place_run(loads, size, n)
        ends, at = [], 0
        for s, c in enumerate(counts):
            loads[s] += c * size
            at += c
            ends.append(at)
        out.append(ends)
    return out


#: Items of one weight that are ranked together; beyond, a weight's items are cut by hash into parts of about so many.
TOGETHER = 100_000


def rank_in_run(items: DataFrame, counts: dict[int, int], weight: str, key: str) -> DataFrame:
    """Adds `_r`: gapless ranks from 0 among the items of one weight, by key; of a weight with more than `TOGETHER` items
    by part and key, parts being ranked apart. Their offsets are fewer rows than items / `TOGETHER` + 2 x weights cut."""
    most = max(TOGETHER, sum(counts.values()) // 4096)
    parts = items.sparkSession.createDataFrame([(w, -(-n // most)) for w, n in counts.items() if n > most], f"{weight} long, _parts long")  # fewer than 4,096 rows
    dealt = items.join(F.broadcast(parts), weight, "left").withColumn("_part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    held = dealt.join(F.broadcast(parts.select(weight)), weight, "left_semi").groupBy(weight, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(weight).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(weight, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # below 2 x 4,096 rows
    inside = F.row_number().over(Window.partitionBy(weight, "_part").orderBy(key)) - 1
    return dealt.withColumn("_i", inside).join(F.broadcast(offsets), [weight, "_part"], "left").withColumn("_r", F.col("_i") + F.coalesce("_offset", F.lit(0))).drop("_i", "_part", "_offset")


def balanced(items: DataFrame, key: str, weight: str, parts: int) -> DataFrame:
    """(key, weight, part) for items with unique keys and positive whole weights. The driver holds how many items there are
    of each weight: at most the square root of twice the sum of all weights, for different weights add up to that."""
    runs = {r[weight]: r["count"] for r in items.groupBy(weight).count().toLocalIterator()}
    order = sorted(runs.items(), reverse=True)
    plan = items.sparkSession.createDataFrame([(w, e) for (w, _), e in zip(order, lpt_plan(order, parts), strict=True)], f"{weight} long, ends array<long>")
    ranked = rank_in_run(items.select(key, weight), runs, weight, key)
    return ranked.join(plan, weight).select(key, weight, F.size(F.filter("ends", lambda e: e <= F.col("_r"))).cast("int").alias("part"))
