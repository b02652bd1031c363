"""Packing into optimal length buckets.

A dynamic program over the global histogram of exact lengths chooses the bucket boundaries that minimise padding;
inside each bucket, batches are filled up to a token budget. A text's length is its UTF-8 bytes plus one end mark, the
tokens of a byte-level model; any integer column serves. The driver holds one bin for each distinct length, at most the
square root of twice the sum of all lengths: 245,000 for 30 GB, 14 million for 100 TB. The best split before a boundary
only moves forward as the boundary does, so a layer of the program takes D log D steps (divide and conquer, a level at
a time in numpy), not D squared.

Edge cases: a null text has length 1 (the end mark), a null length is 0; a text longer than the budget forms a batch of its own and is
never cut; an empty table gives an empty result; rows with equal ids are packed separately, ties in id and
length in any order (such rows are alike); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm.common import dense_rank_in, stored


def best_splits(best: np.ndarray, top: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j in 1 .. n, the i < j of the least best[i] + cost of one bucket over bins i .. j - 1, and that least."""
    n = len(top)
    at, least = np.zeros(n + 1, np.int64), np.full(n + 1, best[-1])
    # Runs of j still open, with the bounds of their best i; the middle of each is settled, then both halves.
    a, b, low, high = (np.array([x], np.int64) for x in (1, n, 0, n - 1))
    while len(a):
        j = (a + b) // 2
        width = np.minimum(high, j - 1) - low + 1
        first = np.concatenate(([0], np.cumsum(width)[:-1]))
        i = np.arange(int(width.sum())) - np.repeat(first - low, width)
        jj = np.repeat(j, width)
        cost = best[i] + top[jj - 1] * (c[jj] - c[i]) - (s[jj] - s[i])
        m = np.minimum.reduceat(cost, first)
        hit = np.flatnonzero(cost == np.repeat(m, width))
        opt = i[hit[np.searchsorted(hit, first)]]
        at[j], least[j] = opt, m
        a, b, low, high = (np.concatenate(x) for x in ((a, j + 1), (j - 1, b), (low, opt), (opt, high)))
        some = a <= b
        a, b, low, high = a[some], b[some], low[some], high[some]
    return at, least


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper boundaries of at most `buckets` runs of the distinct lengths (ascending) with the least total padding."""
    n = len(lengths)
    if not n:
        return []
    # Integers while no sum can overflow; beyond, floats with 64 bits of mantissa.
    kind = np.int64 if int(max(lengths)) * sum(counts) < 2**61 else np.longdouble
    top = np.array(lengths, kind)
    c, s = (np.concatenate((np.zeros(1, kind), np.cumsum(np.array(x, kind)))) for x in (counts, top * np.array(counts, kind)))
    # One bucket for all bins up to each, then one bucket more in each layer.
    best, back = np.concatenate((s[:1], top * c[1:] - s[1:])), [np.where(np.arange(n + 1) > 0, 0, -1)]
    for _ in range(min(buckets, n) - 1):
        at, least = best_splits(best, top, c, s)
        better = least < best
        better[0] = False
        back.append(np.where(better, at, -1))
        best = np.where(better, least, best)
    out, j, k = [], n, len(back) - 1
    while j > 0:
        if back[k][j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(back[k][j])
        k -= 1
    return out[::-1]


def pack(docs: DataFrame, length: F.Column, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch (unique over buckets), slot in the batch, padding."""
    spread = F.crc32(F.col("text").cast("binary")) if "text" in docs.columns else F.lit(0)
    rows = stored(docs.select("doc_id", F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"), spread.cast("long").alias("spread")), "packing")
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    lengths, counts = histogram["n_tokens"].to_pylist(), histogram["n"].to_pylist()
    tops = best_boundaries(lengths, counts, buckets) or [1]
    ends = np.searchsorted(np.array(lengths, np.int64), tops, "right")
    sums = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
    held = np.diff(np.concatenate(([0], sums[ends]))).tolist()
    room = [max(1, budget // max(1, t)) for t in tops]
    first = np.concatenate(([0], np.cumsum([-(-h // r) for h, r in zip(held, room, strict=True)])))[:-1]
    pick = lambda values, b: F.element_at(F.array(*[F.lit(int(v)) for v in values]), b + 1).cast("long")
    bucket = sum([(F.col("n_tokens") > F.lit(t)).cast("int") for t in tops[:-1]], F.lit(0))
    ranked = dense_rank_in(rows.withColumn("bucket", bucket.cast("int")), "bucket", ["doc_id", "n_tokens", "spread"], "_at")
    b = F.col("bucket")
    return ranked.select(
        "doc_id", "n_tokens", "bucket", pick(tops, b).alias("bucket_len"), (pick(first, b) + F.floor(F.col("_at") / pick(room, b))).cast("long").alias("batch"),
        (F.col("_at") % pick(room, b)).cast("int").alias("slot"), (pick(tops, b) - F.col("n_tokens")).alias("padding"),
    )


def byte_length() -> F.Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)) + 1


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_length())
