"""Exact top-k search by integer inner product, with pivot-table elimination.

Vectors are quantised to floor(64 x). Distances to `PIVOTS` pivots (rows chosen by a hash of their id) are computed once
for each vector, in double precision, and travel with it. For a query and a candidate, the largest difference of their
distances to a pivot is a lower bound on their own distance, hence an upper bound on their inner product:
q.x = (|q|^2 + |x|^2 - d^2) / 2. Candidates are evaluated in the order of that bound until none left can reach the k-th
best score. Leaves of `LEAF` candidates with the least and largest distance to each pivot go first, as a whole.

Rows are dealt to candidate blocks by nearest pivot (a pivot with many rows has several blocks, by hash), queries to
query blocks. Every query first searches the block it falls into itself; the k-th score found there is its threshold in
all other blocks, so only candidates that may still count leave a task. Both kinds of block hold up to `BLOCK` rows, so
a vector is sent once for each `BLOCK` queries and a query once for each block.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id;
vectors meet only vectors of equal length; a candidate with the query's own id counts as the query's own row; a query id
on several rows is asked once (the smallest vector); ties go to the smaller vec_id; a query has as many rows as there
are candidates, k at most; an empty table gives an empty result; other columns are ignored. Vectors with components
from `SMALL` on have no bound and are always evaluated, with Python's integers, and scores are held to the range of
long; 64 x beyond the largest double counts as that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.llm.common import map_groups, stored
from strataquery.llm.vectors import by_dimension, usable

PIVOTS, BLOCK, LEAST, CHUNK, LEAF = 32, 65536, 4096, 512, 64
#: Components below this have exact sums of squares in double precision in up to 2^13 dimensions.
SMALL = 2.0**20


def quantised(x: np.ndarray) -> np.ndarray:
    most = np.finfo(float).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(64.0 * x), -most, most)


def is_small(q: np.ndarray) -> np.ndarray:
    return (np.abs(q).max(1, initial=0) < SMALL) & (q.shape[1] <= 1 << 13)


def pivot_table(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots; 0 for rows that are not small, whose bound comes from an infinite norm."""
    small = is_small(q)
    x = np.where(small[:, None], q, 0.0)
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.where(small[:, None], np.sqrt(np.maximum(d, 0.0)), 0.0)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    most = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
    if most * most * len(q) < 2.0**53:
        return (x @ q).astype(np.int64)
    dots = x.astype(object) if most > 2.0**60 else x.astype(np.int64).astype(object)
    dots = [int(sum(int(a) * int(b) for a, b in zip(r, q, strict=True))) for r in dots]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in dots], np.int64)


class Block:
    """Candidates of one block, in leaves of rows that lie alike to the pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        small = is_small(x)
        second = np.argsort(table, axis=1)[:, 1] if table.shape[1] > 1 else np.zeros(len(ids), np.int64)
        order = np.lexsort((ids, table.min(1, initial=np.inf), second, ~small))
        self.ids, self.x, small = ids[order], x[order], small[order]
        self.table = np.ascontiguousarray(table[order].T)
        self.norms = np.where(small, (np.where(small[:, None], self.x, 0.0) ** 2).sum(1), np.inf)
        self.starts = np.arange(0, len(ids), LEAF)
        self.low, self.high = (f.reduceat(self.table, self.starts, axis=1) for f in (np.minimum, np.maximum))
        self.norm = np.maximum.reduceat(self.norms, self.starts)
        #: Twice the rounding error of the largest distance.
        self.slack = 1e-15 * float(self.table.max(initial=0.0))

    def bounds(self, qq: float, norms: np.ndarray, low: np.ndarray, own: np.ndarray) -> np.ndarray:
        low = np.maximum(low - self.slack - 1e-15 * float(own.max(initial=0.0)), 0.0)
        return (qq + norms) * (0.5 + 1e-12) + 1e-3 - 0.5 * low**2

    def search(self, qid: int, q: np.ndarray, own: np.ndarray, k: int, worst: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k candidates for one query that score at least `worst`."""
        if len(own) and bool(is_small(q[None, :])[0]):
            qq = float(q @ q)
            apart = np.maximum(self.low - own[:, None], own[:, None] - self.high).max(0)
            leaves = self.bounds(qq, self.norm, np.maximum(apart, 0.0), own) >= worst
            rows = np.arange(len(self.ids)) if leaves.all() else np.flatnonzero(np.repeat(leaves, np.diff(np.append(self.starts, len(self.ids)))))
            table, norms = (self.table, self.norms) if len(rows) == len(self.ids) else (self.table[:, rows], self.norms[rows])
            bound = self.bounds(qq, norms, np.abs(table - own[:, None]).max(0, initial=0.0), own)
        else:
            rows = np.arange(len(self.ids))
            bound = np.full(len(rows), np.inf)
        may = (bound >= worst) & (self.ids[rows] != qid)
        rows, bound = rows[may], bound[may]
        have_i, have_s = np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = CHUNK
        while len(rows):
            if len(rows) > size:  # the next candidates in the order of their bounds
                split = np.argpartition(-bound, size)
                now, later = rows[split[:size]], split[size:]
                rows, bound = rows[later], bound[later]
            else:
                now, rows, bound = rows, rows[:0], bound[:0]
            have_i, have_s = np.concatenate((have_i, self.ids[now])), np.concatenate((have_s, exact_scores(self.x[now], q)))
            best = np.lexsort((have_i, -have_s.astype(object) if have_s.min(initial=0) == -(2**63) else -have_s))[:k]
            have_i, have_s = have_i[best], have_s[best]
            if len(have_i) == k:
                worst = max(worst, float(have_s[-1]))
                may = bound >= worst
                rows, bound = rows[may], bound[may]
            size *= 8
        keep = have_s >= worst
        return have_i[keep], have_s[keep]


def top_k(vectors: DataFrame, queries: F.Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for rows (vec_id, embedding); `queries` is the condition of a query row."""
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", queries.cast("int").alias("asks"))
    plain = F.forall("embedding", lambda x: F.abs(x) < SMALL / 64)
    chosen = [r["embedding"] for r in rows.where(plain & (F.size("embedding") <= 1 << 13)).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "embedding").limit(PIVOTS).collect()]
    pivots = {d: quantised(np.array([p for p in chosen if len(p) == d], float)) for d in {len(p) for p in chosen}}

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_dimension(b.column(1)):
                q = quantised(x)
                table = pivot_table(q, pivots[q.shape[1]]) if q.shape[1] in pivots else np.zeros((len(q), 0))
                home = np.where(is_small(q), table.argmin(1), 0) if table.shape[1] else np.zeros(len(q), np.int64)
                coded = q.astype(np.int16) if np.abs(q).max(initial=0) < 2**15 else q
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(np.full(len(at), q.shape[1]), pa.int64()), pa.array(home.astype(np.int64)), pa.array([r.tobytes() for r in coded], pa.binary()), pa.array([r.tobytes() for r in table], pa.binary())],
                    ["vec_id", "asks", "dim", "home", "q", "pivot_table"],
                )

    ready = stored(rows.mapInArrow(prepare, "vec_id long, asks int, dim long, home long, q binary, pivot_table binary"), "topk-vectors")
    # One row for each pivot of each length of vector.
    held = ready.groupBy("dim", "home").agg(F.count(F.lit(1)).alias("n"), F.sum("asks").alias("asked")).orderBy("dim", "home").collect()
    if not held:
        return ready.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    block = min(BLOCK, max(LEAST, sum(r["n"] for r in held) // 64))
    parts = [-(-r["n"] // block) for r in held]
    firsts = np.concatenate(([0], np.cumsum(parts)))
    of_dim = {d: [i for i, r in enumerate(held) if r["dim"] == d] for d in {r["dim"] for r in held}}
    asked = {d: sum(held[i]["asked"] or 0 for i in at) for d, at in of_dim.items()}
    layout = [(r["dim"], r["home"], p, int(f), int(firsts[of_dim[r["dim"]][0]]), int(firsts[of_dim[r["dim"]][-1] + 1]), max(1, -(-asked[r["dim"]] // block))) for r, p, f in zip(held, parts, firsts, strict=False)]
    shape = ready.sparkSession.createDataFrame(layout, "dim long, home long, parts long, first long, low long, high long, shares long")
    placed = ready.join(F.broadcast(shape), ["dim", "home"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id", "q", F.lit(3)), F.col("parts")))
    asking = placed.where("asks = 1").groupBy("vec_id", "dim").agg(F.min(F.struct("q", "pivot_table", "block", "low", "high", "shares")).alias("v")).select("vec_id", "dim", "v.*")
    none = F.lit(None).cast("long")
    columns = ["dim", "c", "a", "role", "vec_id", "q", "pivot_table", "least"]
    stay = placed.select("dim", F.col("block").alias("c"), F.lit(0).cast("long").alias("a"), F.lit(0).alias("role"), "vec_id", "q", "pivot_table", none.alias("least"))
    home = asking.select("dim", F.col("block").alias("c"), F.lit(0).cast("long").alias("a"), F.lit(1).alias("role"), "vec_id", "q", "pivot_table", none.alias("least"))

    def decoded(raw: list[bytes], dim: int) -> np.ndarray:
        return np.stack([np.frombuffer(r, np.int16 if len(r) == 2 * dim else np.float64).astype(np.float64) for r in raw])

    def search(parts: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for t, starts in parts:
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                g = t.slice(i, j - i)
                dim, role, ids, least = g["dim"][0].as_py(), g["role"].to_numpy(), g["vec_id"].to_numpy(), g["least"].to_pylist()
                c, asks = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
                if not len(c) or not len(asks):
                    continue
                v = decoded(g["q"].to_pylist(), dim)
                p = np.stack([np.frombuffer(r, np.float64) for r in g["pivot_table"].to_pylist()])
                cell = Block(ids[c], v[c], p[c])
                found = [cell.search(ids[r], v[r], p[r], k, -np.inf if least[r] is None else float(least[r])) for r in asks]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[asks], [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    result = "query_id long, vec_id long, score long"
    near = stored(map_groups(stay.select(columns).union(home.select(columns)), ["dim", "c", "a"], search, result), "topk-home")
    least = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")).withColumnRenamed("query_id", "vec_id")
    spread = placed.select("dim", F.col("block").alias("c"), F.explode(F.expr("sequence(0L, shares - 1)")).alias("a"), F.lit(0).alias("role"), "vec_id", "q", "pivot_table", none.alias("least"))
    others = F.explode(F.expr("filter(sequence(low, high - 1), c -> c <> block)")).alias("c")
    travel = asking.join(least, "vec_id", "left").select("dim", others, F.pmod(F.xxhash64("vec_id"), F.col("shares")).alias("a"), F.lit(1).alias("role"), "vec_id", "q", "pivot_table", "least")
    far = map_groups(spread.select(columns).union(travel.select(columns)), ["dim", "c", "a"], search, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.union(far).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
