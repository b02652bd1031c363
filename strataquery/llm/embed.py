"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations (Andoni et al., 2015).

Equal vectors collapse to one class that carries their number. A class vector is padded to a power of two and rotated by
three rounds of random signs and a Walsh-Hadamard transform; its hash is the nearest signed axis. Each table joins
several such hashes to a bucket; a vector stands in its own bucket and also probes the `PROBES` next likely ones
(multiprobe). Pairs that meet are verified by cosine in double precision.

The number of hashes follows the number of classes, so that a bucket holds about `FILL` of them; the number of tables
follows both the hashes and the dimension (`tables_for`): so many, `TABLES` at least, that of random pairs just at the
threshold a share of `RECALL` meets. Each padded dimension of a table has its own numbers.

A pair that meets in several tables is counted in the first only (the hashes travel with the vectors), so links are
counted where they are found and only counts and spanning links leave a task, never all pairs. Buckets of more than
`BLOCK` rows are cut into blocks and compared block pair by block pair.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
without an id; vectors meet only vectors of equal length; repeated rows are separate vectors that link; rows with one
vec_id count as one node of a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm.common import components, map_groups, stored
from strataquery.llm.vectors import by_dimension, usable

TABLES, PROBES, BLOCK, SMALL = 6, 3, 4096, 200_000
FILL, RECALL, MOST = 64, 0.99, 192


def padded(d: int) -> int:
    return max(2, 1 << (d - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(x: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES, seed: int = 17) -> np.ndarray:
    """Buckets of unit vectors: rows x tables x (1 + probes), each vector's own bucket first."""
    n, d0 = x.shape
    d = padded(d0)
    x = np.pad(x, ((0, 0), (0, d - d0)))
    rng = np.random.default_rng([seed, d])
    out = np.zeros((n, tables, 1 + probes), np.int64)
    if not hashes:
        return out
    rows = np.arange(n)
    for t in range(tables):
        axes, gaps = [], []
        for _ in range(hashes):
            y = x
            for signs in rng.choice([-1.0, 1.0], (3, d)):
                y = hadamard(y * signs)
            size = np.abs(y)
            near = np.argsort(-size, axis=1, kind="stable")[:, : min(d, probes + 1)]
            axes.append(2 * near + (y[rows[:, None], near] < 0))
            gaps.append(size[rows, near[:, 0]][:, None] - size[rows[:, None], near])
        weight = (2 * d) ** np.arange(hashes)
        own = sum(a[:, 0] * w for a, w in zip(axes, weight, strict=True))
        out[:, t, 0] = own
        moves = np.concatenate([own[:, None] + (a[:, 1:] - a[:, :1]) * w for a, w in zip(axes, weight, strict=True)], 1)
        cost = np.concatenate([g[:, 1:] for g in gaps], 1)
        pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        found = moves[rows[:, None], pick]
        out[:, t, 1 : 1 + found.shape[1]] = found
        out[:, t, 1 + found.shape[1] :] = own[:, None]
    return out


def pairs_at(cosine: float, d: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors of d components at a cosine."""
    rng = np.random.default_rng([seed, d])
    x, o = units(rng.normal(size=(n, d))), rng.normal(size=(n, d))
    o = units(o - (o * x).sum(1)[:, None] * x)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * o


@cache
def tables_for(d: int, hashes: int, least: float) -> tuple[int, int]:
    """(hashes, tables) for a padded dimension: so many tables, `TABLES` at least, that `RECALL` of random pairs at the
    cosine `least` meet, measured with the very rotations in use and two standard errors on the safe side. Where
    `MOST` tables don't do, or more bring little (small dimensions have few rotations), a hash less is taken: buckets grow, and recall stays. No hash is one bucket, which is exact."""
    n = 2000 if d <= 256 else 1000
    goal = RECALL + 2 * math.sqrt(RECALL * (1 - RECALL) / n)
    x, y = pairs_at(least, d, n, 23)
    while hashes:
        tables = TABLES
        for _ in range(4):
            a, b = codes(x, hashes, tables), codes(y, hashes, tables)
            recall = float(((a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))).mean())
            if recall >= goal:
                return hashes, tables
            # As many as would do if all tables missed alike.
            tables = max(tables + 1, math.ceil(tables * math.log(1 - goal) / math.log(1 - recall))) if recall else MOST + 1
            if tables > MOST:
                break
        hashes -= 1
    return 0, 1


def plan_for(sizes: dict[int, int], least: float) -> dict[int, tuple[int, int]]:
    """(hashes, tables) for each padded dimension, from its number of classes."""
    return {d: tables_for(d, max(1, math.ceil(math.log(max(n, FILL) / FILL) / math.log(2 * d))), least) for d, n in sizes.items()}


def packed_type(d: int, hashes: int) -> type:
    return np.int32 if (2 * d) ** hashes < 2**31 else np.int64


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of codes of pairs: the number of the first event at which they meet (table by table; in each: the same
    own bucket, b's probes at a's own bucket, a's probes at b's)."""
    own = (a[:, :, 0] == b[:, :, 0])[:, :, None]
    at_a = (b[:, :, 1:] == a[:, :, :1]).any(2)[:, :, None]
    at_b = (a[:, :, 1:] == b[:, :, :1]).any(2)[:, :, None]
    return np.concatenate((own, at_a, at_b), 2).reshape(len(a), -1).argmax(1)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node that links reach, with the smallest node of its component; n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if np.array_equal(label, before):
            break
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def hashed_classes(classes: DataFrame, plan: dict[int, tuple[int, int]]) -> DataFrame:
    """rep, n, dim, vec (its components as they came, single or double), codes for rows (rep, n, embedding)."""
    kind = np.float32 if dict(classes.dtypes)["embedding"] == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_dimension(b.column(2)):
                hashes, tables = plan[padded(x.shape[1])]
                c = codes(units(x), hashes, tables).reshape(len(x), -1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1]), pa.int32()), pa.array(c.ravel()))
                packed = pa.array([r.tobytes() for r in c.astype(packed_type(padded(x.shape[1]), hashes))], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.full(len(x), x.shape[1])), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), flat, packed], ["rep", "n", "dim", "vec", "codes", "packed"])

    return classes.select("rep", "n", "embedding").mapInArrow(run, "rep long, n long, dim long, vec binary, codes array<long>, packed binary")


def bucket_links(hashed: DataFrame, plan: dict[int, tuple[int, int]], least: float) -> DataFrame:
    """kind 0: (a, b) = (class, links found); kind 1: a spanning link between classes a and b."""
    span = 1 + PROBES
    spread = hashed.select("rep", "n", "dim", "vec", "packed", F.posexplode("codes").alias("_p", "bucket"))
    spread = spread.select("rep", "n", "dim", "vec", "packed", F.expr(f"CAST(_p DIV {span} AS BIGINT)").alias("t"), (F.col("_p") % span > 0).cast("int").alias("role"), "bucket")
    large = stored(spread.groupBy("dim", "t", "bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK), "embed-large")
    cut = spread.join(F.broadcast(large) if large.count() <= SMALL else large, ["dim", "t", "bucket"], "left")
    cut = cut.withColumn("_k", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("long")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_k")))
    cells = cut.withColumn("_o", F.explode(F.expr("sequence(0L, _k - 1)"))).select("dim", "t", "bucket", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "role", "rep", "n", "vec", "packed")

    def hits(g: pa.Table, dim: int, t: int) -> tuple[np.ndarray, ...]:
        rep, role, block = g["rep"].to_numpy(), g["role"].to_numpy(), g["block"].to_numpy()
        raw = b"".join(g["vec"].to_pylist())
        v = units(np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(rep) else np.float64).astype(np.float64).reshape(-1, dim))
        packed = b"".join(g["packed"].to_pylist())
        hashes, tables = plan[padded(dim)]
        c = np.frombuffer(packed, packed_type(padded(dim), hashes)).reshape(len(rep), tables, span)
        two = block.max() != block.min()
        base = np.flatnonzero(role == 0)
        found = []
        for s in range(0, len(base), 512):
            x = base[s : s + 512]
            for e in range(0, len(rep), 4096):
                y = np.arange(e, min(e + 4096, len(rep)))
                ok = (v[x] @ v[y].T >= least) & (rep[x][:, None] != rep[y][None, :])
                ok &= (role[y] == 1)[None, :] | (rep[x][:, None] < rep[y][None, :])
                if two:
                    ok &= block[x][:, None] != block[y][None, :]
                p, q = np.nonzero(ok)
                p, q = x[p], y[q]
                low = np.where(rep[p] < rep[q], p, q)
                event = np.where(role[q] == 0, 0, np.where(low == p, 1, 2)) + 3 * t
                for k in range(0, len(p), 1 << 16):
                    a, b = low[k : k + (1 << 16)], (p + q - low)[k : k + (1 << 16)]
                    keep = first_meeting(c[a], c[b]) == event[k : k + (1 << 16)]
                    if keep.any():
                        found.append((a[keep], b[keep]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def link(parts: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for table, starts in parts:
            out: list[tuple] = []
            dims, ts = table["dim"].to_numpy(), table["t"].to_numpy()
            bare = np.flatnonzero(np.diff(starts) > 1)
            for s in bare:
                i, j = int(starts[s]), int(starts[s + 1])
                g = table.slice(i, j - i)
                a, b = hits(g, int(dims[i]), int(ts[i]))
                if len(a):
                    ids, where = np.unique(g["rep"].to_numpy(), return_inverse=True)
                    n = g["n"].to_numpy()
                    x, y = where[a], where[b]
                    count = np.bincount(x, n[b], len(ids)) + np.bincount(y, n[a], len(ids))
                    at = np.flatnonzero(count)
                    low, high = spanning(x, y, len(ids))
                    out.append((np.repeat([0, 1], [len(at), len(low)]), np.concatenate((ids[at], ids[low])), np.concatenate((count[at].astype(np.int64), ids[high]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(3)], ["kind", "a", "b"])

    return map_groups(cells, ["dim", "t", "bucket", "i", "j"], link, "kind long, a long, b long")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for rows (vec_id, embedding)."""
    zero = ~F.exists("embedding", lambda x: x != 0)
    ok = usable("embedding") & F.col("vec_id").isNotNull() & ~zero
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(ok, F.lit(False)).alias("ok"))
    key = [F.xxhash64("embedding").alias("k1"), F.xxhash64("embedding", F.lit(29)).alias("k2")]
    ids = stored(rows.select("vec_id", "ok", *key), "embed-ids")
    classes = stored(ids.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "embed-classes")
    with_key = rows.where("ok").select("vec_id", "embedding", *key)
    own = with_key.join(classes, (with_key.vec_id == classes.rep) & (with_key.k1 == classes.k1) & (with_key.k2 == classes.k2)).groupBy("rep", "n", classes.k1, classes.k2).agg(F.first("embedding").alias("embedding"))
    sizes: dict[int, int] = {}
    for dim, n in own.groupBy(F.size("embedding")).count().collect():
        sizes[padded(dim)] = sizes.get(padded(dim), 0) + n
    plan = plan_for(sizes, least)
    found = stored(bucket_links(stored(hashed_classes(own, plan), "embed-hashed"), plan, least), "embed-links")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    comps = components(found.where("kind = 1").select("a", "b"), "embed-components")
    return (
        ids.join(classes, ["k1", "k2"], "left").withColumn("rep", F.when(F.col("ok"), F.col("rep")))
        .join(counts, F.col("rep") == F.col("a"), "left").join(comps, F.col("rep") == F.col("node"), "left")
        .select("vec_id", F.when(F.col("ok"), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op9_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.9),
n AS (SELECT a, count(*) AS c FROM link GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
m AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.c, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m ON m.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
