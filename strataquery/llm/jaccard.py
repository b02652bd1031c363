"""N-gram Jaccard join: documents whose 5-word shingle sets have a similarity of 0.8 or more, exactly.

1. Equal shingle sets collapse to one class (its smallest doc_id stands for it).
2. Prefix filter: under one total order of shingles, similar sets share a shingle among the first
   p = n - ceil(0.8 n) + 1 of each, and k shingles among the first p - 1 + k. A document that shares too few of the
   latter (k = n / 5) with all others together has no partner. The order puts shingles that a count sketch of the whole corpus marks as frequent last,
   so a passage that many documents share doesn't bring them together. The sketch has a fixed number of counters (at
   most 2^24 bytes when broadcast); any order gives the same links, a rough sketch only gives larger groups.
3. Shingles are dealt to hash buckets as packed postings; a bucket keeps those that two sets share, and lists of
   documents that come up for many shingles are kept once (`groups`).
4. Documents are joined by signature trees (see sigtree): first those that have the same largest group, then those
   of different ones that share a group and are not yet in one component (`links_of`). Groups of more than `BLOCK` are
   cut into blocks and joined block pair by block pair, so no task holds more than two blocks.
5. Components of the verified links, by star rounds. Links are spanning: copies are never expanded into all pairs.

Edge cases: null and wordless texts have an empty set and are linked with nothing; with fewer than five words the whole
sequence is the one shingle; rows with one doc_id count as one document for linking; a null doc_id is linked with nothing
(its component_id is null); an empty table gives an empty result; other columns are ignored. Shingles are compared by
64-bit hashes of their words, so links are those of the texts but for chance collisions of such hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm.common import components, map_groups, skewed_join, stored
from strataquery.llm.shingles import batches_of_sets, mix
from strataquery.llm.sigtree import spanning_links

BLOCK, COPIED = 2048, 2_000_000


def least_overlap(n: int) -> int:
    return (80 * n + 99) // 100


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + 1


def extra(n: int) -> int:
    """How many shared shingles are asked for among the first prefix_length(n) - 1 + extra(n)."""
    return max(1, n // 5)


def asked(n: int) -> int:
    """The shared shingles that a set of n needs to have any partner: partners may be smaller, and ask for fewer."""
    return extra(least_overlap(n))


def set_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, and a 128-bit digest of the shingle set (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in batches_of_sets(batches):
            d = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(d, pa.binary())], ["doc_id", "n_shingles", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary")


def only_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Documents with (or without) the ids of a one-column table, broadcast where a count shows that it is small."""
    return docs.join(F.broadcast(ids) if ids.count() <= COPIED else ids, "doc_id", how)


def sketch(docs: DataFrame, total: int) -> np.ndarray:
    """For each hash range of shingles, 0 or a level of frequency: counts of all documents' shingles, log scale."""
    bits = min(24, max(16, (total // 32).bit_length()))
    chunk = 1 << 16
    often = max(64, 4 * (total >> bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for _, sets in batches_of_sets(batches):
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        codec = pa.Codec("zstd")
        for i in range(0, 1 << bits, chunk):
            if counts[i : i + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // chunk], pa.int64()), pa.array([codec.compress(counts[i : i + chunk].tobytes(), asbytes=True)], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(codec.decompress(x.as_py(), 4 * chunk, asbytes=True), np.uint32)
                sums[i] = sums[i] + own if i in sums else own.astype(np.uint64)
        for i, s in sums.items():
            level = np.where(s > often, np.log2(np.maximum(s, 1) / often).astype(np.int64) + 1, 0).astype(np.uint8)
            if level.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["chunk", "levels"])

    parts = docs.select("doc_id", "text").mapInArrow(count, "chunk long, counts binary").repartition("chunk").mapInArrow(add, "chunk long, levels binary").collect()
    out = np.zeros(1 << bits, np.uint8)  # at most 2^24 bytes
    for r in parts:
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["levels"], np.uint8)
    return out


def prefix(h: np.ndarray, levels: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The first shingles in the order (level, hash), prefix_length(n) - 1 + extra(n) of them."""
    p = prefix_length(len(h)) - 1 + extra(len(h))
    level = levels[(h >> shift).astype(np.int64)]
    rare = h[level == 0]
    return rare[:p] if len(rare) >= p else h[np.argsort(level, kind="stable")[:p]]


def _runs(h: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1))


def groups(docs: DataFrame, levels: np.ndarray, total: int) -> DataFrame:
    """(gid, doc_id, df): lists of documents that share a prefix shingle, equal lists once.

    A document that shares fewer than `asked` of its longer prefix's shingles with any other has no partner and goes."""
    spark = docs.sparkSession
    buckets = max(1, total * 2 // 5 // 500_000)
    shift = np.uint64(64 - (len(levels).bit_length() - 1))
    sent = spark.sparkContext.broadcast(levels)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, d = np.concatenate(held), np.concatenate(owners)
            b = (mix(h) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            h, d, b = h[order], d[order], b[order]
            cuts = np.concatenate((_runs(b), [len(b)]))
            blobs = [h[i:j].tobytes() + d[i:j].view(np.uint8).reshape(-1, 8).T.tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(b[cuts[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        size = 0
        for ids, sets in batches_of_sets(batches):
            for i, s in zip(ids, sets, strict=True):
                if i is not None and len(s):
                    # ids carry, in the lowest bit, whether the shingle is in the plain prefix
                    first = prefix(s, sent.value, shift)
                    held.append(first)
                    owner = np.full(len(first), i << 1, np.int64)
                    owner[: prefix_length(len(s))] |= 1
                    owners.append(owner)
                    size += len(first)
            if size > 1_000_000:
                yield from flush()
                held, owners, size = [], [], 0
        if held:
            yield from flush()

    def shared(parts: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for t, starts in parts:
            blobs = t["blob"].to_pylist()
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                raw = [np.frombuffer(x, np.uint8) for x in blobs[i:j]]
                h = np.concatenate([x[: len(x) // 2].view(np.uint64) for x in raw])
                d = np.concatenate([np.ascontiguousarray(x[len(x) // 2 :].reshape(8, -1).T).view(np.int64).ravel() for x in raw])
                order = np.argsort(h, kind="stable")
                h, d = h[order], d[order]
                df = np.diff(np.concatenate((_runs(h), [len(h)])))
                many = np.repeat(df > 1, df)
                h, d = h[many], d[many]
                order = np.lexsort((-d, h))  # a document's plain-prefix posting first
                h, d = h[order], d[order]
                keep = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] >> 1 != d[:-1] >> 1))) if len(h) else np.zeros(0, bool)
                h, d = h[keep], d[keep]
                if not len(h):
                    continue
                df = np.diff(np.concatenate((_runs(h), [len(h)])))
                owner, n = np.unique(d[np.repeat(df > 1, df)] >> 1, return_counts=True)
                plain = (d & 1) == 1
                h, d = h[plain], d[plain] >> 1
                first = _runs(h)
                df = np.diff(np.concatenate((first, [len(h)])))
                gid = mix(np.add.reduceat(mix(d.view(np.uint64)), first)).view(np.int64)
                some = np.flatnonzero(df > 1)
                once = some[np.unique(gid[some], return_index=True)[1]]
                rows = np.repeat(first[once] - np.concatenate(([0], np.cumsum(df[once])[:-1]))[: len(once)], df[once]) + np.arange(df[once].sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((np.zeros(len(owner), np.int64), np.repeat(gid[once], df[once])))), pa.array(np.concatenate((owner, d[rows]))), pa.array(np.concatenate((n, np.zeros(len(rows), np.int64))))], ["gid", "doc_id", "n"])

    postings = docs.select("doc_id", "text").mapInArrow(post, "bucket long, blob binary")
    # rows with n: how many shingles a document shares; rows without: members of a group
    found = stored(map_groups(postings, ["bucket"], shared, "gid long, doc_id long, n long").groupBy("gid", "doc_id").agg(F.sum("n").alias("n")), "jaccard-shared")
    return found


def open_groups(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(gid, doc_id, df) of groups of two or more after documents without a possible partner are gone."""
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n_shingles") * 80 / 100) / 5)).cast("long")
    may = found.where("n > 0").groupBy("doc_id").agg(F.sum("n").alias("n")).join(sizes.groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles")), "doc_id").where(F.col("n") >= least).select("doc_id")
    rows = stored(found.where("n = 0").select("gid", "doc_id").join(may, "doc_id", "left_semi"), "jaccard-members")
    df = stored(rows.groupBy("gid").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "jaccard-df")
    return skewed_join(rows, df, ["gid"], "df", rows.count())


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (gid, doc_id, df, ..) with the part of their group, of about `BLOCK`, that they fall into."""
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / BLOCK)))


def in_each_part(per_group: DataFrame) -> DataFrame:
    """Rows (gid, df, ..) once for each part of the group: a large group meets them in many tasks, not in one."""
    return per_group.withColumn("part", F.explode(F.expr(f"sequence(0L, ceil(df / {BLOCK}) - 1)"))).drop("df")


def cells_of(members: DataFrame, chain: bool) -> DataFrame:
    """Cells of each group (gid, doc_id, df, component): the group itself, or pairs of its blocks of about `BLOCK`, cut by
    a hash of doc_id. chain: only each block with itself and with the next one."""
    cut = members.withColumn("_n", F.ceil(F.col("df") / BLOCK).cast("int")).withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.col("_n")).cast("int"))
    near = F.expr("filter(array(_b - 1, _b, _b + 1), x -> x >= 0 AND x < _n)") if chain else F.expr("sequence(0, _n - 1)")
    return cut.withColumn("_o", F.explode(near)).select("gid", "doc_id", "component", F.col("_b").cast("long").alias("block"), F.least("_b", "_o").cast("long").alias("i"), F.greatest("_b", "_o").cast("long").alias("j"))


def visits(members: DataFrame, visitors: DataFrame) -> DataFrame:
    """Cells in which visitors (gid, doc_id, df, component) meet the members of a group, and only those. df: its members."""
    count = visitors.groupBy("gid", "df").agg(F.count(F.lit(1)).alias("_c"))
    sizes = stored(count.select("gid", "df", "_c", F.ceil(F.col("df") / BLOCK).cast("int").alias("_n"), F.ceil(F.col("_c") / BLOCK).cast("int").alias("_v")), "jaccard-visits")
    m = dealt(members).join(in_each_part(sizes.drop("_c")), ["gid", "part"])
    own = m.select("gid", "doc_id", "component", F.lit(0).cast("long").alias("block"), F.pmod(F.xxhash64("doc_id"), F.col("_n")).cast("long").alias("i"), F.explode(F.expr("sequence(0L, _v - 1L)")).alias("j"))
    v = skewed_join(visitors.drop("df"), sizes.drop("df"), ["gid"], "_c", visitors.count())
    other = v.select("gid", "doc_id", "component", F.lit(1).cast("long").alias("block"), F.explode(F.expr("sequence(0L, _n - 1L)")).alias("i"), F.pmod(F.xxhash64("doc_id"), F.col("_v")).cast("long").alias("j"))
    return own.union(other)


def join_cells(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Links (a, b) within each cell; where it has two blocks, between them."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in batches_of_sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set"])

    def join(parts: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for t, starts in parts:
            ids, comps, blks = (t[k].to_numpy() for k in ("doc_id", "component", "block"))
            raw = t["set"].to_pylist()
            a, b = [], []
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if j - i > 1:
                    for x, y in spanning_links([np.frombuffer(s, np.uint64) for s in raw[i:j]], comps[i:j], blks[i:j]):
                        a.append(ids[i + x])
                        b.append(ids[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    cells = stored(cells, "jaccard-cells")
    sets = only_ids(docs, cells.select("doc_id").distinct()).select("doc_id", "text").mapInArrow(hashes, "doc_id long, set binary")
    return map_groups(cells.join(sets, "doc_id"), ["gid", "i", "j"], join, "a long, b long", order=("doc_id",))


def links_of(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Verified links that connect whatever similar pairs connect, from groups (gid, doc_id, df).

    Every document is at home in its largest group; those who share a home are joined first. A pair with two homes that
    is still in two components meets when the one of the smaller home class visits the class of the other: so a set
    travels once for each class it has to meet, however many groups the two share."""
    home = shared.groupBy("doc_id").agg(F.max(F.struct("df", "gid"))["gid"].alias("home"))
    home = stored(home, "jaccard-homes")
    size = stored(home.groupBy("home").agg(F.count(F.lit(1)).alias("n")), "jaccard-sizes")
    home = stored(skewed_join(home, size, ["home"], "n", home.count()).select("doc_id", "home", "n"), "jaccard-home")
    classes = home.select(F.col("home").alias("gid"), "doc_id", F.col("n").alias("df"))
    first = stored(join_cells(docs, cells_of(classes.where("df > 1").withColumn("component", F.col("doc_id")), True)), "jaccard-links")
    now = components(first, "jaccard-components")
    placed = stored(home.join(now, F.col("doc_id") == F.col("node"), "left").select("doc_id", "home", "n", F.coalesce("component", "doc_id").alias("component")), "jaccard-placed")
    members = placed.select(F.col("home").alias("gid"), "doc_id", F.col("n").alias("df"), "component")
    torn = members.where(F.col("df") > BLOCK).groupBy("gid", "df").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gid", "df")
    second = join_cells(docs, cells_of(dealt(members).join(in_each_part(torn), ["gid", "part"], "left_semi").drop("part"), False))
    rows = stored(shared.join(placed, "doc_id"), "jaccard-rows")
    met = stored(rows.groupBy("gid", "df", F.col("home").alias("_h"), F.col("n").alias("_m")).agg(F.min("component").alias("_x"), F.max("component").alias("_y")), "jaccard-met")
    larger = (F.col("n") < F.col("_m")) | ((F.col("n") == F.col("_m")) & (F.col("home") < F.col("_h")))
    open_ = met.groupBy("gid").agg(F.min("_x").alias("x"), F.max("_y").alias("y")).where("x <> y").select("gid")
    apart = (F.col("component") != F.col("_x")) | (F.col("component") != F.col("_y"))
    hosts = in_each_part(met.join(open_, "gid", "left_semi"))
    visitors = dealt(rows).join(hosts, ["gid", "part"]).where(larger & apart).select(F.col("_h").alias("gid"), "doc_id", F.col("_m").alias("df"), "component").distinct()
    third = join_cells(docs, visits(members, stored(visitors, "jaccard-visitors")))
    return first.union(second).union(third)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for documents (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = stored(set_ids(docs), "jaccard-ids")
    classes = ids.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    kept = stored(classes, "jaccard-classes")
    total = kept.agg(F.sum("n")).first()[0] or 0
    nodes = ids.join(kept.select("digest", "rep"), "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    copies = nodes.where("doc_id <> rep").select("doc_id").subtract(kept.select(F.col("rep").alias("doc_id")))
    own = only_ids(docs, stored(copies, "jaccard-copies"), "left_anti")
    levels = sketch(own, total)
    shared = stored(open_groups(groups(own, levels, total), ids.select("doc_id", "n_shingles")), "jaccard-groups")
    # A row can be in the class of a smaller id while another row of the same id stands for a class: ids tie them together.
    same = nodes.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    tied = same.join(kept.select(F.col("rep").alias("a")).distinct(), "a", "left_semi")
    links = stored(links_of(own, shared), "jaccard-links")
    final = components(links.union(tied.select("a", "b")), "jaccard-components")
    return nodes.join(final, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS k, unnest(ws) AS v, generate_subscripts(ws, 1) AS i FROM w),
g AS (
  SELECT doc_id, k, i, concat_ws(' ', v, lead(v, 1) OVER d, lead(v, 2) OVER d, lead(v, 3) OVER d, lead(v, 4) OVER d) AS t
  FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT DISTINCT doc_id, hash(t) AS t FROM g WHERE i <= greatest(k - 4, 1)),
n AS (SELECT doc_id, coalesce(c, 0) AS n FROM documents LEFT JOIN (SELECT doc_id, count(*) AS c FROM u GROUP BY doc_id) USING (doc_id)),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
