"""Conversation prefix trie by smallest-member ownership.

Each distinct sequence of first turns is a node; what conversations share is stored once. A node is named by a digest of
its turns, chained turn by turn as a conversation streams by in order. Its owner is its smallest member. Going down a
path members only get fewer, so owners only grow and each conversation owns a suffix of its path: windows over a node's
rows mark the first, and where a conversation's suffix begins is all that must be known of it. One group-by over
prefixes then sums, for each member's row, the bytes of its path below that are not its own (occurrences minus owned
ones), a flag for the child that it owns and a flag for an owned end without children.

Scale: turns travel as digests of 16 bytes, not as texts. A node of very many members (the root, a common first turn) is
cut to one row in each task before the windows' shuffle, and to one partial sum in the group-by; joins are on keys of
nodes or conversations that both sides hold once, or go by `skewed_join`. The ids that end at one node, which its
checksum needs in order, are sorted over many tasks and written out in chunks; only the checksum itself reads a node's
chunks in one stream. A conversation streams through one task with a state of one digest.

Edge cases: null roles and texts are empty; turns of equal number (null first) go by the digest of role and text, so
repeated rows are repeated turns; rows without a conv_id belong to no conversation; a conversation that has no turns
after the exchange of its head is a member of the root alone; the head of a missing conversation is empty; an empty table
gives an empty result; texts of any length count whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.llm.common import Stored, skewed_join
from strataquery.llm.divergence import _starts

ROOT = bytes(16)
#: Ids in a chunk of the text that a checksum reads.
CHUNK = 8192
PATHS = "conv_id long, depth int, node binary, parent binary, bytes long, before long, ends boolean"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0 in order of turn), turn as a digest of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")) - 1
    return rows.select("conv_id", at.cast("long").alias("at"), "digest", "bytes")


def with_heads(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations whose first h turns are exchanged for those of conversation c - c % family, h = crc32(c) % heads:
    conv_id, own (0 for the head's turns), at, digest, bytes. Conversations left without turns have one row of nulls."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    convs = turns.where("at = 0").select("conv_id", h, base)
    lent = turns.where((F.col("at") < heads - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    head = convs.join(lent, "base").where("at < h").select("conv_id", F.lit(0).alias("own"), "at", "digest", "bytes")
    tail = turns.select("*", h).where("at >= h").select("conv_id", F.lit(1).alias("own"), "at", "digest", "bytes")
    none = F.lit(None)
    top = convs.select("conv_id", F.lit(-1).alias("own"), none.cast("long").alias("at"), none.cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return top.unionByName(head).unionByName(tail)


def paths(rebuilt: DataFrame) -> DataFrame:
    """One row for each conversation and depth: its node and the node's parent, the bytes of the last turn and of all
    turns before it, and whether the conversation ends there."""
    names = [c.split()[0] for c in PATHS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, until the next one tells whether the conversation goes on
        for b in batches:
            rows = []
            for conv, own, digest, size in zip(*(b.column(c).to_pylist() for c in ("conv_id", "own", "digest", "bytes")), strict=True):
                if own < 0:
                    new = [conv, 0, ROOT, None, 0, 0, True]
                else:
                    node = hashlib.blake2b(held[2] + digest, digest_size=16).digest()
                    new = [conv, held[1] + 1, node, held[2], size, held[5] + held[4], True]
                    held[6] = False
                if held:
                    rows.append(held)
                held = new
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _schema())
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, held, strict=True))], _schema())

    return rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "own", "at").mapInArrow(run, PATHS)


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PATHS.split(", ")])


def end_digests(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the decimal ids of conversations that end at a node, ascending, joined by commas."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = np.unique(np.concatenate((_starts([b.column("node")]), np.arange(0, b.num_rows, CHUNK)))) if b.num_rows else []
            ids = b.column("conv_id").to_numpy()
            ends = [*cuts[1:], b.num_rows] if len(cuts) else []
            texts = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cuts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(cuts, pa.int64())), pa.array(ids[np.array(cuts, np.int64)], pa.int64()), pa.array(texts, pa.string())], ["node", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            nodes, values = [], []
            for own, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if own == node:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    nodes.append(node)
                    values.append(sha.hexdigest())
                node, sha = own, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(values, pa.string())], ["node", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    ends = rows.where("ends").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    written = ends.mapInArrow(chunks, "node binary, first long, ids string")
    return written.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """One row for each node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = Stored(paths(rebuilt), "trie-paths").df
    first = F.row_number().over(Window.partitionBy("node").orderBy("conv_id"))
    owned = Stored(rows.withColumn("_first", first).where("_first = 1").drop("_first"), "trie-owned").df
    childless = owned.where("ends").join(owned.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    begin = owned.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("b"), F.count(F.lit(1)).alias("n_owned")).select("conv_id", F.col("b.depth").alias("since"), F.col("b.before").alias("shared"), "n_owned")
    begin = begin.join(childless, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)).cast("long"))
    lengths = rows.where("ends").select("conv_id", (F.col("depth") + 1).cast("long").alias("n_rows"), (F.col("before") + F.col("bytes")).alias("all"), F.col("depth").alias("last"))
    marks = Stored(lengths.join(begin, "conv_id", "left").select("conv_id", "n_rows", "last", F.coalesce("since", F.col("last") + 1).alias("since"), F.coalesce("shared", "all").alias("shared"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")), "trie-marks").df
    marked = skewed_join(rows, marks, ["conv_id"], "n_rows", rows.count())
    nodes = marked.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.expr("CAST(depth < last AND depth + 1 >= since AS LONG)")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.max("ends").alias("any_ends"),
    )
    nodes = Stored(nodes, "trie-nodes").df
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = skewed_join(nodes.where("parent IS NOT NULL").drop("n_children").withColumn("own_children", F.lit(0)), parents.where("n_children > 0"), ["parent"], "n_children", nodes.count()).select("node", "parent_conv_id")
    out = nodes.join(below, "node", "left").join(end_digests(rows), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return prefix_trie(with_heads(Stored(turns, "trie-turns").df))


OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS id, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT id, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY id) AS tab FROM bits WHERE k = 8),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
t AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS bytes, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT convs.conv_id, 0 AS own, pos, turn, bytes FROM convs JOIN t ON t.conv_id = base AND pos < h
  UNION ALL SELECT conv_id, 1, pos, turn, bytes FROM t JOIN convs USING (conv_id) WHERE pos >= h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(turn, ',') OVER w AS node, bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, depth),
k AS (SELECT *, CASE depth WHEN 0 THEN NULL WHEN 1 THEN '' ELSE left(node, length(node) - 65) END AS parent FROM n),
c AS (SELECT parent AS node, count(*) AS n_children FROM k GROUP BY parent),
s AS (
  SELECT a.node, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM k a JOIN k b ON starts_with(b.node, a.node) LEFT JOIN c ON c.node = b.node GROUP BY a.node)
SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (node) LEFT JOIN c USING (node) LEFT JOIN k up ON up.node = k.parent
"""
