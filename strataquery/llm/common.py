"""What the operators share: tables written to the cluster's shared folder, streaming over sorted groups,
ranks without a global sort, and connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a temporary folder serves a local
    master; a cluster has to name one, for its machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataquery-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(delete, spark, found)
    return re.sub(r"^file:/+", "file:///", found).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have ended: then the folder goes with the cluster's own cleaning
        pass


#: Seconds between two collections of the driver's garbage, and when the last one ended.
RELEASE_S, _released = 5.0, [0.0]


def release(spark: SparkSession) -> None:
    """Frees what finished steps left: the driver's heap shrinks, and Spark's cleaner drops their shuffle files and
    broadcasts, for it follows collections of the driver's garbage. A chain of many short steps fills the heap to its limit
    otherwise, though little of it is in use."""
    if time.monotonic() - _released[0] >= RELEASE_S:
        gc.collect()  # Python's handles keep the JVM's objects
        spark._jvm.System.gc()
        _released[0] = time.monotonic()


class Stored:
    """A table written once to the shared folder, so that lost executors don't cost its lineage."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.path, self.schema = df.sparkSession, fresh_path(df.sparkSession, name), df.schema
        df.write.parquet(self.path)
        release(self.spark)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


#: Keys that hold more than one row in HOT are fewer than HOT, whatever the input: a table of them may be broadcast.
HOT, FEW = 4096, 10_000


def skewed_join(rows: DataFrame, per_key: DataFrame, keys: list[str], held: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row for each key, whose column `held` tells how many of `total` rows have it.

    Rows of hot keys (fewer than HOT keys) meet a broadcast and stay where they are; the rest is shuffled by key. Both
    tables are read twice, so they should be stored ones."""
    limit = max(FEW, total // HOT)
    hot, cold = per_key.where(F.col(held) > limit), per_key.where(F.col(held) <= limit)
    there = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return there.unionByName(rest)


def hash_cell(cells: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(7)), F.lit(cells))


def dense_rank_in(df: DataFrame, group: str, order: list[str], name: str, cells: int = 4096) -> DataFrame:
    """Adds `name`: gapless ranks from 0 inside each value of `group` (few values, any size), by no global sort.

    Rows are dealt to `cells` hash cells of the columns of `order`; a rank is the cell's offset plus the rank inside the
    cell. The table of offsets has at most groups x cells rows, whatever the input. Rows that are equal in all of
    `order` share a cell.
    """
    dealt = df.withColumn("_cell", hash_cell(cells, *order))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)) - 1
    ranked = dealt.withColumn("_rank", inside).join(F.broadcast(offsets), [group, "_cell"])
    return ranked.withColumn(name, (F.col("_offset") + F.col("_rank")).cast("long")).drop("_cell", "_rank", "_offset")


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Indices at which a row's key differs from the row's before it."""
    differs = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        differs |= c[1:] != c[:-1]
    return np.flatnonzero(differs) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by integer keys: tables of whole groups with the start of each group (and the end)."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def out() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        cuts = _changes([t[k].to_numpy() for k in keys])
        return t, np.concatenate(([0], cuts, [t.num_rows])).astype(np.int64)

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[b.schema.get_field_index(k)].to_numpy(zero_copy_only=False) for k in keys]
        if held and last != tuple(c[0] for c in cols):
            yield out()
            held = []
        cuts = _changes(cols)
        if len(cuts):
            held.append(b.slice(0, int(cuts[-1])))
            yield out()
            held = [b.slice(int(cuts[-1]))]
        else:
            held.append(b)
        last = tuple(c[-1] for c in cols)
    if held:
        yield out()


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[Iterator[tuple[pa.Table, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str, order: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Deals rows by `keys`, sorts them and gives `fn` whole groups, many at a time: no Python call for each group."""
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(lambda it: fn(whole_groups(it, keys)), schema)


def signature_of(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of `edges` (a, b: long).

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Stored(e, name)
    seen = signature_of(now.df)
    while seen[0]:
        e = now.df
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        after = Stored(small, name)
        now.drop()
        now, was, seen = after, seen, signature_of(after.df)
        if was == seen:
            break
    e = now.df
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
