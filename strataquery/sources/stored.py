"""Tables on the way: written once to the folder that all executors share, so that lost executors don't cost their lineage
and plans that read them stay short and keep their statistics. They are deleted when the driver's Python ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder serves a local master; a cluster has to
    name one, for its machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataquery-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(delete, spark, found)
    return re.sub(r"^file:/+", "file:///", found).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have ended: then the folder goes with the cluster's own cleaning
        pass


class Parts:
    """A table that grows by parts, each a folder of its own: nothing that was written is written again."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.schema = spark, fresh_path(spark, name), None
        self.rows: list[int] = []

    def add(self, df: DataFrame, sums: list[Column] | None = None) -> int | tuple[int, dict]:
        """Writes a part; how many rows it has, and the named sums if any are asked for, as its writer saw them."""
        seen = Observation()
        self.schema = df.schema
        df.observe(seen, F.count(F.lit(1)).alias("n"), *(sums or [])).write.parquet(f"{self.base}/{len(self.rows)}")
        told = seen.get
        self.rows.append(int(told["n"]))
        return self.rows[-1] if sums is None else (self.rows[-1], told)

    def part(self, i: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{range(len(self.rows))[i]}")

    @property
    def df(self) -> DataFrame:
        """All parts; empty ones are left out."""
        kept = [f"{self.base}/{i}" for i, n in enumerate(self.rows) if n] or [f"{self.base}/0"]
        return self.spark.read.schema(self.schema).parquet(*kept)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    parts = Parts(df.sparkSession, name)
    parts.add(df)
    return parts.df
