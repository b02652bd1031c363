"""Immutable generations of tables with one pointer: readers bind to a generation, writers compare and set."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Generations:
    """Tables below `path/gen=N/<name>`; `path/current-N` marks the newest complete generation. A pointer is made by
    creating a file that must not exist yet, so of two writers one fails and nothing is overwritten."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The newest generation, 0 where there is none."""
        if not self.fs.exists(self._at(self.path)):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(self.path))]
        return max([int(n.removeprefix("current-")) for n in names if n.startswith("current-")], default=0)

    def table(self, name: str, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/gen={generation or self.current()}/{name}")

    def publish(self, expected: int, tables: dict[str, DataFrame], note: dict | None = None) -> int:
        """Writes the generation after `expected`; fails if that is no longer the current one."""
        new = expected + 1
        if self.current() != expected:
            raise RuntimeError(f"generation {self.current()} is current, not {expected}")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/gen={new}/{name}")
        try:
            out = self.fs.create(self._at(f"{self.path}/current-{new}"), False)
        except Exception as e:
            raise RuntimeError(f"another writer published generation {new}") from e
        out.write(bytearray(json.dumps(note or {}, sort_keys=True).encode()))
        out.close()
        return new

    def replace_partitions(self, name: str, old: DataFrame, new: DataFrame, producer: str, expected: int) -> int:
        """A generation in which one producer's rows are replaced by new ones."""
        return self.publish(expected, {name: old.where(old.producer != producer).unionByName(new)})
