"""Substring lookup by trigrams: of the distinct lower-cased values of some columns, those that hold a term.

Stored as Parquet dealt by ranges of gram and sorted: postings (gram, value) and counts (gram, n). A term's rarest grams
are read, values that have all of them are met, and what is left is verified. A term under three letters has no gram: it
is looked for in the values themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.sources.postings import ROW_GROUP, one_of
from strataquery.sources.stored import stored

#: Grams of a term that are read, the rarest first: more narrow little and cost a read each.
READ = 3


def grams(value: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 2, F.lit(1))), lambda i: F.substring(value, i, F.lit(3))))


def values_of(df: DataFrame, columns: list[str]) -> Column:
    return F.array_distinct(F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]))


class Grams:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, tables: list[tuple[DataFrame, list[str]]], path: str, row_group: int = ROW_GROUP) -> Grams:
        """An index of the values of columns of some tables."""
        each = [df.select(F.explode(values_of(df, columns)).alias("value")).distinct() for df, columns in tables]
        values = stored(reduce(DataFrame.unionByName, each).distinct(), "values")
        index = cls(values.sparkSession, path)
        dealt = lambda df, *by: df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", row_group)
        dealt(values, "value").parquet(f"{path}/values")
        dealt(values.where(F.length("value") >= 3).select(F.explode(grams(F.col("value"))).alias("gram"), "value"), "gram", "value").parquet(f"{path}/grams")
        dealt(index._read("grams").groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram").parquet(f"{path}/counts")
        return index

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def values_with(self, term: str) -> DataFrame:
        """value: the values that hold a term, whatever its case."""
        low = term.lower()
        own = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        holds = F.contains("value", F.lit(low))
        if not own:
            return self._read("values").where(holds)
        counts = {r["gram"]: r["n"] for r in self._read("counts").where(one_of("gram", own)).collect()}
        first, *more = sorted(own, key=lambda g: (counts.get(g, 0), g))[:READ]
        at = lambda g: self._read("grams").where(F.col("gram") == g).select("value")
        found = at(first).where(holds)
        return found if counts.get(first, 0) == 0 else reduce(lambda a, g: a.join(at(g), "value", "left_semi"), more, found)

    def rows_with(self, df: DataFrame, columns: list[str], term: str) -> DataFrame:
        """Rows of a table of which one of some (indexed) columns holds a term."""
        hit, own = self.values_with(term), [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
        flags = [f"_hit{i}" for i in range(len(columns))]
        for flag, value in zip(flags, own, strict=True):
            df = df.join(hit.select(F.col("value").alias(f"{flag}v"), F.lit(True).alias(flag)), value == F.col(f"{flag}v"), "left").drop(f"{flag}v")
        return df.where(F.coalesce(*flags, F.lit(False))).drop(*flags)
