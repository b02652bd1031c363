"""Change streams: a journal of changed paths with three states, debounced batches, and incremental refresh."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

JOURNAL = "source string, state string, generation long, pending long"


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """Change events (source, seq, path) as a watcher drops them into a folder, one JSON object a line: a stream for
    `journal`. An event without a path says that the source has been reconciled; a gap in the numbers, as after an
    overflow of the watcher's queue, makes it UNKNOWN."""
    return spark.readStream.schema("source string, seq long, path string").json(folder)


def journal(events: DataFrame) -> DataFrame:
    """Per source, from numbered events (source, seq, path): CLEAN, DIRTY or, after any gap in the numbers, UNKNOWN
    (which asks for a full rescan). The generation grows with every event; a path of '' reconciles.

    For streams, by arbitrary state; `journal_batch` gives the same for a table."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, status, gen, pending = state.get if state.exists else (-1, "CLEAN", 0, 0)
        for b in batches:
            for seq, path in b.sort_values("seq")[["seq", "path"]].itertuples(index=False):
                gen += 1
                if seq != last + 1:
                    status = "UNKNOWN"
                elif not path:
                    status, pending = "CLEAN", 0
                elif status != "UNKNOWN":
                    status = "DIRTY"
                pending += bool(path)
                last = seq
        state.update((int(last), status, int(gen), int(pending)))
        yield pd.DataFrame([(key[0], status, gen, pending)], columns=["source", "state", "generation", "pending"])

    return events.groupBy("source").applyInPandasWithState(run, JOURNAL, "last long, state string, gen long, pending long", "update", "NoTimeout")


def journal_batch(events: DataFrame, key: str, seq: str, path: str) -> DataFrame:
    """The state after all events of a table: UNKNOWN from a gap on, until an event without a path reconciles."""
    w = Window.partitionBy(key).orderBy(seq)
    step = events.withColumn("_gap", (F.col(seq) - F.coalesce(F.lag(seq).over(w), F.lit(-1)) != 1).cast("int")).withColumn("_ok", (F.coalesce(path, F.lit("")) == "").cast("int"))
    since = step.withColumn("_era", F.sum("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    era = since.groupBy(key, "_era").agg(F.sum(F.when(F.col("_ok") == 0, F.col("_gap")).otherwise(0)).alias("gaps"), F.sum(1 - F.col("_ok")).alias("pending"), F.count(F.lit(1)).alias("n"))
    total = era.groupBy(key).agg(F.max(F.struct("_era", "gaps", "pending")).alias("z"), F.sum("n").alias("generation"))
    return total.select(key, F.when(F.col("z.gaps") > 0, "UNKNOWN").when(F.col("z.pending") > 0, "DIRTY").otherwise("CLEAN").alias("state"), "generation", F.col("z.pending").alias("pending"))


def epoch_micros(df: DataFrame, ts: str) -> F.Column:
    """Microseconds from 1970: of a timestamp without a zone as its clock says them, whatever the zone of the session."""
    c = F.col(ts)
    if not isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.unix_micros(c)
    minutes = F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def debounced(events: DataFrame, ts: str, key: str, millis: int) -> DataFrame:
    """One row for each path and interval of `millis`, with the number of events that it stands for."""
    slot = F.floor(F.floor(epoch_micros(events, ts) / 1000) / millis)
    return events.groupBy(slot.alias("slot"), key).agg(F.count(F.lit(1)).alias("events"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap_s: int) -> DataFrame:
    """Runs of a key's events with no pause longer than the gap."""
    w = Window.partitionBy(key).orderBy(ts)
    at = events.withColumn("_at", epoch_micros(events, ts))
    new = F.coalesce((F.col("_at") - F.lag("_at").over(w) > gap_s * 1_000_000).cast("int"), F.lit(1))
    marked = at.withColumn("_n", new).withColumn("_s", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_s").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))


BUCKETS = 64


def bucket_of(key: str) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def table_of(spark: SparkSession, target: str, schema, before: int | None = None) -> DataFrame:
    """What `refresh` has written (before a batch): of each bucket its newest version. Only names of folders are listed."""
    import re

    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(target).getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[str, int] = {}
    for s in fs.listStatus(at(target)) if fs.exists(at(target)) else []:
        m = re.fullmatch(r"b=(\d+)-v=(\d+)", s.getPath().getName())
        if m and (before is None or int(m[2]) < before) and fs.exists(at(f"{target}/done-{m[2]}")):
            newest[m[1]] = max(newest.get(m[1], -1), int(m[2]))
    paths = [f"{target}/b={b}-v={v}" for b, v in newest.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def refresh(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str, key: str = "path", seq: str = "seq"):
    """Applies each micro-batch of changed rows (key, seq, ..) to a table: of each key the rows of its highest `seq` in
    the batch, all of them, replace those it had; a row whose other columns are all null only deletes.

    Keys are dealt to hash buckets, and a batch writes only the buckets that it touches, as a new version of each; a
    marker that is written last makes the batch's versions visible together, so a batch run again does no harm."""
    from strataquery.operators.delta import replace_children

    def apply(batch: DataFrame, n: int) -> None:
        last = batch.groupBy(key).agg(F.max(seq).alias("_last"))
        new = batch.join(last, key).where(F.col(seq) == F.col("_last")).drop("_last")
        touched = [r[0] for r in new.select(bucket_of(key)).distinct().collect()]  # at most BUCKETS
        old = table_of(spark, target, batch.schema, n)
        others = [c for c in batch.columns if c not in (key, seq)]
        given = F.greatest(F.lit(False), *[F.col(c).isNotNull() for c in others]) if others else F.lit(True)
        after = replace_children(old, new, [key]).where(given).withColumn("_b", bucket_of(key))
        for b in touched:
            after.where(F.col("_b") == b).drop("_b").write.mode("overwrite").parquet(f"{target}/b={b}-v={n}")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/done-{n}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True).close()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
