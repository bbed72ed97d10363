"""The incremental path as a stream: archived rows arrive as files and a keyed table is kept up to date.

The table is a log of batches; each batch is one folder named by its number,
written once and never read again by the stream, so its cost follows the batch
and not the table, and a batch done again after a failure replaces itself. The
current rows are the latest of every key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _best(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row of every key: that of the greatest version (null is least), of equal ones the greatest row."""
    rest = [c for c in rows.columns if c not in (key, version)]
    best = F.max(F.struct(version, *rest)).alias("b")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"b.{c}").alias(c) for c in (version, *rest)])


def stream_upsert(spark: SparkSession, source: str, schema: str, key: str, version: str, target: str, state: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends what is there and new since the last run, a batch at a time; by default it then stops.

    Null keys are left out; within a batch the greatest version of a key stays.
    """

    def append(batch: DataFrame, number: int) -> None:
        rows = _best(batch.filter(F.col(key).isNotNull()), key, version)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    return rows.writeStream.foreachBatch(append).option("checkpointLocation", f"{state}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def current_state(spark: SparkSession, target: str, key: str, version: str) -> DataFrame:
    """The current row of every key over all batches."""
    return _best(spark.read.parquet(target).drop("batch"), key, version)


def windowed_counts(events: DataFrame, ts: str, kind: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n): events per window; for streams later ones than ``late`` are left out."""
    src = events.withColumn(ts, F.col(ts).cast("timestamp"))
    src = src.withWatermark(ts, late) if events.isStreaming else src
    return src.groupBy(F.window(F.col(ts), every).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def stream_windows(spark: SparkSession, source: str, schema: str, ts: str, kind: str, target: str, state: str, every: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Writes the counts of every window once it is over (its end is before the latest event less ``late``)."""
    counts = windowed_counts(spark.readStream.schema(schema).parquet(source), ts, kind, every, late)
    return counts.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
