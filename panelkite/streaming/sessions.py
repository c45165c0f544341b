"""Event-time sessions, severity counts and recent items over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelkite.functions.keys import join_series
from panelkite.operators.sessions import HISTORY_LENGTH, SESSION_GAP_SECONDS, severity
from panelkite.streaming.state import newest_items

LATE = "1 day"


def read_events(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    """A Parquet folder as a stream; zone-less timestamps become timestamps, so they can carry a watermark."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    ntz = [n for n, t in raw.dtypes if t == "timestamp_ntz"]
    return raw.withColumns({n: F.col(n).cast("timestamp") for n in ntz}) if ntz else raw


def session_stream(
    events: DataFrame, by: list[str], ts: str = "ts", value: str = "value",
    gap_seconds: int = SESSION_GAP_SECONDS, late: str = LATE,
) -> DataFrame:
    """Closed sessions in append mode; rows later than ``late`` are dropped by the watermark.

    Sessions are merged within each input partition before the shuffle, so an entity with much of a
    micro-batch sends a few partial sessions per partition and not its rows.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    window = F.session_window(ts, f"{gap_seconds} seconds")
    grouped = events.withWatermark(ts, late).groupBy(*by, window.alias("session"))
    return grouped.agg(F.count("*").alias("n_events"), F.sum(value).alias("total_value")).select(
        *by, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
        "n_events", "total_value",
    )


def severity_stream(events: DataFrame, line: str, ts: str = "ts", width: str = "1 day", late: str = LATE) -> DataFrame:
    """Lines per tumbling window and severity."""
    counted = events.withWatermark(ts, late).groupBy(
        F.window(ts, width).alias("w"), severity(F.col(line)).alias("severity"))
    return counted.agg(F.count("*").alias("lines")).select(F.col("w.start").alias("window_start"), "severity", "lines")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, append to a Parquet table, stop. Exactly once across restarts."""
    query: StreamingQuery = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def keep_last_items(
    stream: DataFrame, by: list[str], out: str, checkpoint: str, n: int = HISTORY_LENGTH, ts: str = "ts", tie: str = "event_id",
    ttl_ms: int | None = None,
) -> StreamingQuery:
    """Maintain the newest ``n`` rows per entity in keyed state; read them with :func:`read_last_items`.

    A batch touches the state of its own entities only, and writes those whose rows changed into a folder of its number, so a
    repeated batch overwrites itself. :func:`compact_last_items` folds old folders together.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        newest_items(stream, by, n, ts, tie, ttl_ms).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_last_items(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    """The rows of the newest batch that changed each entity."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy(*by).agg(F.max("batch").alias("__newest"))
    return join_series(rows, newest, by).filter(F.col("batch") == F.col("__newest")).drop("batch", "__newest")


def compact_last_items(spark: SparkSession, out: str, into: str, by: list[str]) -> None:
    """Write the current rows as the first batch of a new folder, to go on from there with the same checkpoint."""
    read_last_items(spark, out, by).write.mode("overwrite").parquet(f"{into}/batch=-1")
