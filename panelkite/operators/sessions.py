"""Sessions, recent items, liveness and log severity over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkite.operators.reshape import first_rows

# Session timeout, staleness limit and history length.
SESSION_GAP_SECONDS = 3600
STALE_SECONDS = 300
HISTORY_LENGTH = 10


def sessionize(
    events: DataFrame, by: list[str], ts: str = "ts", gap_seconds: int = SESSION_GAP_SECONDS, value: str | None = None
) -> DataFrame:
    """Sessions that end when more than ``gap_seconds`` pass without an event.

    Time is first cut into buckets of one gap: events in one bucket are never further apart than the
    gap, so they always share a session and collapse to one row in a map-side combined aggregate.
    Only these bucket rows are put in order, so a user with a third of all events costs one row per
    bucket of time and not one per event.
    """
    gap = gap_seconds * 1_000_000
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    total = F.sum(value) if value else F.lit(None).cast("double")
    buckets = (
        events.select(*by, t.alias("__t"), *([value] if value else []))
        .groupBy(*by, F.floor(F.col("__t") / gap).alias("__b"))
        .agg(
            F.min("__t").alias("first"),
            F.max("__t").alias("last"),
            F.count("*").alias("n"),
            total.alias("v"),
        )
    )
    w = W.partitionBy(*by).orderBy("__b")
    opened = F.coalesce(F.col("first") - F.lag("last").over(w) > gap, F.lit(True)).cast("int")
    numbered = buckets.withColumn("__open", opened).withColumn(
        "session_no", F.sum("__open").over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy(*by, "session_no")
        .agg(
            F.timestamp_micros(F.min("first")).alias("session_start"),
            F.timestamp_micros(F.max("last")).alias("last_event"),
            F.sum("n").alias("n_events"),
            F.sum("v").alias("total_value"),
        )
    )


def last_items(events: DataFrame, by: list[str], n: int = HISTORY_LENGTH, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return first_rows(events, by, [F.desc(ts), F.desc(tie)], n)


def liveness(
    events: DataFrame,
    by: list[str],
    ts: str = "ts",
    now: Column | None = None,
    timeout_seconds: int = SESSION_GAP_SECONDS,
    stale_seconds: int = STALE_SECONDS,
) -> DataFrame:
    """Last sign of life per entity, and whether it is active or stale at ``now`` (default: the newest event)."""
    seen = events.groupBy(*by).agg(F.max(F.col(ts).cast("timestamp")).alias("last_seen"))
    if now is None:
        now = events.agg(F.max(F.col(ts).cast("timestamp")).alias("now")).scalar()
    idle = (F.unix_micros("__now") - F.unix_micros("last_seen")) / 1_000_000
    out = seen.withColumn("__now", now).withColumn("idle_seconds", idle)
    return out.select(
        *by, "last_seen", "idle_seconds",
        (F.col("idle_seconds") <= timeout_seconds).alias("is_active"),
        (F.col("idle_seconds") > stale_seconds).alias("is_stale"),
    )


def severity(line: Column) -> Column:
    """First rule that matches, case-insensitive."""
    # The marker words and the severities.
    up = F.upper(line)
    return (
        F.when(up.contains("ERROR") | up.contains("FAIL"), "error")
        .when(up.contains("WARN"), "warning")
        .when(up.contains("SUCCESS") | up.contains("COMPLETE"), "success")
        .otherwise("info")
    )


def severity_counts(lines: DataFrame, line: str, by: list[str] | None = None) -> DataFrame:
    return lines.groupBy(*(by or []), severity(F.col(line)).alias("severity")).agg(F.count("*").alias("lines"))
