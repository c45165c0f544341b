"""Incremental CSV intake: new files are validated, parsed, de-duplicated and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.config import DEFAULT, PanelConfig
from panelkite.operators.cleaning import drop_duplicates
from panelkite.operators.quality import upload_check
from panelkite.sources.readers import coerce_types, parse_date


def stream_csv(spark: SparkSession, folder: str, columns: list[str], glob: str = "*.csv") -> DataFrame:
    """Headed CSV files as text columns; parsing comes after, so that a bad cell is counted and not lost."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("pathGlobFilter", glob).csv(folder)


def intake(
    raw: DataFrame, out: str, rejects: str, checks: str, checkpoint: str, keys: list[str] | None = None,
    cfg: PanelConfig = DEFAULT,
) -> None:
    """Load everything available.

    Each micro-batch writes three tables under its own batch folder: good rows (one per keys and date),
    rejected rows, and the upload check. A repeated batch overwrites only itself.
    """
    keys = keys or []
    missing = [c for c in (cfg.date_col, cfg.target_col) if c not in raw.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")

    def load(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            upload_check(batch, cfg).write.mode("overwrite").parquet(f"{checks}/batch={batch_id}")
            parsed = coerce_types(batch, cfg).withColumn(cfg.date_col, parse_date(F.col(cfg.date_col), cfg))
            good = F.col(cfg.date_col).isNotNull() & F.col(cfg.target_col).isNotNull()
            kept = drop_duplicates(parsed.filter(good), keys, cfg=cfg)
            kept.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            parsed.filter(~good).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            batch.unpersist()

    query = (
        raw.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def loaded(spark: SparkSession, out: str, keys: list[str] | None = None, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """All loaded rows, one per keys and date; on a repeat the earliest batch wins."""
    rows = spark.read.parquet(out)
    return drop_duplicates(rows, keys or [], [F.col("batch")], cfg).drop("batch")
