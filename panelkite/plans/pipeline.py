"""From raw sales rows to a stored feature table with its report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelkite.config import DEFAULT, PanelConfig
from panelkite.operators.cleaning import clean, standardize_names
from panelkite.operators.features import create_features, drop_null_rows, feature_names, feature_summary
from panelkite.operators.quality import validate
from panelkite.sources.readers import coerce_types, read_sales
from panelkite.sources.sinks import write_report, write_table


@dataclass
class PipelineResult:
    success: bool
    initial_rows: int = 0
    final_rows: int = 0
    features: list[str] = field(default_factory=list)
    path: str | None = None
    error: str | None = None


def run_pipeline(
    raw: DataFrame,
    out_dir: str,
    keys: list[str] | None = None,
    mode: str = "minimal",
    drop_nulls: bool = True,
    fmt: str = "parquet",
    cfg: PanelConfig = DEFAULT,
) -> PipelineResult:
    """Validate, clean, derive features, drop incomplete rows, write table and report.

    Findings of the validation are reported and do not stop the run. Input rows are counted by a job of their own, because
    a shuffle stage that runs again after a lost executor would count twice; stored rows are counted while they are written.
    Any failure comes back as an unsuccessful result.
    """
    keys = keys or []
    try:
        findings = validate(coerce_types(standardize_names(raw), cfg), keys, cfg)
        cleaned = clean(raw, keys, cfg=cfg)
        made = create_features(cleaned, keys, mode, cfg=cfg)
        names = feature_names(cleaned, made)
        path = f"{out_dir}/features"
        seen = Observation()
        out = (drop_null_rows(made) if drop_nulls else made).observe(seen, F.count(F.lit(1)).alias("rows"))
        write_table(out, path, fmt)
        stored = raw.sparkSession.read.format(fmt).option("header", True).schema(made.schema).load(path)
        n_in, n_out = raw.count(), seen.get.get("rows", 0)
        summary = feature_summary(stored, names, keys)
        write_report(raw.sparkSession, f"{out_dir}/report", n_in, n_out, findings, summary)
        return PipelineResult(True, n_in, n_out, names, path)
    except Exception as error:  # noqa: BLE001 - the caller gets the reason, as from a job runner
        return PipelineResult(False, error=f"{type(error).__name__}: {error}")


def run_from_source(spark, source: str, path: str, out_dir: str, keys: list[str] | None = None, **options) -> PipelineResult:
    return run_pipeline(read_sales(spark, source, path), out_dir, keys, **options)
