"""Data-quality checks as tidy rows ``keys, check, severity, column, count, pct, message``.

Each check is an aggregate whose first stage combines on the map side, so a series or a date that
holds much of the data costs no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkite.config import DEFAULT, PanelConfig, numeric_columns
from panelkite.functions.keys import attach, attach_rows, long_form, null_if_nan, series_window
from panelkite.operators.quantiles import exact_quantiles, wide_quantiles
from panelkite.session import written
from panelkite.sources.readers import parse_date

REPORT_FIELDS = ("check", "severity", "column", "count", "pct", "message")


def schema_check(df: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Missing columns are errors, extra ones warnings. Metadata only."""
    # Fixed values, here and in the checks below: the wording of the findings.
    present, wanted = set(df.columns), set(cfg.expected_columns)
    rows = [("schema", "error", c, f"Missing required columns: {c}") for c in sorted(wanted - present)]
    rows += [("schema", "warning", c, f"Unexpected columns found: {c}") for c in sorted(present - wanted)]
    return _metadata_rows(df, rows)


def type_check(df: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """A date that is not a date is a warning, a measure that is not numeric an error. Metadata only."""
    rows = []
    for f in df.schema:
        if f.name == cfg.date_col and not isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            rows.append(("type", "warning", f.name, f"Column '{f.name}' is not datetime type"))
        if f.name in (cfg.target_col, cfg.spend_col) and not isinstance(f.dataType, T.NumericType):
            kind = f.dataType.simpleString()
            rows.append(("type", "error", f.name, f"Column '{f.name}' should be numeric but is {kind}"))
    return _metadata_rows(df, rows)


def _metadata_rows(df: DataFrame, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    made = [
        F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(column).alias("column"),
                 F.lit(1).cast("long").alias("count"), F.lit(None).cast("double").alias("pct"), F.lit(text).alias("message"))
        for check, severity, column, text in rows
    ]
    kind = "array<struct<check:string,severity:string,column:string,count:bigint,pct:double,message:string>>"
    return df.sparkSession.range(1).select(F.inline(F.array(*made).cast(kind)))


def missing_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, column, count, pct`` for every column (zero counts included)."""
    cols = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = counted.unpivot([*keys, "__n"], cols, "column", "count")
    return long.select(*keys, "column", "count", F.try_divide(100.0 * F.col("count"), "__n").alias("pct"))


def date_profile(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Rows per (keys, date): after this step a series is bounded by the calendar."""
    d = F.col(cfg.date_col).cast("date")
    return df.groupBy(*keys, d.alias(cfg.date_col)).agg(F.count("*").alias("rows"))


def date_gaps(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """One row per gap: the date after it and the distance in days to the one before."""
    w = series_window(keys, cfg.date_col)
    dates = date_profile(df, keys, cfg).filter(F.col(cfg.date_col).isNotNull())
    gapped = dates.select(*keys, cfg.date_col, F.datediff(cfg.date_col, F.lag(cfg.date_col).over(w)).alias("gap_days"))
    return gapped.filter(F.col("gap_days") > 1)


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, duplicates``: rows equal to another row beyond its first occurrence."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__c"))
    return counted.groupBy(*keys).agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("duplicates"))


def duplicate_dates(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    return date_profile(df, keys, cfg).groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicates")
    )


def iqr_bounds(
    df: DataFrame, keys: list[str], columns: list[str], k: float = 1.5, accuracy: int | None = None
) -> DataFrame:
    """``keys, column, q1, q3, lower_bound, upper_bound`` from exact quantiles of any group size.

    With an ``accuracy`` the quartiles are values of the data whose ranks are off by at most a share of 1/accuracy, from one
    pass that combines sketches on the map side.
    """
    if accuracy is None:
        q = wide_quantiles(exact_quantiles(df, keys, columns, (0.25, 0.75)), keys, {0.25: "q1", 0.75: "q3"})
    else:
        sketch = F.percentile_approx("v", [0.25, 0.75], accuracy)
        long = null_if_nan(long_form(df, keys, columns))
        q = long.groupBy(*keys, "column").agg(sketch.alias("q")).select(
            *keys, "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select("*", (F.col("q1") - k * iqr).alias("lower_bound"), (F.col("q3") + k * iqr).alias("upper_bound"))


def iqr_outliers(df: DataFrame, keys: list[str], columns: list[str], accuracy: int | None = None) -> DataFrame:
    """``keys, column, q1, q3, lower_bound, upper_bound, count, pct`` of values outside the bounds."""
    bounds = written(iqr_bounds(df, keys, columns, accuracy=accuracy), "bounds")
    long = long_form(df, keys, columns)
    rows = attach_rows(
        long, bounds.select(*keys, "column", "lower_bound", "upper_bound"), [*keys, "column"], stored=True)
    outside = (F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound"))
    counted = rows.groupBy(*keys, "column").agg(F.count_if(outside).alias("count"), F.count("*").alias("n"))
    return attach(bounds, counted, [*keys, "column"]).select(
        *bounds.columns, "count", (100.0 * F.col("count") / F.col("n")).alias("pct")
    )


def validate(df: DataFrame, keys: list[str] | None = None, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """All checks. Only findings are rows; no error row for a series means it is valid."""
    keys = keys or []
    present = set(df.columns)
    parts = [_spread(schema_check(df.drop(*keys), cfg), df, keys), _spread(type_check(df, cfg), df, keys)]

    cols = [c for c in df.columns if c not in keys]
    critical = [cfg.date_col, cfg.target_col]
    aggs = [F.count("*").alias("__n")] + [F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in cols]
    numeric = set(numeric_columns(df))
    measures = [c for c in (cfg.target_col, cfg.spend_col) if c in numeric]
    for c in measures:
        aggs += [F.min(c).alias(f"__min_{c}"), F.max(c).alias(f"__max_{c}")]
    if cfg.holiday_col in present:
        ok = F.coalesce(F.col(cfg.holiday_col).try_cast("double").isin(0.0, 1.0), F.lit(False))
        aggs.append(F.count_if(~ok).alias("__bad_flag"))
    facts = df.groupBy(*keys).agg(*aggs)

    pct = lambda n: F.try_divide(100.0 * n, F.col("__n"))
    found: list[Column] = []
    for c in cols:
        n = F.col(f"__null_{c}")
        if c in critical:
            text = F.format_string(f"Column '{c}' has %d missing values", n)
            found.append(_finding(n > 0, "missing", "error", c, n, pct(n), text))
        else:
            text = F.format_string(f"Column '{c}' has %d missing values (%.1f%%)", n, pct(n))
            found.append(_finding(n > 0, "missing", "warning", c, n, pct(n), text))
    one = F.lit(1).cast("long")
    none = F.lit(None).cast("double")
    limits = {cfg.target_col: (cfg.min_sales, cfg.max_sales), cfg.spend_col: (cfg.min_spend, cfg.max_spend)}
    for c in measures:
        lo, hi = (F.col(f"__{m}_{c}").cast("double") for m in ("min", "max"))
        low, high = limits[c]
        below = F.format_string(f"Column '{c}' has values below minimum (%s < {low})", lo.cast("string"))
        above = F.format_string(f"Column '{c}' has unusually high values (%s > {high})", hi.cast("string"))
        found.append(_finding(lo < low, "range", "error", c, one, none, below))
        found.append(_finding(hi > high, "range", "warning", c, one, none, above))
    if cfg.holiday_col in present:
        n = F.col("__bad_flag")
        text = F.format_string("Holiday flag should be binary (0/1), found %d other values", n)
        found.append(_finding(n > 0, "binary", "error", cfg.holiday_col, n, pct(n), text))
    parts.append(facts.select(*keys, F.inline(F.array_compact(F.array(*found)))))

    if cfg.date_col in present:
        dates = date_profile(_as_dates(df, cfg), keys, cfg)
        w = series_window(keys, cfg.date_col)
        gap = F.datediff(cfg.date_col, F.lag(cfg.date_col).over(w))
        per = dates.select(*keys, "rows", gap.alias("gap")).groupBy(*keys).agg(
            F.count_if(F.col("gap") > 1).alias("__gaps"), F.sum(F.col("rows") - 1).alias("__dups")
        )
        gaps, dups = F.col("__gaps"), F.col("__dups")
        found = [
            _finding(gaps > 0, "date_gaps", "warning", cfg.date_col, gaps, none,
                     F.format_string("Found %d date gaps in the data", gaps)),
            _finding(dups > 0, "duplicate_dates", "error", cfg.date_col, dups, none,
                     F.format_string("Found %d duplicate dates", dups)),
        ]
        parts.append(per.select(*keys, F.inline(F.array_compact(F.array(*found)))))

    dup = F.col("duplicates")
    row_dups = _finding(dup > 0, "duplicate_rows", "warning", None, dup, none,
                        F.format_string("Found %d duplicate rows", dup))
    parts.append(duplicate_rows(df, keys).select(*keys, F.inline(F.array_compact(F.array(row_dups)))))

    if measures:
        n, share = F.col("count"), F.col("pct")
        text = F.format_string("Column '%s' has %d outliers (%.1f%%)", "column", n, share)
        outliers = iqr_outliers(df, keys, measures).filter(n > 0)
        parts.append(outliers.select(
            *keys, F.lit("iqr_outliers").alias("check"), F.lit("warning").alias("severity"), "column", "count",
            "pct", text.alias("message")))
    return reduce(DataFrame.unionByName, [p.select(*keys, *REPORT_FIELDS) for p in parts])


def _as_dates(df: DataFrame, cfg: PanelConfig) -> DataFrame:
    if isinstance(df.schema[cfg.date_col].dataType, T.StringType):
        return df.withColumn(cfg.date_col, parse_date(F.col(cfg.date_col), cfg))
    return df


def _finding(when: Column, check: str, severity: str, column: str | None, n: Column, pct: Column, text: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(check).alias("check"),
            F.lit(severity).alias("severity"),
            F.lit(column).cast("string").alias("column"),
            n.cast("long").alias("count"),
            pct.cast("double").alias("pct"),
            text.alias("message"),
        ),
    )


def _spread(rows: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Table-level findings carry NULL keys: they hold for every series alike."""
    kinds = {f.name: f.dataType for f in df.schema}
    return rows.select(*[F.lit(None).cast(kinds[k]).alias(k) for k in keys], "*")


def validation_summary(report: DataFrame, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, is_valid, errors, warnings`` for every series, table-level findings added to each."""
    keys = keys or []
    counts = lambda d: d.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    if not keys:
        return counts(report).select((F.col("errors") == 0).alias("is_valid"), "errors", "warnings")
    table_level = report.filter(F.col("check").isin("schema", "type"))
    shared = counts(table_level).select(F.struct("errors", "warnings")).scalar()
    own = counts(report.filter(~F.col("check").isin("schema", "type")).groupBy(*keys))
    series = df.select(*keys).distinct()
    joined = attach(series, own, keys).withColumn("__t", shared)
    errors = F.coalesce("errors", F.lit(0)) + F.col("__t.errors")
    warnings = F.coalesce("warnings", F.lit(0)) + F.col("__t.warnings")
    return joined.select(*keys, (errors == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))


def summary_statistics(df: DataFrame, keys: list[str], cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Rows, target moments, exact median and date span per series."""
    d = F.col(cfg.date_col).cast("date")
    x = cfg.target_col
    base = df.groupBy(*keys).agg(
        F.count("*").alias("total_rows"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.min(d).alias("date_start"),
        F.max(d).alias("date_end"),
    )
    median = wide_quantiles(exact_quantiles(df, keys, [x], (0.5,)), keys, {0.5: "median"}).drop("column")
    out = attach(base, median, keys) if keys else base.withColumn("median", median.select("median").scalar())
    return out.select(
        *keys,
        "total_rows",
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        "mean", "std", "min", "max", "median", "date_start", "date_end",
        (F.datediff("date_end", "date_start") + 1).cast("long").alias("days"),
    )


def data_info(df: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """``column, dtype, nulls, rows, total_nulls, date_start, date_end`` from one scan."""
    cols = df.columns
    kinds = dict(df.dtypes)
    aggs = [F.count("*").alias("__n")] + [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    has_date = cfg.date_col in cols
    span = F.col(cfg.date_col).cast("date") if has_date else F.lit(None).cast("date")
    aggs += [F.min(span).alias("__lo"), F.max(span).alias("__hi")]
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    types_map = F.create_map(*[F.lit(v) for c in cols for v in (c, kinds[c])])
    wide = df.agg(*aggs).withColumn("__total", total)
    long = wide.unpivot(["__n", "__lo", "__hi", "__total"], cols, "column", "nulls")
    return long.select(
        "column",
        types_map[F.col("column")].alias("dtype"),
        "nulls",
        F.col("__n").alias("rows"),
        F.col("__total").alias("total_nulls"),
        F.col("__lo").alias("date_start"),
        F.col("__hi").alias("date_end"),
    )


def quality_report(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per numeric column: rows, nulls, mean, std, min, max, exact median, skew and kurtosis; plus row duplicates."""
    from panelkite.operators.eda import bias_corrected_kurtosis, bias_corrected_skew

    keys = keys or []
    cols = numeric_columns(df, exclude=keys)
    aggs = []
    for c in cols:
        x, n = F.col(c).cast("double"), F.count(c)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                bias_corrected_skew(F.skewness(x), n).alias("skewness"),
                bias_corrected_kurtosis(F.kurtosis(x), n).alias("kurtosis"),
            ).alias(f"s_{c}")
        )
    wide = df.groupBy(*keys).agg(F.count("*").alias("rows"), *aggs)
    long = wide.select(*keys, "rows", F.inline(F.array(*[F.col(f"s_{c}") for c in cols])))
    median = wide_quantiles(exact_quantiles(df, keys, cols, (0.5,)), keys, {0.5: "median"})
    out = attach(long, median, [*keys, "column"])
    dups = duplicate_rows(df, keys)
    return attach(out, dups, keys)


def quality_check(df: DataFrame, keys: list[str] | None = None, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """Tidy rows ``keys, kind, name, count, pct``: columns with nulls, duplicates, and each date gap."""
    keys = keys or []
    none = F.lit(None).cast("double")
    nulls = missing_values(df, keys).filter(F.col("count") > 0).select(
        *keys, F.lit("missing").alias("kind"), F.col("column").alias("name"), "count", "pct")
    dups = duplicate_rows(df, keys).select(
        *keys, F.lit("duplicates").alias("kind"), F.lit("rows").alias("name"), F.col("duplicates").alias("count"),
        none.alias("pct"))
    gaps = date_gaps(df, keys, cfg).select(
        *keys, F.lit("date_gap").alias("kind"), F.col(cfg.date_col).cast("string").alias("name"),
        F.col("gap_days").cast("long").alias("count"), none.alias("pct"))
    return nulls.unionByName(dups).unionByName(gaps)


def upload_check(df: DataFrame, cfg: PanelConfig = DEFAULT) -> DataFrame:
    """One row for raw (text) input: required columns, readable dates and targets, row count, date span."""
    required = [cfg.date_col, cfg.target_col]
    missing = [c for c in required if c not in df.columns]
    d = parse_date(F.col(cfg.date_col), cfg) if cfg.date_col in df.columns else F.lit(None).cast("date")
    y = F.col(cfg.target_col).try_cast("double") if cfg.target_col in df.columns else F.lit(None).cast("double")
    bad_d = F.count_if(d.isNull() & F.col(cfg.date_col).isNotNull()) if cfg.date_col in df.columns else F.lit(0)
    bad_y = F.count_if(y.isNull() & F.col(cfg.target_col).isNotNull()) if cfg.target_col in df.columns else F.lit(0)
    out = df.agg(
        F.count("*").alias("rows"),
        bad_d.cast("long").alias("bad_dates"),
        bad_y.cast("long").alias("bad_targets"),
        F.min(d).alias("date_start"),
        F.max(d).alias("date_end"),
    )
    ok = F.lit(not missing) & (F.col("bad_dates") == 0) & (F.col("bad_targets") == 0) & (F.col("rows") > 0)
    return out.select(
        ok.alias("accepted"),
        F.lit(",".join(missing)).alias("missing_columns"),
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "bad_dates", "bad_targets", "date_start", "date_end",
    )
