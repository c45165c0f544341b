"""Equivalent SQL (DuckDB dialect) for the queries of :mod:`panelkite.plans.queries`."""

from __future__ import annotations

import json
import math

from panelkite.functions.scalars import AS241
from panelkite.models.registry import resolve, sample_params

_PANEL = """
sp AS (SELECT l_orderkey, sum(l_extendedprice * l_discount) AS spend FROM lineitem GROUP BY 1),
p AS (
  SELECT c_mktsegment, CAST(o_orderdate AS DATE) AS date,
         round(sum(o_totalprice), 2) AS daily_sales, round(sum(spend), 4) AS marketing_spend,
         CASE WHEN (month(CAST(o_orderdate AS DATE)), day(CAST(o_orderdate AS DATE))) IN ((1,1),(7,4),(12,25))
              THEN 1 ELSE 0 END AS is_holiday,
         c_mktsegment AS product_category
  FROM orders LEFT JOIN sp ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY c_mktsegment, CAST(o_orderdate AS DATE))"""

_RAW = """
raw AS (
  SELECT c_mktsegment,
         CASE WHEN o_totalprice > 1000 THEN CAST(o_orderdate AS DATE) END AS date,
         CASE WHEN NOT (o_orderpriority LIKE '5%' AND o_orderstatus = 'F') THEN o_totalprice - 2000 END AS daily_sales,
         CASE WHEN o_orderstatus <> 'O' THEN 'open' END AS product_category,
         o_totalprice AS marketing_spend,
         CAST(substr(o_orderpriority, 1, 1) AS INT) AS is_holiday
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_GAPPY = _PANEL + """,
g AS (
  SELECT c_mktsegment, date,
         CASE WHEN day(date) > 2 THEN daily_sales END AS daily_sales,
         CASE WHEN day(date) > 2 THEN marketing_spend END AS marketing_spend,
         CASE WHEN isodow(date) < 6 THEN dayname(date) END AS product_category
  FROM p)"""

_W = "(PARTITION BY c_mktsegment ORDER BY date)"
_NAIVE = _PANEL + """,
nv AS (
  SELECT c_mktsegment, date, daily_sales AS actual, 'naive_' || k AS model_name,
         CASE k WHEN 1 THEN lag(daily_sales, 1) OVER w WHEN 7 THEN lag(daily_sales, 7) OVER w
                WHEN 14 THEN lag(daily_sales, 14) OVER w ELSE lag(daily_sales, 28) OVER w END AS predicted
  FROM p CROSS JOIN (VALUES (1), (7), (14), (28)) AS ks(k)
  WINDOW w AS (PARTITION BY c_mktsegment, k ORDER BY date)),
n AS (SELECT * FROM nv WHERE predicted IS NOT NULL)"""


def _sql(ctes: str, keep: str, values: dict[str, str], source: str, dp: int = 4, tail: str = "") -> str:
    cols = [keep] if keep else []
    cols += [f"round({expr}, {_dp(name, dp)}) AS {name}" for name, expr in values.items()]
    return f"WITH {ctes.strip().lstrip(',')} SELECT {', '.join(cols)} FROM {source} {tail}"


def _dp(name: str, dp: int) -> int:
    """The same places as ``queries.places``."""
    if name == "mse":
        return 0
    if "ewm" in name:
        return min(dp, 3)
    if "spend" in name or "deviation" in name or (dp == 4 and ("mean" in name or "bound" in name or "avg" in name)):
        return max(dp, 6)
    return dp


def _frame(n: int) -> str:
    return f"(PARTITION BY c_mktsegment ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum", "median": "median"}

_FULL_DATE = {
    "year": "year(date)", "month": "month(date)", "day": "day(date)", "quarter": "quarter(date)",
    "day_of_week_num": "isodow(date) - 1", "day_of_year": "dayofyear(date)", "week_of_year": "week(date)",
    "is_weekend": "CAST(isodow(date) >= 6 AS BIGINT)",
    "is_month_start": "CAST(day(date) = 1 AS BIGINT)",
    "is_month_end": "CAST(date = last_day(date) AS BIGINT)",
    "is_quarter_start": "CAST(date = CAST(date_trunc('quarter', date) AS DATE) AS BIGINT)",
    "is_quarter_end": "CAST(date = last_day(date) AND month(date) % 3 = 0 AS BIGINT)",
    "is_year_start": "CAST(dayofyear(date) = 1 AS BIGINT)",
    "is_year_end": "CAST(month(date) = 12 AND day(date) = 31 AS BIGINT)",
    "days_in_month": "day(last_day(date))",
}
_MINIMAL_DATE = {k: _FULL_DATE[k] for k in ("day_of_week_num", "month", "quarter", "day_of_year", "is_weekend")}


def _cyclical(names=("day_of_week", "month", "day_of_year", "week_of_year")) -> dict[str, str]:
    pos = {"day_of_week": ("(isodow(date) - 1)", 7), "month": ("month(date)", 12),
           "day_of_year": ("dayofyear(date)", 365), "week_of_year": ("week(date)", 52)}
    out = {}
    for name in names:
        x, period = pos[name]
        out[f"{name}_sin"] = f"sin(2 * pi() * {x} / {period})"
        out[f"{name}_cos"] = f"cos(2 * pi() * {x} / {period})"
    return out


_DAYS = f"(date - min(date) OVER (PARTITION BY c_mktsegment))"
_SPAN = "(max(date) OVER (PARTITION BY c_mktsegment) - min(date) OVER (PARTITION BY c_mktsegment))"
_NORM = f"coalesce({_DAYS} / nullif(CAST({_SPAN} AS DOUBLE), 0), 0)"


def _lag(k: int, x: str = "daily_sales") -> str:
    return f"lag({x}, {k}) OVER {_W}"


def _ratio(k: int) -> str:
    return f"(daily_sales / nullif({_lag(k)}, 0))"


def _roll(stat: str, n: int, x: str = "daily_sales") -> str:
    return f"{_AGG[stat]}({x}) OVER {_frame(n)}"


def _as_bigint(cols: dict[str, str]) -> str:
    return ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in cols.items())


_EFF = "daily_sales / nullif(marketing_spend, 0)"
_INTERACTIONS = {
    "marketing_efficiency": _EFF,
    "marketing_efficiency_lag_7": f"lag({_EFF}, 7) OVER {_W}",
    "sales_deviation_7": f"daily_sales - {_roll('mean', 7)}",
    "sales_deviation_28": f"daily_sales - {_roll('mean', 28)}",
}
_HOLIDAY_WEEKEND = "CAST(is_holiday * CAST(isodow(date) >= 6 AS INT) AS BIGINT) AS holiday_weekend"

_LAGS = {}
for _k in (1, 7, 14, 28):
    _LAGS[f"daily_sales_lag_{_k}"] = _lag(_k)
    _LAGS[f"marketing_spend_lag_{_k}"] = _lag(_k, "marketing_spend")
for _k in (1, 7):
    _LAGS[f"daily_sales_diff_{_k}"] = f"daily_sales - {_lag(_k)}"
for _k in (1, 7):
    _LAGS[f"daily_sales_pct_change_{_k}"] = f"{_ratio(_k)} - 1"

_ROLLS = {}
for _n in (7, 14, 28):
    for _s in ("mean", "std", "min", "max", "median", "sum"):
        _ROLLS[f"daily_sales_rolling_{_s}_{_n}"] = _roll(_s, _n)
    _ROLLS[f"marketing_spend_rolling_mean_{_n}"] = _roll("mean", _n, "marketing_spend")

_MINIMAL = {
    "daily_sales_lag_1": _lag(1), "daily_sales_lag_7": _lag(7), "daily_sales_diff_1": f"daily_sales - {_lag(1)}",
    "daily_sales_rolling_mean_7": _roll("mean", 7), "daily_sales_rolling_std_7": _roll("std", 7),
    "marketing_spend_rolling_mean_7": _roll("mean", 7, "marketing_spend"), "time_normalized": _NORM,
}
_BASE_COLS = "c_mktsegment, date, round(daily_sales, 4) AS daily_sales, round(marketing_spend, 6) AS marketing_spend, CAST(is_holiday AS BIGINT) AS is_holiday"

_EWM_CTE = _PANEL + ", i AS (SELECT *, row_number() OVER " + _W + " AS pos FROM p)"
for _span in (7, 14, 28):
    _a = 2.0 / (_span + 1.0)
    _K = math.ceil(37.0 / -math.log1p(-_a))
    _wt = f"pow({1.0 - _a!r}, b.pos - a.pos - 1)"
    _EWM_CTE += (
        f", e{_span} AS (SELECT b.c_mktsegment, b.date, sum({_wt} * a.daily_sales) / sum({_wt}) AS v FROM i b "
        f"JOIN i a ON a.c_mktsegment = b.c_mktsegment AND a.pos BETWEEN b.pos - {_K} AND b.pos - 1 GROUP BY 1, 2)"
    )
_EWM_JOIN = " ".join(f"LEFT JOIN e{s} USING (c_mktsegment, date)" for s in (7, 14, 28))


def _minimal_sql() -> str:
    ints = _as_bigint(_MINIMAL_DATE | {"days_since_start": _DAYS})
    return _sql(_PANEL, f"{_BASE_COLS}, {ints}", _cyclical(("day_of_week",)) | _MINIMAL, "p")


def _full_sql() -> str:
    ints = _as_bigint(_FULL_DATE | {"days_since_start": _DAYS})
    values = _cyclical() | _LAGS | _ROLLS | {"time_normalized": _NORM}
    values |= {"sales_vs_last_week": _ratio(7), "sales_vs_last_month": _ratio(28)} | _INTERACTIONS
    values |= {f"daily_sales_ewm_{s}": f"e{s}.v" for s in (7, 14, 28)}
    return _sql(_EWM_CTE, f"{_BASE_COLS}, {ints}, {_HOLIDAY_WEEKEND}", values, f"i {_EWM_JOIN}")


def _unpivot(columns: dict[str, str], source: str, lead: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {lead}, '{n}' AS {extra or 'column'}, {e} FROM {source}" for n, e in columns.items())


def _cast_union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {}

ORACLES["daily_panel_by_segment"] = _sql(_PANEL, _BASE_COLS + ", product_category", {}, "p")
ORACLES["daily_panel_by_region"] = """
WITH sp AS (SELECT l_orderkey, sum(l_extendedprice * l_discount) AS spend FROM lineitem GROUP BY 1)
SELECT r_name, n_name, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS daily_sales,
       round(sum(spend), 4) AS marketing_spend,
       CAST(CASE WHEN (month(CAST(o_orderdate AS DATE)), day(CAST(o_orderdate AS DATE))) IN ((1,1),(7,4),(12,25))
            THEN 1 ELSE 0 END AS BIGINT) AS is_holiday, 'All' AS product_category
FROM orders LEFT JOIN sp ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"""
ORACLES["daily_event_panel"] = """
SELECT event_type, CAST(ts AS DATE) AS date, round(sum(value), 2) AS daily_sales, count(*) AS n_events
FROM events GROUP BY 1, 2"""
ORACLES["table_summary"] = _sql(
    _PANEL, "count(*) AS total_records, min(date) AS start_date, max(date) AS end_date",
    {"avg_sales": "avg(daily_sales)", "min_sales": "min(daily_sales)", "max_sales": "max(daily_sales)"}, "p")
ORACLES["history_summary"] = _sql(
    _PANEL, "c_mktsegment, count(*) AS count",
    {"mean": "avg(daily_sales)", "min": "min(daily_sales)", "max": "max(daily_sales)", "std": "stddev_samp(daily_sales)"},
    "p", 2, "GROUP BY c_mktsegment")
ORACLES["date_range_scan"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 4) AS o_totalprice FROM orders
WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"""
ORACLES["timestamp_range_scan"] = """
SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(DISTINCT event_id) AS ids FROM events
WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-06' GROUP BY 1"""
ORACLES["csv_scan"] = """
SELECT CAST(o_orderkey % 7 AS DOUBLE) AS marketing_spend, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS keys,
       round(sum(o_totalprice), 2) AS sales, min(CAST(o_orderdate AS DATE)) AS first_date FROM orders GROUP BY 1"""
ORACLES["csv_corrupt_rows"] = """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS k, o_orderkey % 10 = 0 AS is_corrupt,
                  strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ',' || o_orderkey || ',5,7' AS line FROM orders)
SELECT date, is_corrupt, count(*) AS n, CAST(sum(k) AS DOUBLE) AS sales, max(CASE WHEN is_corrupt THEN line END) AS last_line
FROM o GROUP BY 1, 2"""
ORACLES["dedup_null_rows"] = _sql(_PANEL, "c_mktsegment, date", {"daily_sales": "daily_sales"}, "p")
ORACLES["history_export"] = _sql(
    _GAPPY, "strftime(date, '%Y-%m-%d') AS date, CAST(0 AS BIGINT) AS is_holiday",
    {"daily_sales": "coalesce(daily_sales, 0.0)", "marketing_spend": "coalesce(marketing_spend, 0.0)"}, "g")
ORACLES["calendar_features"] = _sql(
    _PANEL, "c_mktsegment, date, " + _as_bigint(_FULL_DATE) + ", dayname(date) AS day_name, "
    "substr(dayname(date), 1, 3) AS short_day, strftime(date, '%Y-%m') AS month_key", {}, "p")
ORACLES["cyclical_features"] = _sql(_PANEL, "c_mktsegment, date", _cyclical(), "p", 9)
ORACLES["weekday_one_hot"] = _sql(
    _PANEL, "c_mktsegment, date", {f"dow_{i}": f"CASE WHEN isodow(date) = {i + 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for i in range(7)}, "p")
ORACLES["trend_scalars"] = _sql(
    _PANEL, f"c_mktsegment, date, CAST({_DAYS} AS BIGINT) AS days_since_start", {"time_normalized": _NORM}, "p", 9)
ORACLES["interaction_features"] = _sql(_PANEL, f"c_mktsegment, date, {_HOLIDAY_WEEKEND}", _INTERACTIONS, "p")
ORACLES["minimal_features"] = _minimal_sql()
ORACLES["full_features"] = _full_sql()

_MIN_NULLS = {n: "0" for n in (*_MINIMAL_DATE, "day_of_week_sin", "day_of_week_cos", "days_since_start", "time_normalized")}
_MIN_NULLS |= {n: f"count(*) FILTER (f_{n} IS NULL)" for n in _MINIMAL if n != "time_normalized"}
ORACLES["feature_null_summary"] = (
    f"WITH {_PANEL}, m AS (SELECT c_mktsegment, "
    + ", ".join(f"{e} AS f_{n}" for n, e in _MINIMAL.items() if n != "time_normalized")
    + " FROM p) "
    + " UNION ALL ".join(
        f"SELECT c_mktsegment, '{n}' AS feature, CAST(15 AS BIGINT) AS total_features, CAST({e} AS BIGINT) AS nulls FROM m GROUP BY 1"
        for n, e in _MIN_NULLS.items()))
ORACLES["complete_feature_rows"] = (
    f"WITH {_PANEL}, m AS (SELECT c_mktsegment, date, {', '.join(f'{e} AS {n}' for n, e in _MINIMAL.items())}, marketing_spend, daily_sales FROM p) "
    "SELECT c_mktsegment, date, round(daily_sales_lag_7, 4) AS daily_sales_lag_7 FROM m WHERE marketing_spend IS NOT NULL AND "
    + " AND ".join(f"{n} IS NOT NULL" for n in _MINIMAL))
ORACLES["row_search"] = _sql(
    _PANEL, "c_mktsegment, date", {"daily_sales": "daily_sales"}, "p",
    tail="WHERE contains(lower(c_mktsegment || ' ' || CAST(date AS VARCHAR)), 'mach')")

ORACLES["lag_diff_pct"] = _sql(
    _PANEL, "c_mktsegment, date",
    {f"sales_lag_{k}": _lag(k) for k in (1, 7, 14, 28)}
    | {f"spend_lag_{k}": _lag(k, "marketing_spend") for k in (1, 7, 14, 28)}
    | {f"diff_{k}": f"daily_sales - {_lag(k)}" for k in (1, 7)}
    | {f"pct_{k}": f"{_ratio(k)} - 1" for k in (1, 7)}, "p")
ORACLES["period_ratio"] = _sql(
    _PANEL, "c_mktsegment, date", {"sales_vs_last_week": _ratio(7), "sales_vs_last_month": _ratio(28)}, "p")
ORACLES["rolling_stats"] = _sql(
    _PANEL, "c_mktsegment, date",
    {f"{s}_{n}": _roll(s, n) for n in (7, 14, 28) for s in ("mean", "std", "min", "max", "sum")}, "p")
ORACLES["rolling_median"] = _sql(
    _PANEL, "c_mktsegment, date", {f"median_{n}": _roll("median", n) for n in (7, 14, 28)}, "p")
ORACLES["strict_rolling"] = _sql(
    _PANEL, "c_mktsegment, date",
    {f"{s}_{n}": f"CASE WHEN count(daily_sales) OVER {_frame(n)} = {n} THEN {_roll(s, n)} END"
     for n in (7, 14) for s in ("mean", "std")}, "p")


def _ma(n: int) -> str:
    f = f"(PARTITION BY c_mktsegment ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(daily_sales) OVER {f} = {n} THEN avg(daily_sales) OVER {f} END"


ORACLES["moving_average"] = _sql(
    _PANEL, "c_mktsegment, date", {"daily_sales": "daily_sales", "ma_7": _ma(7), "ma_30": _ma(30)}, "p")
ORACLES["ewm_mean"] = _sql(
    _EWM_CTE, "c_mktsegment, date", {"daily_sales": "daily_sales"} | {f"ewm_{s}": f"e{s}.v" for s in (7, 14, 28)}, f"i {_EWM_JOIN}")
ORACLES["day_number_and_gap"] = _sql(
    _PANEL, f"c_mktsegment, date, row_number() OVER {_W} - 1 AS day_number, CAST(date - lag(date) OVER {_W} AS BIGINT) AS gap_days", {}, "p")

# --- quality ---------------------------------------------------------------------------------

_RAW_DATES = _RAW + """,
dc AS (SELECT c_mktsegment, date, count(*) AS c FROM raw GROUP BY 1, 2),
dg AS (SELECT c_mktsegment, c, date - lag(date) OVER (PARTITION BY c_mktsegment ORDER BY date NULLS FIRST) AS gap FROM dc),
dd AS (SELECT c_mktsegment, count(*) FILTER (gap > 1) AS gaps, CAST(sum(c - 1) AS BIGINT) AS dups FROM dg GROUP BY 1),
rd AS (SELECT c_mktsegment, CAST(sum(c - 1) AS BIGINT) AS dups FROM
       (SELECT c_mktsegment, count(*) AS c FROM raw GROUP BY c_mktsegment, date, daily_sales, product_category, marketing_spend, is_holiday) GROUP BY 1),
f AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (date IS NULL) AS nd, count(*) FILTER (daily_sales IS NULL) AS ns,
             count(*) FILTER (product_category IS NULL) AS nc, min(daily_sales) AS lo_s, max(daily_sales) AS hi_s,
             min(marketing_spend) AS lo_m, max(marketing_spend) AS hi_m,
             count(*) FILTER (coalesce(is_holiday NOT IN (0, 1), true)) AS bad FROM raw GROUP BY 1),
q AS (SELECT c_mktsegment, quantile_cont(daily_sales, 0.25) AS s1, quantile_cont(daily_sales, 0.75) AS s3,
             quantile_cont(marketing_spend, 0.25) AS m1, quantile_cont(marketing_spend, 0.75) AS m3 FROM raw GROUP BY 1),
o AS (SELECT c_mktsegment, count(*) AS n,
             count(*) FILTER (daily_sales < s1 - 1.5 * (s3 - s1) OR daily_sales > s3 + 1.5 * (s3 - s1)) AS os,
             count(*) FILTER (marketing_spend < m1 - 1.5 * (m3 - m1) OR marketing_spend > m3 + 1.5 * (m3 - m1)) AS om
      FROM raw JOIN q USING (c_mktsegment) GROUP BY 1),
v AS (
  SELECT c_mktsegment, 'missing' AS "check", 'error' AS severity, 'date' AS "column", nd AS count, NULL::DOUBLE AS pct_raw, 100.0 * nd / n AS pct FROM f WHERE nd > 0
  UNION ALL SELECT c_mktsegment, 'missing', 'error', 'daily_sales', ns, NULL, 100.0 * ns / n FROM f WHERE ns > 0
  UNION ALL SELECT c_mktsegment, 'missing', 'warning', 'product_category', nc, NULL, 100.0 * nc / n FROM f WHERE nc > 0
  UNION ALL SELECT c_mktsegment, 'range', 'error', 'daily_sales', 1, NULL, NULL FROM f WHERE lo_s < 0
  UNION ALL SELECT c_mktsegment, 'range', 'warning', 'daily_sales', 1, NULL, NULL FROM f WHERE hi_s > 500000
  UNION ALL SELECT c_mktsegment, 'range', 'error', 'marketing_spend', 1, NULL, NULL FROM f WHERE lo_m < 0
  UNION ALL SELECT c_mktsegment, 'range', 'warning', 'marketing_spend', 1, NULL, NULL FROM f WHERE hi_m > 100000
  UNION ALL SELECT c_mktsegment, 'binary', 'error', 'is_holiday', bad, NULL, 100.0 * bad / n FROM f WHERE bad > 0
  UNION ALL SELECT c_mktsegment, 'date_gaps', 'warning', 'date', gaps, NULL, NULL FROM dd WHERE gaps > 0
  UNION ALL SELECT c_mktsegment, 'duplicate_dates', 'error', 'date', dups, NULL, NULL FROM dd WHERE dups > 0
  UNION ALL SELECT c_mktsegment, 'duplicate_rows', 'warning', NULL, dups, NULL, NULL FROM rd WHERE dups > 0
  UNION ALL SELECT c_mktsegment, 'iqr_outliers', 'warning', 'daily_sales', os, NULL, 100.0 * os / n FROM o WHERE os > 0
  UNION ALL SELECT c_mktsegment, 'iqr_outliers', 'warning', 'marketing_spend', om, NULL, 100.0 * om / n FROM o WHERE om > 0)"""
ORACLES["validation_report"] = f'WITH {_RAW_DATES} SELECT c_mktsegment, "check", severity, "column", count, round(pct, 4) AS pct FROM v'
# Two table-level warnings apply to no series here; "day_of_week" is missing, which is one error for each.
ORACLES["validation_summary"] = f"""WITH {_RAW_DATES}
SELECT c_mktsegment, count(*) FILTER (severity = 'error') + 1 = 0 AS is_valid,
       count(*) FILTER (severity = 'error') + 1 AS errors, count(*) FILTER (severity = 'warning') + 0 AS warnings
FROM v GROUP BY 1"""
_RAW_COLS = ("date", "daily_sales", "product_category", "marketing_spend", "is_holiday")
ORACLES["missing_values"] = f"WITH {_RAW} " + _cast_union([
    f"""SELECT c_mktsegment, '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS count,
        round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS pct FROM raw GROUP BY 1""" for c in _RAW_COLS])
_GAPS = f"dgap AS (SELECT c_mktsegment, date, CAST(date - lag(date) OVER {_W} AS BIGINT) AS gap_days FROM p)"
ORACLES["date_gaps"] = f"WITH {_PANEL}, {_GAPS} SELECT * FROM dgap WHERE gap_days > 1"
ORACLES["duplicate_rows"] = """
SELECT l_returnflag, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM
 (SELECT l_returnflag, count(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount, l_tax) GROUP BY 1"""
ORACLES["duplicate_dates"] = f"WITH {_RAW_DATES} SELECT c_mktsegment, dups AS duplicates FROM dd"
ORACLES["exact_quantiles_rows"] = _cast_union([
    f"""SELECT l_returnflag, '{c}' AS "column", round({p}::DOUBLE, 4) AS prob, round(quantile_cont({c}, {p}), 4) AS value
        FROM lineitem GROUP BY 1""" for c in ("l_extendedprice", "l_quantity") for p in (0.05, 0.25, 0.5, 0.75, 0.99)])
ORACLES["iqr_outliers_rows"] = _cast_union([
    f"""SELECT l_returnflag, '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3,
        round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS count,
        round(100.0 * count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS pct
        FROM lineitem JOIN (SELECT l_returnflag, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem GROUP BY 1)
        USING (l_returnflag) GROUP BY l_returnflag, q1, q3""" for c in ("l_extendedprice", "l_quantity")])
ORACLES["iqr_outliers_sketched"] = ORACLES["iqr_outliers_rows"].replace("quantile_cont", "quantile_disc")
ORACLES["summary_statistics"] = _sql(
    _RAW, "c_mktsegment, count(*) AS total_rows, min(date) AS date_start, max(date) AS date_end, CAST(max(date) - min(date) + 1 AS BIGINT) AS days",
    {"mean": "avg(daily_sales)", "std": "stddev_samp(daily_sales)", "min": "min(daily_sales)", "max": "max(daily_sales)",
     "median": "median(daily_sales)"}, "raw", 4, "GROUP BY c_mktsegment")
_INFO = ("c_mktsegment", *_RAW_COLS)
ORACLES["data_info"] = f"WITH {_RAW}, t AS (SELECT count(*) AS n, min(date) AS lo, max(date) AS hi, " + ", ".join(
    f"count(*) FILTER ({c} IS NULL) AS n_{c}" for c in _INFO) + " FROM raw) " + _cast_union([
        f"""SELECT '{c}' AS "column", n_{c} AS nulls, n AS rows, {' + '.join(f'n_{k}' for k in _INFO)} AS total_nulls,
            lo AS date_start, hi AS date_end FROM t""" for c in _INFO])
ORACLES["quality_report"] = f"WITH {_RAW_DATES} " + _cast_union([
    f"""SELECT c_mktsegment, count(*) AS rows, '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls,
        round(avg({c}), 6) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
        round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis, round(median({c}), 4) AS median,
        any_value(rd.dups) AS duplicates FROM raw JOIN rd USING (c_mktsegment) GROUP BY 1"""
    for c in ("daily_sales", "marketing_spend", "is_holiday")])
ORACLES["quality_check"] = f"WITH {_RAW_DATES} " + _cast_union(
    [f"""SELECT c_mktsegment, 'missing' AS kind, '{c}' AS name, count(*) FILTER ({c} IS NULL) AS count,
         round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4) AS pct FROM raw GROUP BY 1 HAVING count(*) FILTER ({c} IS NULL) > 0"""
     for c in _RAW_COLS]
    + ["SELECT c_mktsegment, 'duplicates', 'rows', dups, NULL FROM rd",
       """SELECT c_mktsegment, 'date_gap', CAST(date AS VARCHAR), CAST(gap AS BIGINT), NULL FROM
          (SELECT c_mktsegment, date, date - lag(date) OVER (PARTITION BY c_mktsegment ORDER BY date) AS gap FROM dc WHERE date IS NOT NULL)
          WHERE gap > 1"""])
ORACLES["upload_check"] = f"""WITH {_RAW}
SELECT count(*) > 0 AS accepted, count(*) AS rows, CAST(0 AS BIGINT) AS bad_dates, CAST(0 AS BIGINT) AS bad_targets,
       min(date) AS date_start, max(date) AS date_end FROM raw"""


def _fill(x: str) -> str:
    return (f"coalesce({x}, last_value({x} IGNORE NULLS) OVER (PARTITION BY c_mktsegment ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({x} IGNORE NULLS) OVER (PARTITION BY c_mktsegment ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


ORACLES["fill_forward_backward"] = _sql(
    _GAPPY, "c_mktsegment, date", {c: _fill(c) for c in ("daily_sales", "marketing_spend")}, "g")
_MODE = """(SELECT c_mktsegment, product_category AS mode FROM
  (SELECT c_mktsegment, product_category, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, product_category) AS r
   FROM {src} WHERE product_category IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"""
ORACLES["fill_mode"] = f"""WITH {_GAPPY}
SELECT c_mktsegment, date, coalesce(product_category, mode) AS product_category FROM g JOIN {_MODE.format(src='g')} USING (c_mktsegment)"""
ORACLES["keep_first_per_date"] = """
SELECT c_mktsegment, date, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM
 (SELECT c_mktsegment, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY c_mktsegment, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS r
  FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r = 1"""
ORACLES["clean_sales"] = f"""WITH {_RAW},
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, date ORDER BY daily_sales NULLS LAST,
        marketing_spend NULLS LAST, is_holiday NULLS LAST, product_category NULLS LAST) AS r FROM raw WHERE date IS NOT NULL) WHERE r = 1)
SELECT c_mktsegment, date, round({_fill('daily_sales')}, 4) AS daily_sales, round({_fill('marketing_spend')}, 6) AS marketing_spend,
       CAST({_fill('is_holiday')} AS BIGINT) AS is_holiday, coalesce(product_category, mode) AS product_category
FROM k LEFT JOIN {_MODE.format(src='k')} USING (c_mktsegment)"""


ORACLES["cleaning_report"] = f"""WITH {_RAW},
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, date ORDER BY daily_sales NULLS LAST,
        marketing_spend NULLS LAST, is_holiday NULLS LAST, product_category NULLS LAST) AS r FROM raw WHERE date IS NOT NULL) WHERE r = 1),
k2 AS (SELECT {_fill('daily_sales')} AS a, {_fill('marketing_spend')} AS b, {_fill('is_holiday')} AS c, coalesce(product_category, mode) AS d
       FROM k LEFT JOIN {_MODE.format(src='k')} USING (c_mktsegment)),
n0 AS (SELECT count(*) AS kept, count(*) * 4 - count(daily_sales) - count(marketing_spend) - count(is_holiday) - count(product_category) AS b FROM k),
n1 AS (SELECT count(*) * 4 - count(a) - count(b) - count(c) - count(d) AS a FROM k2),
nr AS (SELECT count(*) FILTER (date IS NULL) AS undated, count(date) AS dated FROM raw)
SELECT 'renamed_columns' AS operation, CAST(0 AS BIGINT) AS count
UNION ALL SELECT 'rows_without_date', undated FROM nr
UNION ALL SELECT 'duplicate_rows_removed', dated - kept FROM nr, n0
UNION ALL SELECT 'values_filled', n0.b - n1.a FROM n0, n1"""


def _bound(x: str, src: str) -> str:
    return f"(SELECT c_mktsegment, avg({x}) - 2.0 * stddev_samp({x}) AS lo, avg({x}) + 2.0 * stddev_samp({x}) AS hi FROM {src} GROUP BY 1)"


ORACLES["clip_outliers"] = f"""WITH {_PANEL}
SELECT c_mktsegment, date, round(CASE WHEN daily_sales IS NOT NULL THEN least(greatest(daily_sales, a.lo), a.hi) END, 4) AS daily_sales,
       round(CASE WHEN marketing_spend IS NOT NULL THEN least(greatest(marketing_spend, b.lo), b.hi) END, 6) AS marketing_spend, CAST(is_holiday AS BIGINT) AS is_holiday
FROM p JOIN {_bound('daily_sales', 'p')} a USING (c_mktsegment) JOIN {_bound('marketing_spend', 'p')} b USING (c_mktsegment)"""
ORACLES["remove_outliers"] = f"""WITH {_PANEL},
p1 AS (SELECT p.* FROM p JOIN {_bound('daily_sales', 'p')} a USING (c_mktsegment) WHERE NOT coalesce(daily_sales < a.lo OR daily_sales > a.hi, false)),
p2 AS (SELECT p1.* FROM p1 JOIN {_bound('marketing_spend', 'p1')} b USING (c_mktsegment) WHERE NOT coalesce(marketing_spend < b.lo OR marketing_spend > b.hi, false))
SELECT c_mktsegment, date, round(daily_sales, 4) AS daily_sales, round(marketing_spend, 6) AS marketing_spend, CAST(is_holiday AS BIGINT) AS is_holiday FROM p2"""

# --- exploratory statistics ------------------------------------------------------------------

_POS = _PANEL + f""",
x AS (SELECT *, row_number() OVER {_W} - 1 AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM p)"""
_BASIC = {
    "mean": "avg(daily_sales)", "std": "stddev_samp(daily_sales)", "min": "min(daily_sales)", "max": "max(daily_sales)",
    "median": "median(daily_sales)", "q1": "quantile_cont(daily_sales, 0.25)", "q3": "quantile_cont(daily_sales, 0.75)",
    "iqr": "quantile_cont(daily_sales, 0.75) - quantile_cont(daily_sales, 0.25)", "skewness": "skewness(daily_sales)",
    "kurtosis": "kurtosis(daily_sales)", "cv": "stddev_samp(daily_sales) / avg(daily_sales) * 100",
}
_BASIC_KEEP = "count(*) AS count, min(date) AS date_start, max(date) AS date_end, CAST(max(date) - min(date) + 1 AS BIGINT) AS date_range_days"
ORACLES["basic_stats"] = _sql(_PANEL, "c_mktsegment, " + _BASIC_KEEP, _BASIC, "p", 4, "GROUP BY c_mktsegment")
_TREND_KEEP = "count(daily_sales) AS n, CASE WHEN regr_slope(daily_sales, pos) > 0 THEN 'upward' ELSE 'downward' END AS trend_direction"
_H1, _H2 = "avg(daily_sales) FILTER (pos < n // 2)", "avg(daily_sales) FILTER (pos >= n // 2)"
_TREND = {
    "slope": "regr_slope(daily_sales, pos)", "intercept": "regr_intercept(daily_sales, pos)", "r_squared": "regr_r2(daily_sales, pos)",
    "first_half_avg": _H1, "second_half_avg": _H2, "growth_rate_percent": f"({_H2} - {_H1}) / {_H1} * 100",
}
ORACLES["trend"] = _sql(_POS, "c_mktsegment, " + _TREND_KEEP, _TREND, "x", 4, "GROUP BY c_mktsegment")
_TT = _POS + f""",
tq AS (SELECT c_mktsegment, {_TREND_KEEP}, {', '.join(f'{e} AS {k}' for k, e in _TREND.items())} FROM x GROUP BY 1),
ts AS (SELECT *, n - 2 AS nu, sqrt(r_squared * (n - 2) / (1 - r_squared)) AS t FROM tq),
tc AS (SELECT *, exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(nu * pi()) AS c FROM ts),
ti AS (SELECT c_mktsegment, 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
              * c * pow(1 + pow(t * i / 2000, 2) / nu, -(nu + 1) / 2.0)) * any_value(t) / 6000 AS p
       FROM tc CROSS JOIN range(2001) r(i) GROUP BY 1)"""
ORACLES["trend_significance"] = _sql(
    _TT, "c_mktsegment, n, trend_direction", {k: k for k in _TREND} | {"p_value": "p"}, "tq JOIN ti USING (c_mktsegment)", 6)
_LINE = _POS + ", ln AS (SELECT c_mktsegment, regr_slope(daily_sales, pos) AS s, regr_intercept(daily_sales, pos) AS i FROM x GROUP BY 1)"
ORACLES["trend_residuals"] = _sql(
    _LINE, "c_mktsegment, date", {"daily_sales": "daily_sales", "trend": "s * pos + i", "residual": "daily_sales - (s * pos + i)"},
    "x JOIN ln USING (c_mktsegment)", 3)
ORACLES["monthly_averages"] = _sql(
    _PANEL, "c_mktsegment, strftime(date, '%Y-%m') AS month", {"mean": "avg(daily_sales)"}, "p", 6, "GROUP BY 1, 2")
_DOW = _PANEL + """,
days AS (SELECT i, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][i + 1] AS name FROM range(7) t(i)),
ks AS (SELECT DISTINCT c_mktsegment FROM p),
dw AS (SELECT ks.c_mktsegment, i, any_value(name) AS name, coalesce(avg(daily_sales), 0) AS m FROM ks CROSS JOIN days
       LEFT JOIN p ON p.c_mktsegment = ks.c_mktsegment AND isodow(p.date) - 1 = i GROUP BY 1, 2),
ds AS (SELECT c_mktsegment, first(name ORDER BY m DESC, i) AS best_day, first(name ORDER BY m, i) AS worst_day,
              sum(m) FILTER (i >= 5) / 2 AS weekend_avg, sum(m) FILTER (i < 5) / 5 AS weekday_avg FROM dw GROUP BY 1)"""
ORACLES["weekday_profile"] = _sql(_DOW, "c_mktsegment, CAST(i AS BIGINT) AS dow, name AS weekday", {"mean": "m"}, "dw")
ORACLES["weekday_summary"] = _sql(
    _DOW, "c_mktsegment, best_day, worst_day", {"weekend_avg": "weekend_avg", "weekday_avg": "weekday_avg"}, "ds")
ORACLES["month_quarter_profile"] = f"""WITH {_PANEL},
u AS (SELECT c_mktsegment, 'month' AS level, CAST(month(date) AS BIGINT) AS period, avg(daily_sales) AS m FROM p GROUP BY 1, 3
      UNION ALL SELECT c_mktsegment, 'quarter', CAST(quarter(date) AS BIGINT), avg(daily_sales) FROM p GROUP BY 1, 3)
SELECT c_mktsegment, level, period, round(m, 6) AS mean,
       CAST(row_number() OVER (PARTITION BY c_mktsegment, level ORDER BY m DESC, period) = 1 AS BIGINT) AS is_best,
       CAST(row_number() OVER (PARTITION BY c_mktsegment, level ORDER BY m, period) = 1 AS BIGINT) AS is_worst FROM u"""
_ON, _OFF = "avg(daily_sales) FILTER (is_holiday = 1)", "avg(daily_sales) FILTER (is_holiday = 0)"
_HOLIDAY = {"holiday_avg": _ON, "non_holiday_avg": _OFF,
            "holiday_lift_percent": f"CASE WHEN {_OFF} > 0 THEN ({_ON} - {_OFF}) / {_OFF} * 100 ELSE 0 END"}
ORACLES["holiday_effect"] = _sql(_PANEL, "c_mktsegment", _HOLIDAY, "p", 4, "GROUP BY c_mktsegment")
_LAGGED = _POS + ", lg AS (SELECT *, " + ", ".join(f"lag(daily_sales, {k}) OVER {_W} AS l{k}" for k in (1, 7, 14, 30)) + " FROM x)"
_AUTO = {f"lag_{k}": f"CASE WHEN count(*) > {k} THEN corr(daily_sales, l{k}) END" for k in (1, 7, 14, 30)}
ORACLES["autocorrelation"] = _sql(_LAGGED, "c_mktsegment", _AUTO, "lg", 7, "GROUP BY c_mktsegment")
ORACLES["acf_curve"] = f"""WITH {_POS},
c AS (SELECT c_mktsegment, pos, n, daily_sales - avg(daily_sales) OVER (PARTITION BY c_mktsegment) AS d FROM x),
z AS (SELECT c_mktsegment, sum(d * d) AS c0 FROM c GROUP BY 1),
h AS (SELECT a.c_mktsegment, b.pos - a.pos AS lag, sum(a.d * b.d) AS s, any_value(a.n) AS n FROM c a
      JOIN c b ON a.c_mktsegment = b.c_mktsegment AND b.pos BETWEEN a.pos AND a.pos + 60 GROUP BY 1, 2)
SELECT c_mktsegment, lag, round(s / c0, 7) AS acf, round(1.96 / sqrt(n), 7) AS band_95, round(2.576 / sqrt(n), 7) AS band_99
FROM h JOIN z USING (c_mktsegment)"""
_FEAT = _PANEL + f""",
ft AS (SELECT *, isodow(date) - 1 AS day_of_week_num, month(date) AS month, {_lag(1)} AS daily_sales_lag_1,
              {_roll('mean', 7)} AS daily_sales_rolling_mean_7 FROM p)"""
ORACLES["target_correlations"] = f"WITH {_FEAT}, u AS (" + _cast_union([
    f"""SELECT c_mktsegment, '{c}' AS "column", corr(daily_sales, {c}) AS r FROM ft GROUP BY 1"""
    for c in ("marketing_spend", "is_holiday", "day_of_week_num", "month", "daily_sales_lag_1", "daily_sales_rolling_mean_7")
]) + """) SELECT c_mktsegment, "column", round(r, 7) AS correlation,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(r) DESC, "column") AS rank FROM u WHERE r IS NOT NULL AND NOT isnan(r)"""
_CM = ("daily_sales", "marketing_spend", "daily_sales_lag_1", "day_of_week_num")
ORACLES["correlation_matrix"] = f"WITH {_FEAT} " + _cast_union([
    f"SELECT c_mktsegment, '{b}' AS column_a, '{a}' AS column_b, round(corr({a}, {b}), 7) AS correlation FROM ft GROUP BY 1"
    for i, a in enumerate(_CM) for b in _CM[i + 1:]])
_EV = lambda n, end=1: f"(ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND {'1 PRECEDING' if end else 'CURRENT ROW'})"
ORACLES["long_series_windows"] = f"""
SELECT event_id, round(value, 5) AS value, row_number() OVER w - 1 AS pos, round(lag(value, 1) OVER w, 5) AS lag_1,
  round(lag(value, 28) OVER w, 5) AS lag_28, round(value - lag(value, 7) OVER w, 5) AS diff_7,
  round(value / nullif(lag(value, 1) OVER w, 0) - 1, 5) AS pct_1, round(avg(value) OVER {_EV(7)}, 5) AS mean_7,
  round(CASE WHEN count(value) OVER {_EV(28)} = 28 THEN stddev_samp(value) OVER {_EV(28)} END, 5) AS std_28,
  round(max(value) OVER {_EV(14)}, 5) AS max_14,
  round(CASE WHEN count(value) OVER {_EV(6, 0)} = 7 THEN avg(value) OVER {_EV(6, 0)} END, 5) AS ma_7
FROM events WINDOW w AS (ORDER BY ts, event_id)"""
_LAGS = ", ".join(f"lag(daily_sales, {k}) OVER {_W} AS lag_{k}" for k in range(30))
ORACLES["wide_correlation_matrix"] = f"WITH {_PANEL}, x AS MATERIALIZED (SELECT c_mktsegment, {_LAGS} FROM p) " + _cast_union([
    f"SELECT c_mktsegment, 'lag_{b}' AS column_a, 'lag_{a}' AS column_b, round(corr(lag_{a}, lag_{b}), 7) AS correlation FROM x GROUP BY 1"
    for a in range(30) for b in range(a + 1, 30)])
ORACLES["top_correlations"] = f"SELECT * FROM ({ORACLES['target_correlations']}) WHERE rank <= 3"
_GLOBAL_CORR = _cast_union([
    f"SELECT '{c}' AS feature_name, corr(daily_sales, {c}) AS r FROM ft"
    for c in ("marketing_spend", "is_holiday", "day_of_week_num", "daily_sales_lag_1")])
ORACLES["stored_importance"] = f"""WITH {_FEAT}, u AS ({_GLOBAL_CORR})
SELECT 'run-1' AS run_id, 'random_forest' AS model_name, feature_name, round(r, 7) AS importance_score,
       row_number() OVER (ORDER BY abs(r) DESC, feature_name) AS importance_rank FROM u WHERE r IS NOT NULL AND NOT isnan(r)"""
ORACLES["parsed_text_rows"] = f"""WITH {_PANEL}
SELECT c_mktsegment, date, CASE WHEN day(date) <> 13 THEN round(daily_sales, 4) END AS daily_sales,
       CAST(is_holiday AS BIGINT) AS is_holiday FROM p"""
_OUT = _PANEL + """,
oq AS (SELECT c_mktsegment, quantile_cont(daily_sales, 0.25) AS q1, quantile_cont(daily_sales, 0.75) AS q3, avg(daily_sales) AS mu,
              stddev_pop(daily_sales) AS sd FROM p GROUP BY 1),
ob AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM oq),
oc AS (SELECT c_mktsegment, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n,
              count(*) FILTER (daily_sales < lo OR daily_sales > hi) AS io, count(*) FILTER (abs((daily_sales - mu) / nullif(sd, 0)) > 3) AS zo
       FROM p JOIN ob USING (c_mktsegment) GROUP BY 1)"""
_OUT_VALUES = {"lower_bound": "lo", "upper_bound": "hi", "iqr_outlier_percent": "100.0 * io / n", "zscore_outlier_percent": "100.0 * zo / n"}
ORACLES["outlier_counts"] = _sql(_OUT, "c_mktsegment, io AS iqr_outliers, zo AS zscore_outliers", _OUT_VALUES, "oc", 6)
ORACLES["histogram"] = f"""WITH {_PANEL},
b AS (SELECT c_mktsegment, min(daily_sales) AS lo, max(daily_sales) AS hi, avg(daily_sales) AS mu, median(daily_sales) AS md FROM p GROUP BY 1),
h AS (SELECT c_mktsegment, least(coalesce(floor((daily_sales - lo) / nullif((hi - lo) / 30, 0)) + 1, 1), 30) AS bin, count(*) AS c
      FROM p JOIN b USING (c_mktsegment) GROUP BY 1, 2)
SELECT b.c_mktsegment, CAST(i + 1 AS BIGINT) AS bin, round(lo + i * ((hi - lo) / 30), 4) AS bin_start,
       round(lo + (i + 1) * ((hi - lo) / 30), 4) AS bin_end, coalesce(c, 0) AS count, round(mu, 6) AS mean, round(md, 4) AS median
FROM b CROSS JOIN range(30) r(i) LEFT JOIN h ON h.c_mktsegment = b.c_mktsegment AND h.bin = i + 1"""
_BOX = _PANEL + """,
bx AS (SELECT c_mktsegment, date, daily_sales, 'all' AS grouping_, 'all' AS group_ FROM p
       UNION ALL SELECT c_mktsegment, date, daily_sales, 'weekday', dayname(date) FROM p
       UNION ALL SELECT c_mktsegment, date, daily_sales, 'quarter', CAST(quarter(date) AS VARCHAR) FROM p
       UNION ALL SELECT c_mktsegment, date, daily_sales, 'holiday', CAST(is_holiday AS VARCHAR) FROM p),
bq AS (SELECT c_mktsegment, grouping_, group_, quantile_cont(daily_sales, 0.25) AS q1, median(daily_sales) AS md,
              quantile_cont(daily_sales, 0.75) AS q3 FROM bx GROUP BY 1, 2, 3),
bz AS (SELECT *, daily_sales BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM bx JOIN bq USING (c_mktsegment, grouping_, group_))"""
ORACLES["boxplot_stats"] = _sql(
    _BOX, 'c_mktsegment, grouping_ AS "grouping", group_ AS "group", count(*) FILTER (NOT inside) AS fliers',
    {"q1": "any_value(q1)", "median": "any_value(md)", "q3": "any_value(q3)", "whisker_low": "min(daily_sales) FILTER (inside)",
     "whisker_high": "max(daily_sales) FILTER (inside)"}, "bz", 4, "GROUP BY 1, 2, 3")
ORACLES["boxplot_fliers"] = _sql(
    _BOX, 'c_mktsegment, grouping_ AS "grouping", group_ AS "group", date', {"daily_sales": "daily_sales"}, "bz", 4, "WHERE NOT inside")
ORACLES["series_analysis"] = f"""WITH {_DOW}, {_OUT.split(_PANEL)[1].lstrip(',')}, {_LAGGED.split(_PANEL)[1].lstrip(',')},
{_GAPS}, gg AS (SELECT c_mktsegment, count(*) FILTER (gap_days > 1) AS date_gaps FROM dgap GROUP BY 1),
ss AS (SELECT c_mktsegment, {_BASIC_KEEP}, {_TREND_KEEP}, count(*) - count(marketing_spend) > 0 AS spend_null,
  {', '.join(f'round({e}, {_dp(n, 4)}) AS {n}' for n, e in (_BASIC | _TREND | _AUTO | _HOLIDAY).items())} FROM lg GROUP BY 1)
SELECT ss.* EXCLUDE (spend_null), CAST(spend_null AS BIGINT) AS columns_with_nulls, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound,
  io AS iqr_outliers, zo AS zscore_outliers, round(100.0 * io / oc.n, 4) AS iqr_outlier_percent, round(100.0 * zo / oc.n, 4) AS zscore_outlier_percent,
  best_day, worst_day, round(weekend_avg, 6) AS weekend_avg, round(weekday_avg, 6) AS weekday_avg, date_gaps, CAST(0 AS BIGINT) AS duplicates
FROM ss JOIN oc USING (c_mktsegment) JOIN ds USING (c_mktsegment) JOIN gg USING (c_mktsegment)"""



def _poly(region: str, r: str) -> str:
    num, den = ("(" + " + ".join(f"{c!r}::DOUBLE * pow({r}, {i})" for i, c in enumerate(cs)) + ")" for cs in AS241[region])
    return f"{num} / {den}"


_QQ = _PANEL + """,
qr AS (SELECT c_mktsegment, daily_sales AS ordered, row_number() OVER (PARTITION BY c_mktsegment ORDER BY daily_sales, date) AS i,
              count(*) OVER (PARTITION BY c_mktsegment) AS n FROM p),
qm AS (SELECT c_mktsegment, ordered, i, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
              ELSE (i - 0.3175) / (n + 0.365) END AS m FROM qr),
qs AS (SELECT *, m - 0.5 AS q, sqrt(-ln(least(m, 1 - m))) AS r FROM qm),
""" + f"""qt AS (SELECT c_mktsegment, ordered, i, CASE WHEN abs(q) <= 0.425 THEN q * {_poly("central", "(0.180625 - q * q)")}
  ELSE sign(q) * CASE WHEN r <= 5 THEN {_poly("near", "(r - 1.6)")} ELSE {_poly("far", "(r - 5)")} END END AS theoretical FROM qs),
ql AS (SELECT c_mktsegment, regr_slope(ordered, theoretical) AS s, regr_intercept(ordered, theoretical) AS b FROM qt GROUP BY 1)"""
ORACLES["qq_points"] = _sql(
    _QQ, "c_mktsegment, i", {"theoretical": "theoretical", "ordered": "ordered", "line_slope": "s", "line_intercept": "b"},
    "qt JOIN ql USING (c_mktsegment)")
_CORR_PAIRS = ("marketing_spend", "is_holiday")
_REPORT = f"""{_DOW}, {_OUT.split(_PANEL)[1].lstrip(',')}, {_LAGGED.split(_PANEL)[1].lstrip(',')},
{_GAPS}, gg AS (SELECT c_mktsegment, count(*) FILTER (gap_days > 1) AS date_gaps FROM dgap GROUP BY 1),
ss AS (SELECT c_mktsegment, {_BASIC_KEEP}, {_TREND_KEEP}, CAST(count(*) > count(marketing_spend) AS BIGINT) AS null_cols,
  {', '.join(f'{e} AS {n}' for n, e in (_BASIC | _TREND | _AUTO).items())} FROM lg GROUP BY 1),
cr AS (""" + _cast_union([
    f"SELECT c_mktsegment, '{c}' AS col, corr(daily_sales, {c}) AS r FROM p GROUP BY 1" for c in _CORR_PAIRS
]) + """),
tc AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(r) DESC, col) AS k FROM cr WHERE r IS NOT NULL AND NOT isnan(r)),
rp AS (SELECT ss.*, best_day, worst_day, weekend_avg, weekday_avg, date_gaps, io, zo, oc.n AS rows_n, col AS top_col, r AS top_r
       FROM ss JOIN ds USING (c_mktsegment) JOIN gg USING (c_mktsegment) JOIN oc USING (c_mktsegment)
       LEFT JOIN tc ON tc.c_mktsegment = ss.c_mktsegment AND tc.k = 1)"""
ORACLES["key_insights"] = f"""WITH {_REPORT},
rules AS (
  SELECT c_mktsegment, 1 AS o, CASE WHEN r_squared > 0.5 THEN 'Strong ' || trend_direction || ' trend detected (R²=' || printf('%.3f', r_squared) || ')'
         WHEN r_squared > 0.3 THEN 'Moderate ' || trend_direction || ' trend detected (R²=' || printf('%.3f', r_squared) || ')'
         ELSE 'No strong linear trend detected' END AS insight FROM rp
  UNION ALL SELECT c_mktsegment, 2, CASE WHEN abs(growth_rate_percent) > 50
         THEN 'Significant growth: ' || printf('%.1f', growth_rate_percent) || '% from first to second half' END FROM rp
  UNION ALL SELECT c_mktsegment, 3, 'Day-of-week effect: ' || best_day || ' is best, ' || worst_day || ' is worst' FROM rp
  UNION ALL SELECT c_mktsegment, 4, CASE WHEN abs(top_r) > 0.7 THEN 'Strong correlation: ' || top_col || ' (r=' || printf('%.3f', top_r) || ')' END FROM rp
  UNION ALL SELECT c_mktsegment, 5, CASE WHEN lag_1 > 0.5 THEN 'High autocorrelation at lag-1: ' || printf('%.3f', lag_1) || ' (good for time series models)' END FROM rp
  UNION ALL SELECT c_mktsegment, 6, CASE WHEN null_cols > 0 THEN 'Warning: Missing values in ' || null_cols || ' columns' END FROM rp
  UNION ALL SELECT c_mktsegment, 7, CASE WHEN date_gaps > 0 THEN 'Warning: ' || date_gaps || ' date gaps found' END FROM rp)
SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o) AS ord, insight FROM rules WHERE insight IS NOT NULL"""
_MONEY = "'$' || format('{{:,.2f}}', {0})"
_LINES = [
    ("1. BASIC STATISTICS", [
        ("Total Records", "format('{:,}', count)"), ("Date Range", "CAST(date_start AS VARCHAR) || ' to ' || CAST(date_end AS VARCHAR)"),
        ("Mean Sales", _MONEY.format("mean")), ("Std Dev", _MONEY.format("std")), ("Min", _MONEY.format("min")),
        ("Max", _MONEY.format("max")), ("Coefficient of Variation", "printf('%.2f', cv) || '%'")]),
    ("2. TREND ANALYSIS", [
        ("Trend Direction", "upper(trend_direction)"), ("Daily Change", _MONEY.format("slope")),
        ("R-squared", "printf('%.4f', r_squared)"), ("Growth Rate", "printf('%.1f', growth_rate_percent) || '%'")]),
    ("3. SEASONALITY", [
        ("Best Day", "best_day"), ("Worst Day", "worst_day"),
        ("Weekend vs Weekday", "'$' || format('{:,.0f}', weekend_avg) || ' vs $' || format('{:,.0f}', weekday_avg)"),
        ("Lag-1 Autocorrelation", "printf('%.4f', lag_1)"), ("Lag-7 Autocorrelation", "printf('%.4f', lag_7)")]),
    ("5. DATA QUALITY", [
        ("Missing Values", "null_cols || ' columns with missing data'"), ("Duplicates", "'0'"), ("Date Gaps", "CAST(date_gaps AS VARCHAR)")]),
    ("6. OUTLIERS", [
        ("IQR Method", "io || ' outliers (' || printf('%.1f', 100.0 * io / rows_n) || '%)'"),
        ("Z-Score Method", "zo || ' outliers (' || printf('%.1f', 100.0 * zo / rows_n) || '%)'")]),
]
ORACLES["section_report"] = f"WITH {_REPORT} " + _cast_union(
    [f"SELECT c_mktsegment, '{s}' AS section, CAST({i} AS BIGINT) AS ord, '{label}' AS label, {e} AS value FROM rp"
     for s, items in _LINES for i, (label, e) in enumerate(items, 1)]
    + ["SELECT c_mktsegment, '4. TOP CORRELATIONS', k, col, printf('%.4f', r) FROM tc WHERE k <= 5"])

_TIDY = {
    "basic_stats": ("lg", {"count": "count(*)"} | _BASIC | {"date_range_days": "max(date) - min(date) + 1"}),
    "trend": ("lg", _TREND | {"n": "count(daily_sales)"}), "holiday_effect": ("lg", _HOLIDAY), "autocorrelation": ("lg", _AUTO),
    "outliers": ("oc", {"lower_bound": "any_value(lo)", "upper_bound": "any_value(hi)", "iqr_outliers": "any_value(io)",
                        "iqr_outlier_percent": "any_value(100.0 * io / oc.n)", "zscore_outliers": "any_value(zo)",
                        "zscore_outlier_percent": "any_value(100.0 * zo / oc.n)"}),
}
ORACLES["tidy_analysis"] = f"WITH {_LAGGED}, {_OUT.split(_PANEL)[1].lstrip(',')} " + _cast_union([
    f"SELECT c_mktsegment, '{section}' AS section, '{k}' AS key, round(CAST({e} AS DOUBLE), 5) AS value FROM {src} GROUP BY 1"
    for section, (src, values) in _TIDY.items() for k, e in values.items()])

# --- splits and metrics ----------------------------------------------------------------------

_INFO_COLS = """min(date) FILTER (role = 'train') AS train_start, max(date) FILTER (role = 'train') AS train_end,
  min(date) FILTER (role = 'test') AS test_start, max(date) FILTER (role = 'test') AS test_end,
  count(*) FILTER (role = 'train') AS train_size, count(*) FILTER (role = 'test') AS test_size"""
ORACLES["simple_split"] = f"""WITH {_POS},
s AS (SELECT c_mktsegment, date, CASE WHEN pos < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS role FROM x)
SELECT c_mktsegment, CAST(0 AS BIGINT) AS fold, {_INFO_COLS} FROM s GROUP BY 1"""
_WF = _POS + """,
w AS (SELECT c_mktsegment, date, CAST(f AS BIGINT) AS fold, CASE WHEN pos < te THEN 'train' WHEN pos < least(te + sz, n) THEN 'test' END AS role
      FROM (SELECT x.*, f, n // 2 + f * ((n - n // 2) // 5) AS te, (n - n // 2) // 5 AS sz FROM x CROSS JOIN range(5) r(f))
      WHERE least(te + sz, n) > te),
wf AS (SELECT * FROM w WHERE role IS NOT NULL)"""
ORACLES["walk_forward_split"] = f"WITH {_WF} SELECT c_mktsegment, fold, {_INFO_COLS} FROM wf GROUP BY 1, 2"
ORACLES["walk_forward_rows"] = f"WITH {_WF} SELECT c_mktsegment, date, fold, role FROM wf"
ORACLES["sliding_window_split"] = f"""WITH {_POS},
s AS (SELECT c_mktsegment, date, CAST(f AS BIGINT) AS fold, CASE WHEN pos >= st AND pos < te THEN 'train' WHEN pos >= te AND pos < least(te + sz, n) THEN 'test' END AS role
      FROM (SELECT x.*, f, f * ((n - n // 2) // 5) AS st, f * ((n - n // 2) // 5) + n // 2 AS te, (n - n // 2) // 5 AS sz FROM x CROSS JOIN range(5) r(f))
      WHERE least(te + sz, n) > te AND te <= n)
SELECT c_mktsegment, fold, {_INFO_COLS} FROM s WHERE role IS NOT NULL GROUP BY 1, 2"""
_ERR = "(actual - predicted)"
_METRICS = {
    "mae": f"avg(abs({_ERR}))", "mse": f"avg({_ERR} * {_ERR})", "rmse": f"sqrt(avg({_ERR} * {_ERR}))",
    "mape": f"coalesce(avg(abs({_ERR} / actual)) FILTER (abs(actual) > 1e-10) * 100, CAST('inf' AS DOUBLE))",
    "smape": f"avg(abs({_ERR}) / greatest((abs(actual) + abs(predicted)) / 2, 1e-10)) * 100",
    "r2": f"1 - sum({_ERR} * {_ERR}) / (var_pop(actual) * count(*) + 1e-10)",
    "explained_var": f"1 - var_pop({_ERR}) / (var_pop(actual) + 1e-10)", "max_error": f"max(abs({_ERR}))",
}
ORACLES["regression_metrics"] = _sql(_NAIVE, "c_mktsegment, model_name, count(*) AS n", _METRICS, "n", 3, "GROUP BY 1, 2")
_TM = {
    "mape": "avg(abs(actual - greatest(predicted, 0)) / greatest(abs(actual), 2.220446049250313e-16)) * 100",
    "mae": "avg(abs(actual - greatest(predicted, 0)))", "rmse": "sqrt(avg(pow(actual - greatest(predicted, 0), 2)))",
}
ORACLES["trainer_metrics"] = _sql(_NAIVE, "c_mktsegment, model_name", _TM, "n", 3, "GROUP BY 1, 2")
_NFOLD = _NAIVE + f""",
nx AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, model_name ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY c_mktsegment, model_name) AS cnt FROM n),
nf AS (SELECT * FROM (SELECT nx.*, f, cnt // 2 + f * ((cnt - cnt // 2) // 5) AS te, (cnt - cnt // 2) // 5 AS sz FROM nx CROSS JOIN range(5) r(f))
       WHERE pos >= te AND pos < least(te + sz, cnt)),
nm AS (SELECT c_mktsegment, model_name, f, {', '.join(f'{e} AS {k}' for k, e in _METRICS.items())} FROM nf GROUP BY 1, 2, 3)"""
ORACLES["fold_metrics"] = f"WITH {_NFOLD} " + _cast_union([
    f"""SELECT c_mktsegment, model_name, '{m}' AS metric, round(avg({m}), 2) AS mean, round(stddev_pop({m}), 2) AS std,
        round(min({m}), 2) AS min, round(max({m}), 2) AS max FROM nm GROUP BY 1, 2""" for m in _METRICS])
_TMC = _NAIVE + ", tm AS (SELECT c_mktsegment, model_name, " + ", ".join(
    f"{e} AS {'test_mape' if k == 'mape' else k}" for k, e in _TM.items()) + """ FROM n GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY test_mape, model_name) AS rank FROM tm)"""
_TV = {"test_mape": "test_mape", "mae": "mae", "rmse": "rmse"}
ORACLES["rank_models"] = _sql(_TMC, "c_mktsegment, model_name, rank", _TV, "rk", 3)
ORACLES["best_model"] = _sql(_TMC, "c_mktsegment, model_name", _TV, "rk", 3, "WHERE rank = 1")
ORACLES["target_check"] = _sql(
    _TMC, "c_mktsegment, CAST(min(test_mape) <= 20 AS BIGINT) AS target_met", {"best": "min(test_mape)"}, "tm", 3, "GROUP BY c_mktsegment")

# --- paging, latest, events ------------------------------------------------------------------

ORACLES["history_page"] = f"""WITH {_PANEL}, k AS (SELECT * FROM p WHERE date >= DATE '1996-01-01')
SELECT c_mktsegment, date, round(daily_sales, 4) AS daily_sales, (SELECT count(*) FROM k) AS total FROM k
ORDER BY date, c_mktsegment LIMIT 50 OFFSET 100"""
ORACLES["last_rows_per_series"] = f"""WITH {_PANEL}
SELECT c_mktsegment, date, round(daily_sales, 4) AS daily_sales FROM p
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY date DESC) <= 42"""
ORACLES["latest_event_per_user"] = """
SELECT event_id, ts, user_id, event_type, round(value, 4) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
ORACLES["sessionize"] = """
WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
SELECT user_id, CAST(s AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS last_event,
       count(*) AS n_events, round(sum(value), 2) AS total_value FROM b GROUP BY 1, 2"""
ORACLES["last_events_per_user"] = """
SELECT event_id, ts, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10"""
ORACLES["user_liveness"] = """
SELECT user_id, last_seen, round(epoch_us(m - last_seen) / 1e6, 6) AS idle_seconds,
       CAST(epoch_us(m - last_seen) <= 3600000000 AS BIGINT) AS is_active, CAST(epoch_us(m - last_seen) > 300000000 AS BIGINT) AS is_stale
FROM (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1), (SELECT max(ts) AS m FROM events)"""
_SEV = """CASE WHEN upper({0}) LIKE '%ERROR%' OR upper({0}) LIKE '%FAIL%' THEN 'error' WHEN upper({0}) LIKE '%WARN%' THEN 'warning'
  WHEN upper({0}) LIKE '%SUCCESS%' OR upper({0}) LIKE '%COMPLETE%' THEN 'success' ELSE 'info' END"""
ORACLES["log_severity"] = f"""
SELECT CAST(ts AS DATE) AS date, {_SEV.format("(event_type || ' ' || props)")} AS severity, count(*) AS lines FROM events GROUP BY 1, 2"""
ORACLES["document_severity"] = f"SELECT source, {_SEV.format('text')} AS severity, count(*) AS lines FROM documents GROUP BY 1, 2"

# --- models and forecasts --------------------------------------------------------------------

_M10 = {f"lag_{k}": _lag(k) for k in (1, 7, 14, 28)}
for _s in ("mean", "std"):
    _M10 |= {f"rolling_{_s}_{n}": f"CASE WHEN count(daily_sales) OVER {_frame(n)} = {n} THEN {_roll(_s, n)} END" for n in (7, 14)}
_M10 |= {"day_of_week": "CAST(isodow(date) - 1 AS DOUBLE)", "month": "CAST(month(date) AS DOUBLE)",
         "day_of_year": "CAST(dayofyear(date) AS DOUBLE)", "day_num": f"CAST(row_number() OVER {_W} - 1 AS DOUBLE)"}
ORACLES["lag_feature_matrix"] = _sql(_PANEL, "c_mktsegment, date", {"daily_sales": "daily_sales"} | _M10, "p")
ORACLES["robust_sigma"] = f"""WITH {_NAIVE},
md AS (SELECT c_mktsegment, model_name, median(actual - predicted) AS m FROM n GROUP BY 1, 2)
SELECT c_mktsegment, model_name, round(1.4826 * median(abs(actual - predicted - m)), 2) AS residual_std
FROM n JOIN md USING (c_mktsegment, model_name) GROUP BY 1, 2"""
_FUTURE = "(SELECT c_mktsegment, max(date) AS last_date FROM p GROUP BY 1) CROSS JOIN range(1, {0}) r(i)"
ORACLES["future_calendar"] = f"""WITH {_PANEL}
SELECT c_mktsegment, last_date, CAST(last_date + CAST(i AS INT) AS DATE) AS date, i AS day_number FROM {_FUTURE.format(366)}"""

_DAYS = f"{_PANEL}, e AS (SELECT c_mktsegment, max(date) AS last FROM p GROUP BY 1)"
ORACLES["forecast_contract"] = f"""WITH {_DAYS}
SELECT c_mktsegment, model, CAST(30 AS BIGINT) AS n_days, CAST(last + 1 AS DATE) AS first_date, CAST(last + 30 AS DATE) AS last_date,
       CAST(30 AS BIGINT) AS day_numbers, CAST(30 AS BIGINT) AS n_bounded, CAST(30 AS BIGINT) AS n_non_negative
FROM e CROSS JOIN (VALUES ('linear_trend'), ('boosted_trees'), ('random_forest'), ('decomposable'), ('seasonal_arima')) AS m(model)"""
ORACLES["forecast_after_newer_data"] = f"""WITH {_DAYS},
x AS (SELECT c_mktsegment, date, daily_sales, row_number() OVER {_W} - 1 AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM p),
f AS (SELECT c_mktsegment, regr_slope(daily_sales, pos) AS slope, regr_intercept(daily_sales, pos) AS start, max(pos) AS pos, max(date) AS last_fit
      FROM x WHERE pos < floor(n * CAST(0.8 AS DOUBLE)) GROUP BY 1)
SELECT c_mktsegment, 'linear_trend' AS model, CAST(last + CAST(i AS INT) AS DATE) AS date, i AS day_number,
       round(greatest(0, start + slope * (pos + datediff('day', last_fit, last) + i)), 2) AS predicted
FROM e JOIN f USING (c_mktsegment) CROSS JOIN range(1, 31) AS r(i)"""

_Z = "1.959963984540054"


def _linear_ctes(name: str, weekday: bool) -> str:
    """Least squares on the position; with weekday effects as the common slope within weekdays."""
    if weekday:
        parts = f"""
{name}_g AS (SELECT c_mktsegment, isodow(date) AS dow, count(*) AS c, sum(pos) AS t, sum(daily_sales) AS y, sum(pos * pos) AS tt,
                    sum(pos * daily_sales) AS ty FROM x GROUP BY 1, 2),
{name}_s AS (SELECT c_mktsegment, sum(ty - t * y / c) / sum(tt - CAST(t AS DOUBLE) * t / c) AS slope FROM {name}_g GROUP BY 1),
{name}_c AS (SELECT c_mktsegment, dow, slope, y / c - slope * t / c AS icpt FROM {name}_g JOIN {name}_s USING (c_mktsegment)),"""
    else:
        parts = f"""
{name}_r AS (SELECT c_mktsegment, regr_slope(daily_sales, pos) AS slope, regr_intercept(daily_sales, pos) AS icpt FROM x GROUP BY 1),
{name}_c AS (SELECT c_mktsegment, d AS dow, slope, icpt FROM {name}_r CROSS JOIN range(1, 8) w(d)),"""
    return "," + parts + f"""
{name}_e AS (SELECT x.c_mktsegment, date, daily_sales AS actual, icpt + slope * pos AS predicted, daily_sales - (icpt + slope * pos) AS r
             FROM x JOIN {name}_c c ON c.c_mktsegment = x.c_mktsegment AND c.dow = isodow(x.date)),
{name}_m AS (SELECT c_mktsegment, median(r) AS m FROM {name}_e GROUP BY 1),
{name}_d AS (SELECT c_mktsegment, 1.4826 * median(abs(r - m)) AS sd FROM {name}_e JOIN {name}_m USING (c_mktsegment) GROUP BY 1),
{name}_n AS (SELECT c_mktsegment, count(*) AS n, max(date) AS last_date FROM x GROUP BY 1),
{name}_f AS (SELECT q.c_mktsegment, CAST(last_date + CAST(i AS INT) AS DATE) AS date, i AS day_number, greatest(icpt + slope * (n + i - 1), 0) AS predicted, sd
             FROM {name}_n q CROSS JOIN range(1, 31) r(i) JOIN {name}_c c ON c.c_mktsegment = q.c_mktsegment AND c.dow = isodow(last_date + CAST(i AS INT))
             JOIN {name}_d d ON d.c_mktsegment = q.c_mktsegment),
{name} AS (SELECT c_mktsegment, date, day_number, predicted, greatest(predicted - {_Z} * sd, 0) AS lower_bound, predicted + {_Z} * sd AS upper_bound FROM {name}_f)"""


_FC = {c: c for c in ("predicted", "lower_bound", "upper_bound")}
_PLAIN, _WEEKDAY = _POS + _linear_ctes("f0", False), _POS + _linear_ctes("f1", True)
_BOTH = _POS + _linear_ctes("f0", False) + _linear_ctes("f1", True) + """,
bf AS (SELECT *, 'plain' AS model FROM f0 UNION ALL SELECT *, 'weekday' AS model FROM f1)"""
ORACLES["linear_trend_forecast"] = _sql(_PLAIN, "c_mktsegment, date, day_number, 'linear_trend' AS model", _FC, "f0", 2)
ORACLES["linear_weekday_forecast"] = _sql(_WEEKDAY, "c_mktsegment, date, day_number, 'linear_trend' AS model", _FC, "f1", 2)
_PREVIOUS = """(SELECT *, lag(daily_sales) OVER (PARTITION BY c_mktsegment ORDER BY date) AS before,
               lag(daily_sales, 7) OVER (PARTITION BY c_mktsegment ORDER BY date) AS week_before,
               count(*) OVER (PARTITION BY c_mktsegment) - pos AS back FROM x)"""
ORACLES["arima_closed_forms"] = f"""WITH {_POS},
z AS (SELECT *, daily_sales - before AS step, daily_sales - week_before AS week_step FROM {_PREVIOUS}),
f AS (SELECT c_mktsegment, max(date) AS last_date, arg_max(daily_sales, date) AS y, regr_slope(daily_sales, before) AS a,
             regr_intercept(daily_sales, before) AS c, avg(step) AS drift,
             sqrt((regr_syy(daily_sales, before) - regr_sxy(daily_sales, before) * regr_sxy(daily_sales, before) / regr_sxx(daily_sales, before))
                  / (regr_count(daily_sales, before) - 2)) AS sd_a,
             sqrt(var_pop(step) * count(step) / (count(step) - 1)) AS sd_d, sqrt(avg(week_step * week_step)) AS sd_w FROM z GROUP BY 1),
h AS (SELECT f.*, i, z.daily_sales AS same_weekday FROM f CROSS JOIN range(1, 31) r(i)
      JOIN z ON z.c_mktsegment = f.c_mktsegment AND z.back = 7 - (i - 1) % 7),
m AS (SELECT c_mktsegment, last_date, i, 'autoregression' AS model, c / (1 - a) + pow(a, i) * (y - c / (1 - a)) AS v,
             sd_a * sqrt((1 - pow(a, 2 * i)) / (1 - a * a)) AS se FROM h
      UNION ALL SELECT c_mktsegment, last_date, i, 'drift', y + i * drift, sd_d * sqrt(i) FROM h
      UNION ALL SELECT c_mktsegment, last_date, i, 'last_week', same_weekday, sd_w * sqrt((i - 1) // 7 + 1) FROM h)
SELECT c_mktsegment, model, CAST(last_date + CAST(i AS INT) AS DATE) AS date, i AS day_number, round(greatest(v, 0), 2) AS predicted,
       round(greatest(v - {_Z} * se, 0), 2) AS lower_bound, round(greatest(v + {_Z} * se, 0), 2) AS upper_bound FROM m"""

# Ridge on scaled columns in closed form: the weekday columns have a diagonal Gram matrix less one outer product, which one
# rank-one update inverts; the trend is then one Schur complement. Without a penalty it is the common slope within weekdays.
_TRIALS = ", ".join(
    f"({i}, {c['include_dow']}, CAST({c['regularization']!r} AS DOUBLE), '{json.dumps(c)}')"
    for i, c in enumerate(sample_params(resolve("linear_trend"), 10)))
ORACLES["linear_search"] = f"""WITH {_POS},
k AS (SELECT c_mktsegment, any_value(n) // 2 AS least, (any_value(n) - any_value(n) // 2) // 3 AS size FROM x GROUP BY 1),
fo AS (SELECT c_mktsegment, f, least + f * size AS cut, size FROM k CROSS JOIN range(3) r(f) WHERE size > 0),
tr AS (SELECT c_mktsegment, f, cut, date, isodow(date) AS dow, CAST(pos AS DOUBLE) AS t, daily_sales AS y FROM x JOIN fo USING (c_mktsegment) WHERE pos < cut),
m AS (SELECT c_mktsegment, f, count(*) AS n, avg(t) AS mt, avg(y) AS my, var_pop(t) AS vt, covar_pop(t, y) AS cty, max(date) AS last FROM tr GROUP BY 1, 2),
d AS (SELECT c_mktsegment, f, dow, count(*) / n AS s, sum(t - mt) / n AS ct, sum(y - my) / n AS cy
      FROM tr JOIN m USING (c_mktsegment, f) GROUP BY 1, 2, 3, n),
c(trial, by_dow, alpha, params) AS (VALUES {_TRIALS}),
g AS (SELECT c_mktsegment, f, trial, dow, by_dow, alpha, n, mt, my, vt, cty, s, ct, cy, alpha / n AS w,
             CASE WHEN alpha > 0 THEN 1 / (1 - s) + alpha / n END AS a, sqrt(s * (1 - s)) AS sd, sqrt(s / (1 - s)) AS u
      FROM m JOIN d USING (c_mktsegment, f) CROSS JOIN c),
q AS (SELECT *, ct / (sd * sqrt(vt)) AS gt, cy / sd AS gy FROM g),
t AS (SELECT c_mktsegment, f, trial, any_value(by_dow) AS by_dow, any_value(alpha) AS alpha, any_value(w) AS w, any_value(vt) AS vt,
             any_value(cty) AS cty, 1 - sum(u * u / a) AS z, sum(u * gt / a) AS pt, sum(u * gy / a) AS py, sum(gt * gt / a) AS tt,
             sum(gt * gy / a) AS ty, sum(ct * cy / s) AS wy, sum(ct * ct / s) AS wt FROM q GROUP BY 1, 2, 3),
b AS (SELECT *, CASE WHEN NOT by_dow THEN cty / vt / (1 + w) WHEN alpha = 0 THEN (cty - wy) / (vt - wt)
                ELSE (cty / sqrt(vt) - ty - pt * py / z) / (1 + w - tt - pt * pt / z) / sqrt(vt) END AS slope FROM t),
e AS (SELECT q.*, slope, CASE WHEN NOT q.by_dow THEN 0 WHEN q.alpha = 0 THEN cy / s - slope * ct / s
                ELSE ((gy - gt * slope * sqrt(q.vt)) / a + u / a * (py - pt * slope * sqrt(q.vt)) / z) / sd END AS effect
      FROM q JOIN b USING (c_mktsegment, f, trial)),
o AS (SELECT c_mktsegment, f, trial, sum(s * effect) AS middle FROM e GROUP BY 1, 2, 3),
v AS (SELECT c_mktsegment, f, trial, daily_sales AS y, greatest(e.my + slope * (e.n + (x.date - last) - 1 - e.mt) + effect - middle, 0) AS predicted
      FROM x JOIN fo USING (c_mktsegment) JOIN m USING (c_mktsegment, f) JOIN e USING (c_mktsegment, f) JOIN o USING (c_mktsegment, f, trial)
      WHERE x.pos >= cut AND x.pos < cut + size AND e.dow = isodow(x.date)),
r AS (SELECT c_mktsegment, f, trial, 100 * avg(abs((y - predicted) / y)) FILTER (y <> 0) AS mape FROM v GROUP BY 1, 2, 3),
sc AS (SELECT c_mktsegment, trial, avg(mape) AS mape FROM r GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY mape, trial) AS place FROM sc)
SELECT c_mktsegment, CAST(trial AS BIGINT) AS trial, round(mape, 3) AS mape, params FROM best JOIN c USING (trial) WHERE place = 1"""
ORACLES["linear_in_sample"] = _sql(_WEEKDAY, "c_mktsegment, date", {"actual": "actual", "predicted": "predicted"}, "f1_e", 2)
ORACLES["ensemble_forecast"] = _sql(
    _BOTH, "c_mktsegment, f0.date, f0.day_number, 'ensemble' AS model", {c: f"0.75 * f0.{c} + 0.25 * f1.{c}" for c in _FC},
    "f0 JOIN f1 USING (c_mktsegment, date)", 2)
ORACLES["compare_forecasts"] = _sql(
    _BOTH, "c_mktsegment, date",
    {n + s: f"{f}.{c}" for n, f in (("plain", "f0"), ("weekday", "f1"))
     for s, c in (("", "predicted"), ("_lower", "lower_bound"), ("_upper", "upper_bound"))},
    "f0 JOIN f1 USING (c_mktsegment, date)", 2)
ORACLES["pivot_forecasts"] = _sql(
    _BOTH, "c_mktsegment, date", {"plain": "f0.predicted", "weekday": "f1.predicted"}, "f0 JOIN f1 USING (c_mktsegment, date)", 2)
ORACLES["forecast_summary"] = _sql(
    _BOTH, "c_mktsegment, model, count(*) AS n_days",
    {"total": "sum(predicted)", "mean": "avg(predicted)", "min": "min(predicted)", "max": "max(predicted)",
     "ci_mean_width": "avg(upper_bound - lower_bound)"}, "bf", 2, "GROUP BY 1, 2")
ORACLES["forecast_table"] = _sql(
    _BOTH, "c_mktsegment, model, date, substr(dayname(date), 1, 3) AS weekday",
    {"predicted": "predicted", "percent_of_mean": "predicted / avg(predicted) OVER (PARTITION BY c_mktsegment, model) * 100",
     "ci_range": "upper_bound - lower_bound"}, "bf", 2)
ORACLES["forecast_export"] = _sql(
    _WEEKDAY, "strftime(date, '%Y-%m-%d') AS date, substr(dayname(date), 1, 3) AS weekday, printf('%.2f', predicted) AS value", {}, "f1")
ORACLES["history_and_forecast"] = f"""WITH {_WEEKDAY},
h AS (SELECT c_mktsegment, date, daily_sales, row_number() OVER (PARTITION BY c_mktsegment ORDER BY date DESC) AS r FROM p)
SELECT c_mktsegment, date, round(daily_sales, 2) AS value, 'history' AS kind FROM h WHERE r <= 60
UNION ALL SELECT c_mktsegment, date, round(daily_sales, 2), 'anchor' FROM h WHERE r = 1
UNION ALL SELECT c_mktsegment, date, round(predicted, 2), 'forecast' FROM f1"""

# --- results store ---------------------------------------------------------------------------

_RUN_ID = "c_mktsegment || '-' || model_name AS run_id"
ORACLES["stored_runs"] = _sql(_TMC, f"c_mktsegment, model_name, {_RUN_ID}", {"test_mape": "test_mape", "test_mae": "mae"}, "tm", 3)
ORACLES["stored_best_model"] = _sql(_TMC, "c_mktsegment, model_name", {"test_mape": "test_mape"}, "rk", 3, "WHERE rank = 1")
ORACLES["stored_metrics_table"] = _sql(
    _TMC, "c_mktsegment, model_name, model_name AS param, CAST(min(test_mape) OVER (PARTITION BY c_mktsegment) <= 20 AS BIGINT) AS target_met",
    {"test_mape": "test_mape"}, "tm", 3)
ORACLES["models_with_latest_run"] = _sql(
    _TMC, "c_mktsegment, k AS model_name", {"test_mape": "test_mape"},
    "(VALUES ('naive_1'), ('naive_7'), ('absent')) ks(k) LEFT JOIN tm ON model_name = k", 3)
ORACLES["stored_comparison"] = _sql(
    _TMC, "c_mktsegment, model_name, rank, 'c1' AS comparison_id", {"test_mape": "test_mape"}, "rk", 3)
ORACLES["stored_forecast_summary"] = _sql(
    _BOTH, "c_mktsegment, 'f1' AS forecast_id, model AS model_name, max(day_number) AS n_days, min(date) AS start, max(date) AS end",
    {"total": "sum(predicted)", "mean": "avg(predicted)", "min": "min(predicted)", "max": "max(predicted)", "std": "stddev_pop(predicted)"},
    "bf", 2, "GROUP BY c_mktsegment, model")
ORACLES["stored_forecast_comparison"] = ORACLES["pivot_forecasts"]
ORACLES["forecast_ids_newest_first"] = "SELECT user_id AS forecast_id, max(ts) AS created_at FROM events GROUP BY 1"
ORACLES["flattened_insights"] = f"""WITH {_PANEL},
a AS (SELECT c_mktsegment, count(*) AS days, min(date) AS first, sum(is_holiday) AS hol FROM p GROUP BY 1)
SELECT c_mktsegment, 'span' AS insight_type, 'days' AS insight_key, CAST(days AS VARCHAR) AS insight_value FROM a
UNION ALL SELECT c_mktsegment, 'span', 'first', '"' || strftime(first, '%Y-%m-%d') || '"' FROM a
UNION ALL SELECT c_mktsegment, 'flags', 'holidays', CAST(hol AS VARCHAR) FROM a
UNION ALL SELECT c_mktsegment, 'flags', 'gaps', 'null' FROM a
UNION ALL SELECT c_mktsegment, 'category', 'value', '"' || c_mktsegment || '"' FROM a"""
ORACLES["zipped_learning_curve"] = _sql(
    _PANEL, "c_mktsegment, CAST(month(date) AS BIGINT) AS iteration",
    {"train_loss": "avg(daily_sales)", "val_loss": "CASE WHEN month(date) <= 6 THEN avg(daily_sales) END"}, "p", 6,
    "GROUP BY c_mktsegment, month(date)")
ORACLES["stripped_parameter_names"] = "SELECT p_partkey, lower(p_brand) AS param FROM part"
ORACLES["import_and_reload"] = ORACLES["daily_panel_by_segment"]

ORACLES["actual_and_predicted"] = f"""WITH {_POS},
f AS (SELECT c_mktsegment, regr_slope(daily_sales, pos) AS slope, regr_intercept(daily_sales, pos) AS start, max(pos) AS last_pos, max(date) AS last_fit
      FROM x WHERE pos < floor(n * CAST(0.8 AS DOUBLE)) GROUP BY 1)
SELECT c_mktsegment, date, round(daily_sales, 2) AS actual,
       round(greatest(0, start + slope * (last_pos + datediff('day', last_fit, date))), 2) AS predicted
FROM x JOIN f USING (c_mktsegment) WHERE pos >= floor(n * CAST(0.8 AS DOUBLE))"""
ORACLES["refitted_model_forecast"] = ORACLES["reloaded_model_forecast"] = ORACLES["forecast_file"] = ORACLES["linear_weekday_forecast"]
ORACLES["ensemble_request"] = _sql(_WEEKDAY, "c_mktsegment, date, day_number, 'ensemble' AS model", _FC, "f1", 2)
ORACLES["best_model_forecast"] = f"""WITH {_WEEKDAY}
SELECT c_mktsegment, CASE WHEN length(c_mktsegment) % 2 = 0 THEN 'linear_trend' ELSE 'seasonal_arima' END AS model, date, day_number,
       CASE WHEN length(c_mktsegment) % 2 = 0 THEN round(predicted, 2) END AS predicted FROM f1"""
ORACLES["upload_findings"] = """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS c FROM orders GROUP BY 1),
g AS (SELECT c, date - lag(date) OVER (ORDER BY date) AS gap FROM d),
n AS (SELECT count(*) FILTER (gap > 1) AS gaps, CAST(sum(c - 1) AS BIGINT) AS dups FROM g),
r AS (SELECT CAST(sum(c - 1) AS BIGINT) AS dups FROM (SELECT count(*) AS c FROM orders GROUP BY CAST(o_orderdate AS DATE), o_totalprice, o_orderstatus, o_orderpriority)),
f AS (
  SELECT 'schema' AS "check", 'error' AS severity, c AS "column", 1::BIGINT AS count, 'Missing required columns: ' || c AS message
  FROM (VALUES ('marketing_spend'), ('day_of_week'), ('is_holiday')) m(c)
  UNION ALL SELECT 'schema', 'warning', 'priority', 1, 'Unexpected columns found: priority'
  UNION ALL SELECT 'type', 'warning', 'date', 1, 'Column ''date'' is not datetime type'
  UNION ALL SELECT 'type', 'error', 'daily_sales', 1, 'Column ''daily_sales'' should be numeric but is string'
  UNION ALL SELECT 'date_gaps', 'warning', 'date', gaps, 'Found ' || gaps || ' date gaps in the data' FROM n WHERE gaps > 0
  UNION ALL SELECT 'duplicate_dates', 'error', 'date', dups, 'Found ' || dups || ' duplicate dates' FROM n WHERE dups > 0
  UNION ALL SELECT 'duplicate_rows', 'warning', NULL, dups, 'Found ' || dups || ' duplicate rows' FROM r WHERE dups > 0)
SELECT *, CAST(NULL AS DOUBLE) AS pct FROM f"""
ORACLES["dispatched_sources"] = f"""WITH {_PANEL}
SELECT source, count(*) AS n, min(date) AS start, max(date) AS end, round(sum(daily_sales), 2) AS total
FROM p CROSS JOIN (VALUES ('parquet'), ('orc'), ('json'), ('csv'), ('raw')) s(source)
WHERE source = 'raw' OR date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1"""
_NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _RAW_COLS)
ORACLES["report_and_run_files"] = f"""WITH {_RAW}, {_TMC.lstrip()},
k AS (SELECT * FROM raw WHERE date IS NOT NULL),
t AS (SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM k) AS b, (SELECT {_NULLS} FROM raw) AS v, (SELECT {_NULLS} FROM k) AS w)
SELECT fact, round(CAST(value AS DOUBLE), 3) AS value FROM (
  SELECT 'initial_rows' AS fact, a::DOUBLE AS value FROM t UNION ALL SELECT 'final_rows', b FROM t UNION ALL SELECT 'rows_removed', a - b FROM t
  UNION ALL SELECT 'validation', v FROM t UNION ALL SELECT 'features', w FROM t UNION ALL SELECT 'test_mape', sum(test_mape) FROM tm)"""
_MINIMAL = sorted((
    "daily_sales_diff_1", "daily_sales_lag_1", "daily_sales_lag_7", "daily_sales_rolling_mean_7", "daily_sales_rolling_std_7", "day_of_week_cos",
    "day_of_week_num", "day_of_week_sin", "day_of_year", "days_since_start", "is_holiday", "is_weekend", "marketing_spend",
    "marketing_spend_rolling_mean_7", "month", "quarter", "time_normalized"))
ORACLES["features_and_target"] = _sql(
    _PANEL, f"'{','.join(_MINIMAL)}' AS names, count(*) AS n", {"spend": "sum(marketing_spend)", "target": "sum(daily_sales)"}, "p", 2, "")
ORACLES["stored_insights"] = ORACLES["flattened_insights"]
ORACLES["stored_learning_curve"] = _sql(
    _PANEL, "'r1' AS run_id, 'boosted_trees' AS model_name, month(date) AS iteration, 'rmse' AS metric_type",
    {"train_loss": "avg(daily_sales)", "val_loss": "stddev_samp(daily_sales)"}, "p", 4, "GROUP BY month(date)")

# --- streams ---------------------------------------------------------------------------------

ORACLES["streamed_sessions"] = """
WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a),
c AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n_events,
             round(sum(value), 2) AS total_value FROM b GROUP BY user_id, s)
SELECT user_id, session_start, session_end, n_events, total_value
FROM c WHERE session_end <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY"""
ORACLES["streamed_severity"] = f"""
SELECT d AS window_start, severity, count(*) AS lines
FROM (SELECT date_trunc('day', ts) AS d, {_SEV.format("(event_type || ' ' || props)")} AS severity FROM events)
WHERE d + INTERVAL 1 DAY <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY GROUP BY 1, 2"""
ORACLES["streamed_last_events"] = """
SELECT event_id, ts, user_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10"""
ORACLES["streamed_silences"] = """
WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events)
SELECT user_id, status, ts AS last_seen, ts + span AS at
FROM g CROSS JOIN (VALUES ('stale', INTERVAL 5 MINUTE), ('expired', INTERVAL 1 HOUR)) s(status, span)
WHERE (following IS NULL OR following > ts + span)
  AND ts + span <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY"""
ORACLES["csv_intake"] = ORACLES["daily_panel_by_segment"]
