"""Rolling transactional tables up to one row per series and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (month, day) pairs treated as holidays.
HOLIDAYS = ((1, 1), (7, 4), (12, 25))


def holiday_flag(d: Column) -> Column:
    hit = F.lit(False)
    for month, day in HOLIDAYS:
        hit = hit | ((F.month(d) == month) & (F.dayofmonth(d) == day))
    return hit.cast("int")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def daily_panel(
    spark: SparkSession,
    base: str,
    keys: tuple[str, ...] | list[str] = ("c_mktsegment",),
    with_spend: bool = True,
) -> DataFrame:
    """``keys, date, daily_sales, marketing_spend, is_holiday, product_category`` from orders.

    Keys may be ``c_mktsegment``, ``c_nationkey``, ``n_name``, ``r_name``, ``c_custkey`` or none.
    Line items are summed per order before they meet the orders, so totals do not fan out, and that
    aggregate is already partitioned by the join key. No side carries a broadcast hint: dimension
    sizes are checked against the session's threshold, and adaptive execution splits a hot customer.
    Sums are rounded to the grid their terms lie on, which removes the trace of the summation order.
    """
    keys = list(keys)
    rows = table(spark, base, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("date")
    )
    if with_spend:
        per_order = (
            table(spark, base, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("spend"))
        )
        rows = rows.join(per_order, rows.o_orderkey == per_order.l_orderkey, "left")
    else:
        rows = rows.withColumn("spend", F.lit(None).cast("double"))
    dimension_keys = [k for k in keys if k != "c_custkey"]
    if dimension_keys:
        customer = table(spark, base, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
        rows = rows.join(customer, rows.o_custkey == customer.c_custkey)
        if {"n_name", "r_name"} & set(keys):
            nation = table(spark, base, "nation")
            rows = rows.join(nation, rows.c_nationkey == nation.n_nationkey)
            if "r_name" in keys:
                region = table(spark, base, "region")
                rows = rows.join(region, rows.n_regionkey == region.r_regionkey)
    elif keys:
        rows = rows.withColumnRenamed("o_custkey", "c_custkey")
    daily = rows.groupBy(*keys, "date").agg(
        F.round(F.sum("o_totalprice"), 2).alias("daily_sales"),
        F.round(F.sum("spend"), 4).alias("marketing_spend"),
    )
    category = F.col("c_mktsegment") if "c_mktsegment" in keys else F.lit("All")
    return daily.select(
        *keys,
        "date",
        "daily_sales",
        "marketing_spend",
        holiday_flag(F.col("date")).alias("is_holiday"),
        category.alias("product_category"),
    )


def event_panel(spark: SparkSession, base: str) -> DataFrame:
    """A second panel: one row per event type and day."""
    events = table(spark, base, "events")
    return events.groupBy("event_type", F.to_date("ts").alias("date")).agg(
        F.round(F.sum("value"), 2).alias("daily_sales"), F.count("*").alias("n_events")
    )
