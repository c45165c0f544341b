"""Sources, sinks, the results store, the pipeline, and streams driven to completion."""

from __future__ import annotations

import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkite.config import PanelConfig
from panelkite.operators import quality, reshape
from panelkite.plans.pipeline import run_from_source, run_pipeline
from panelkite.sources import readers, sinks
from panelkite.sources.store import ResultsStore
from panelkite.streaming import intake, state
from panelkite.streaming import sessions as stream

from conftest import rows_of, sales_frame


def write_text(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_reading(spark, folder):
    path = write_text(f"{folder}/a.csv", "date,daily_sales,extra\n2023-01-01,10,x\nnever,oops,y\n")
    rows = rows_of(readers.read_csv(spark, path), "extra")
    assert str(rows["date"][0]) == "2023-01-01" and rows["date"][1] is None and pd.isna(rows["daily_sales"][1])
    assert readers.read_csv(spark, path, on_bad_date="drop").count() == 1
    with pytest.raises(Exception, match="unparsable date"):
        readers.read_csv(spark, path, on_bad_date="raise").collect()
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, f"{folder}/absent.csv")
    empty = write_text(f"{folder}/b.csv", "date,daily_sales\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, empty, require_rows=True)
    cfg = PanelConfig(raw_dir=folder)
    assert readers.read_raw(spark, "a.csv", cfg).count() == 2


def test_source_dispatch_and_bounds(spark, one, folder):
    one.write.parquet(f"{folder}/p")
    df = readers.read_sales(spark, "parquet", f"{folder}/p", "2023-02-01", "2023-02-10")
    assert df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date" in plan
    with pytest.raises(ValueError):
        readers.read_sales(spark, "punchcards", "x")


def test_import_replaces_and_counts(spark, one, folder):
    path = f"{folder}/raw"
    assert sinks.import_sales(one, path) == 100
    assert sinks.import_sales(one.select("date", "daily_sales").limit(7), path) == 7
    again = rows_of(readers.load_sales(spark, path))
    assert again.columns.tolist() == list(readers.STORED_COLUMNS) and again["marketing_spend"].isna().all()


def jobs_of(spark, group, call):
    spark.sparkContext.setJobGroup(group, group)
    try:
        call()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_import_counts_while_it_writes(spark, one, folder):
    """No job beyond those of the write itself; an empty table counts 0."""
    def plain():
        one.repartitionByRange("date").sortWithinPartitions("date").write.parquet(f"{folder}/plain")

    alone = jobs_of(spark, "plain", plain)
    assert jobs_of(spark, "import", lambda: sinks.import_sales(one, f"{folder}/counted")) <= alone
    assert sinks.import_sales(one.limit(0), f"{folder}/none") == 0


def test_pipeline_counts_rows_it_drops_or_keeps(spark, one, folder):
    kept = run_pipeline(one, f"{folder}/kept", drop_nulls=False)
    assert (kept.initial_rows, kept.final_rows) == (100, 100)
    nothing = run_pipeline(one.limit(3), f"{folder}/nothing")
    assert (nothing.success, nothing.initial_rows, nothing.final_rows) == (True, 3, 0), nothing.error


def test_exports(spark, one):
    h = one.withColumn("is_holiday", F.lit(None).cast("int")).transform(sinks.history_export).first()
    assert h["is_holiday"] == 0 and h["date"] == "2023-01-01"
    fc = spark.createDataFrame([("2023-01-02", 1234.567)], "date string, predicted double").withColumn("date", F.col("date").cast("date"))
    assert tuple(sinks.forecast_export(fc).first()) == ("2023-01-02", "Mon", "1234.57")


def test_pipeline_writes_table_and_report(spark, one, folder):
    result = run_pipeline(one, folder)
    assert (result.success, result.initial_rows, result.final_rows, len(result.features)) == (True, 100, 93, 15)
    assert spark.read.parquet(result.path).count() == 93
    summary = json.loads("".join(open(p).read() for p in glob.glob(f"{folder}/report/summary/*.json")))
    assert summary["pipeline_summary"] == {"initial_rows": 100, "final_rows": 93, "rows_removed": 7}
    assert spark.read.json(f"{folder}/report/features").count() == 15


def test_pipeline_from_csv_and_failure(spark, one, folder):
    sinks.write_csv(one, f"{folder}/in")
    result = run_from_source(spark, "csv", f"{folder}/in", f"{folder}/out", fmt="csv")
    assert result.success and result.final_rows == 93, result.error
    assert not run_pipeline(one.drop("date"), f"{folder}/bad").success


def test_store_round_trips(spark, folder):
    store = ResultsStore(spark, folder)
    assert store.best_model().count() == 0 and store.latest_forecast_id() is None
    runs = spark.createDataFrame(
        [("r1", "linear_trend", 5.0, '{"a": "1"}', 1), ("r2", "seasonal_arima", 3.0, "{}", 2), ("r1", "linear_trend", 4.0, '{"a": "2"}', 3)],
        "run_id string, model_name string, test_mape double, best_params string, t long",
    ).withColumn("created_at", F.timestamp_seconds("t")).drop("t")
    store.save_runs(runs)
    assert [r["run_id"] for r in store.runs().collect()] == ["r1", "r2"]
    assert store.runs("linear_trend").first()["test_mape"] == 4.0
    assert store.best_model().first()["model_name"] == "seasonal_arima"
    first = store.metrics().first()
    assert first["test_mape"] == 3.0 and first["target_met"]
    assert store.models(["linear_trend", "other"]).filter("run_id IS NULL").first()["model_name"] == "other"
    plan = store.read("training_runs", model_name="linear_trend")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_name" in plan


def test_store_importance_curves_insights(spark, folder):
    store = ResultsStore(spark, folder)
    imp = spark.createDataFrame([("a", 0.1), ("b", -0.7), ("c", 0.2)], "feature_name string, importance_score double")
    store.save_importance("run1", "random_forest", imp)
    store.save_importance("run2", "random_forest", imp.limit(2))
    assert [r["feature_name"] for r in store.latest_importance("random_forest").collect()] == ["b", "a"]
    assert store.importance("boosted_trees").count() == 0
    curve = spark.createDataFrame([([3.0, 2.0], [4.0])], "train_losses array<double>, val_losses array<double>")
    store.save_learning_curve("run1", "boosted_trees", curve)
    assert [(r["iteration"], r["val_loss"]) for r in store.learning_curve("run1").collect()] == [(1, 4.0), (2, None)]
    wide = spark.sql("SELECT named_struct('slope', 1.5D, 'dir', 'up') AS trend, map('x', 1) AS m, 7 AS n")
    store.save_insights("a1", wide)
    got = {(r["insight_type"], r["insight_key"]): r["insight_value"] for r in store.insights("a1").collect()}
    assert got == {("trend", "slope"): "1.5", ("trend", "dir"): '"up"', ("m", "x"): "1", ("n", "value"): "7"}


def test_store_forecasts(spark, folder):
    store = ResultsStore(spark, folder)
    fc = spark.sql(
        "SELECT m AS model, date_add(DATE '2024-01-01', CAST(i AS INT)) AS date, CAST(i + 1 AS INT) AS day_number, CAST(i * w AS DOUBLE) AS predicted, "
        "CAST(0 AS DOUBLE) AS lower_bound, CAST(99 AS DOUBLE) AS upper_bound FROM range(4) t(i), VALUES ('linear_trend', 1), ('seasonal_arima', 2) v(m, w)")
    store.save_forecasts("old", fc.filter("model = 'linear_trend'"))
    store.save_forecasts("new", fc)
    assert store.latest_forecast_id() == "new" and store.forecast_ids().count() == 2
    wide = rows_of(store.forecast_comparison(["linear_trend", "seasonal_arima"]), "date")
    assert wide["seasonal_arima"].tolist() == [0, 2, 4, 6]
    s = {r["model_name"]: r for r in store.forecast_summary().collect()}
    assert s["linear_trend"]["std"] == pytest.approx(1.25 ** 0.5) and s["linear_trend"]["n_days"] == 4
    kinds = {r["model_name"]: r["ci_method"] for r in store.forecasts(forecast_id="new").collect()}
    assert kinds == {"linear_trend": "mad", "seasonal_arima": "native"}


def test_compare_with_intervals(spark):
    fc = spark.sql("SELECT 'm1' AS model, DATE '2024-01-01' AS date, 5.0D AS predicted, 4.0D AS lower_bound, 6.0D AS upper_bound")
    row = reshape.compare_forecasts(fc, [], ["m1", "m2"], True).first().asDict()
    assert row["m1_lower"] == 4.0 and row["m2"] is None


EVENTS = "event_id long, ts timestamp, user_id long, value double"


def event_files(spark, folder, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, t long, user_id long, value double")
        df.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "value").coalesce(1).write.parquet(f"{folder}/in/b{i}")
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_streamed_sessions_close_behind_the_watermark(spark, folder):
    day = 86_400
    raw = event_files(spark, folder, [[(1, 0, 1, 1.0), (2, 3_600, 1, 2.0), (3, 9_000, 1, 4.0), (4, 3 * day, 2, 1.0)]])
    stream.run_available(stream.session_stream(raw, ["user_id"]), f"{folder}/out", f"{folder}/mark")
    got = [(r["user_id"], r["n_events"], r["total_value"]) for r in spark.read.parquet(f"{folder}/out").orderBy("session_start").collect()]
    assert got == [(1, 2, 3.0), (1, 1, 4.0)]


def test_last_items_across_batches(spark, folder):
    batches = [[(i, i, i % 2, 0.0) for i in range(20)], [(100 + i, 1000 + i, 0, 0.0) for i in range(3)]]
    raw = event_files(spark, folder, batches)
    stream.keep_last_items(raw, ["user_id"], f"{folder}/out", f"{folder}/mark", n=4)
    got = stream.read_last_items(spark, f"{folder}/out", ["user_id"])
    assert got.filter("user_id = 1").count() == 4
    ids = {r["event_id"] for r in got.filter("user_id = 0").collect()}
    assert ids == {100, 101, 102, 18}


def test_a_batch_touches_only_its_own_entities(spark, folder):
    batches = [[(i, i, i % 50, 0.0) for i in range(500)], [(1000 + i, 1000 + i, 7, 0.0) for i in range(3)], [(2000, 1, 9, 0.0)]]
    raw = event_files(spark, folder, batches)
    query = stream.keep_last_items(raw, ["user_id"], f"{folder}/out", f"{folder}/mark", n=4)
    reached = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    wrote = [spark.read.parquet(f"{folder}/out/batch={i}").select("user_id").distinct().count() for i in range(3)]
    assert reached == [500, 3, 1] and wrote == [50, 1, 0]  # the last row is older than the four kept
    updated = [p["stateOperators"][0]["customMetrics"].get("rocksdbPutCount", 0) for p in query.recentProgress if p["numInputRows"]]
    assert updated[0] > 10 * max(updated[1:])
    stream.compact_last_items(spark, f"{folder}/out", f"{folder}/small", ["user_id"])
    assert sorted(map(tuple, stream.read_last_items(spark, f"{folder}/small", ["user_id"]).collect())) == sorted(
        map(tuple, stream.read_last_items(spark, f"{folder}/out", ["user_id"]).collect()))


def silences(rows, watermark, stale, expired):
    """``user, status, last, at`` in seconds, by plain Python."""
    out = set()
    for user in {r[2] for r in rows}:
        times = sorted({r[1] for r in rows if r[2] == user})
        for t, following in zip(times, [*times[1:], float("inf")]):
            for status, limit in (("stale", stale), ("expired", expired)):
                if following > t + limit and t + limit <= watermark:
                    out.add((user, status, t, t + limit))
    return out


def test_silences_are_emitted_once_and_survive_a_restart(spark, folder):
    import random
    rng = random.Random(3)
    day = 86_400
    first = [(i, rng.randrange(2 * day), rng.randrange(6), 0.0) for i in range(600)]
    # The second file fills gaps within the lateness, and one row comes too late.
    second = [(1000 + i, rng.randrange(day + 1, 4 * day), rng.randrange(6), 0.0) for i in range(200)] + [(2000, 4 * day, 5, 0.0)]
    late = max(r[1] for r in first) - day
    second = [r for r in second if r[1] > late]
    dropped = (3000, 10, 0, 0.0)
    out, mark = f"{folder}/out", f"{folder}/mark"
    seconds = lambda t: int(t.timestamp())
    for n, files in ((1, [first]), (2, None)):
        if n == 1:
            raw = event_files(spark, folder, files)
        else:
            rows = spark.createDataFrame([*second, dropped], "event_id long, t long, user_id long, value double")
            rows.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "value").coalesce(1).write.parquet(f"{folder}/in/b1")
            raw = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        stream.run_available(state.silent_entities(raw, ["user_id"], stale_seconds=600, timeout_seconds=3600), out, mark)
        known = first if n == 1 else first + second
        want = silences(known, max(r[1] for r in known) - day, 600, 3600)
        got = [(r["user_id"], r["status"], seconds(r["last_seen"]), seconds(r["at"])) for r in spark.read.parquet(out).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_silences_hold_every_row_against_the_watermark(spark, folder):
    """A gap of exactly the limit is no silence, and rows a little late undo none."""
    day, out, mark = 86_400, f"{folder}/out", f"{folder}/mark"
    event_files(spark, folder, [[(1, 0, 7, 0.0), (2, 600, 7, 0.0), (3, 600, 7, 0.0), (4, 1201, 7, 0.0), (5, day + 1801, 8, 0.0), (9, None, 7, 0.0)]])
    raw = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    got = lambda: sorted((r["user_id"], r["status"], int(r["last_seen"].timestamp()), int(r["at"].timestamp()))
                         for r in spark.read.parquet(out).collect())
    run = lambda: stream.run_available(state.silent_entities(raw, ["user_id"], stale_seconds=600, timeout_seconds=3600), out, mark)
    run()
    assert got() == [(7, "stale", 600, 1200), (7, "stale", 1201, 1801)]
    # The watermark stands at 1801: a row at 1300 is dropped, though it lies within the limit; the other moves the watermark on.
    more = spark.createDataFrame([(6, 1300, 7, 0.0), (7, day + 9000, 8, 0.0)], "event_id long, t long, user_id long, value double")
    more.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "value").coalesce(1).write.parquet(f"{folder}/in/b1")
    run()
    assert got() == [(7, "expired", 1201, 4801), (7, "stale", 600, 1200), (7, "stale", 1201, 1801)]


def test_silences_touch_the_state_of_an_entity_once_a_batch():
    """The calls between the worker and the state store do not grow with the events of an entity."""
    from types import SimpleNamespace

    calls, held = [], {}

    class Value:
        get = staticmethod(lambda: calls.append("get") or held.get("v"))
        update = staticmethod(lambda v: calls.append("update") or held.update(v=v))
        clear = staticmethod(lambda: calls.append("clear") or held.clear())

    handle = SimpleNamespace(getValueState=lambda *_: Value, registerTimer=lambda ms: calls.append(("timer", ms)))
    processor = state.Silence(["user_id", "stale", "expired"], 300, 3600)
    processor.init(handle)
    times = [i * 400 * 1_000_000 for i in range(50)]
    assert list(processor.handleInputRows((1,), iter([{"micros": t} for t in reversed(times)]), None)) == []
    assert calls == ["get", "update", ("timer", 300_000)]
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9)
    (made,) = processor.handleExpiredTimer((1,), watermark, None)
    assert made.user_id == 1 and made.stale == times and made.expired == times[-1:]
    assert calls[3:] == ["get", "clear"] and list(processor.handleExpiredTimer((1,), watermark, None)) == []


def test_csv_intake_rejects_and_resumes(spark, folder):
    import os
    os.makedirs(f"{folder}/in")
    write_text(f"{folder}/in/a.csv", "date,daily_sales\n2023-01-01,10\nnever,5\n2023-01-02,x\n2023-01-01,10\n")
    for _ in range(2):  # the second run finds nothing new
        raw = intake.stream_csv(spark, f"{folder}/in", ["date", "daily_sales"])
        intake.intake(raw, f"{folder}/good", f"{folder}/bad", f"{folder}/checks", f"{folder}/mark")
    assert intake.loaded(spark, f"{folder}/good").count() == 1
    assert spark.read.parquet(f"{folder}/bad").count() == 2
    write_text(f"{folder}/in/b.csv", "date,daily_sales\n2023-01-01,99\n2023-01-03,7\n")
    raw = intake.stream_csv(spark, f"{folder}/in", ["date", "daily_sales"])
    intake.intake(raw, f"{folder}/good", f"{folder}/bad", f"{folder}/checks", f"{folder}/mark")
    rows = rows_of(intake.loaded(spark, f"{folder}/good"), "date")
    assert rows["daily_sales"].tolist() == [10.0, 7.0]
    with pytest.raises(ValueError):
        intake.intake(raw.drop("daily_sales"), "x", "y", "z", "m")


def test_data_info(spark, one):
    info = {r["column"]: r for r in quality.data_info(one).collect()}
    assert info["daily_sales"]["dtype"] == "double" and info["date"]["rows"] == 100
    assert str(info["date"]["date_end"]) == "2023-04-10" and len(info) == len(sales_frame().columns)


def test_csv_scan_writes_in_parallel(spark, folder, monkeypatch):
    """The table does not pass through one task: each partition writes its own file."""
    from panelkite.plans import queries

    orders = spark.range(80).selectExpr("id AS o_orderkey", "DATE'2023-01-01' AS o_orderdate", "CAST(id AS DOUBLE) AS o_totalprice")
    orders.repartition(8).write.parquet(f"{folder}/orders.parquet")
    monkeypatch.setattr(queries, "new_path", lambda *_: f"{folder}/csv")
    got = queries.csv_scan(spark, folder).collect()
    assert sum(r.n for r in got) == 80 and sum(r["keys"] for r in got) == 40
    assert len([f for f in os.listdir(f"{folder}/csv") if f.endswith(".csv")]) > 2
