"""Sources, sinks, health, streaming and models on small files."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseline.config import PING_COLUMNS
from pulseline.operators import activity as act
from pulseline.operators import dimensions as dims
from pulseline.operators import health, ml
from pulseline.operators import scoring as sco
from pulseline.operators import silver as sil
from pulseline.sources import files, sinks
from pulseline.streaming import jobs

PING_DDL = ("collection_timestamp timestamp, api_vehicle_timestamp timestamp, entity_id string, vehicle_id string, route_id string, "
            "trip_id string, latitude double, longitude double, bearing double, speed double")


def _pings(spark, rows):
    raw = spark.createDataFrame(rows, PING_DDL.replace("timestamp timestamp", "timestamp string"))
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in ("collection_timestamp", "api_vehicle_timestamp")})


T = "2026-05-19 08:00:00"
ROWS = [
    (T, T, "e1", "v1", "r1", "t1", 49.2, -123.1, None, 0.0),
    (T, T, "e2", "v1", "r1", "t1", 49.2, -123.1, 0.0, 2.0),
    (T, "2026-05-19 08:00:30", "e3", "v1", "r2", "t1", 0.0, 0.0, 0.0, 0.4),
    (T, None, "e4", None, None, None, None, None, None, None),
    ("2026-05-20 09:00:00", "2026-05-20 09:00:00", "e5", "v2", "r1", "t2", 51.0, -123.1, 5.0, 9.0),
]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="pulse-test-")


def test_silver_drops_missing_and_outside(spark):
    got = sil.silver_positions(_pings(spark, ROWS)).collect()
    assert [r.entity_id for r in got] == ["e1", "e2"] and got[0].hour_of_day == 8


def test_silver_hours_follow_the_zone(spark):
    r = sil.silver_positions(_pings(spark, [("2026-05-19 03:00:00", T, "e", "v", "r", "t", 49.0, -123.0, None, None)]),
                             tz="America/Los_Angeles").first()
    assert (str(r.service_date), r.hour_of_day) == ("2026-05-18", 20)


def test_quality_counts_null_speed_as_populated(spark):
    r = act.daily_quality_fingerprint(sil.time_columns(_pings(spark, ROWS))).where("date = '2026-05-19'").first()
    assert (r.row_count, r.null_pct_vehicle_id, r.invalid_coord_pct) == (4, 25.0, 25.0)
    assert (r.speed_populated_pct, r.bearing_populated_pct) == (75.0, 50.0)


def test_bad_timestamp_text_becomes_null(spark):
    df = spark.createDataFrame([("2026-05-19 08:00:00",), ("nonsense",)], "collection_timestamp string")
    assert [(r.date, r.hour, r.day_of_week) for r in sil.time_columns(df).collect()] == [("2026-05-19", 8, 1), (None, None, None)]


def test_rows_and_counts_differ_on_null_vehicles(spark):
    df = _pings(spark, [(T, T, "e", None, "r", "t", 1.0, 1.0, None, None), (T, T, "f", "v", "r", "t", 1.0, 1.0, None, None)])
    assert act.route_vehicle_counts(df).first().total_records == 1
    assert act.route_vehicle_counts(df, count_rows=True).first().total_records == 2


def test_mode_tie_takes_the_smallest(spark):
    v = {r.vehicle_id: r for r in act.vehicle_activity(sil.time_columns(_pings(spark, ROWS[1:3]))).collect()}
    assert v["v1"].primary_route == "r1" and v["v1"].routes_served == 2


def test_single_day_route_has_zero_deviation(spark):
    r = act.route_daily_stability(sil.time_columns(_pings(spark, ROWS[:2]))).first()
    assert (r.days_active, r.std_daily_records, r.cv_daily_records, r.is_persistent) == (1, 0.0, 0.0, False)


def test_dimension_rows_without_keys_are_dropped(spark):
    raw = spark.createDataFrame([("t1", "r1", "1", None, "0"), (None, "r1", "1", "s", "0"), ("t2", None, "1", "s", "0")],
                                "trip_id string, route_id string, service_id string, shape_id string, direction_id string")
    out = dims.clean_dimension(raw, "trips")
    assert [r.trip_id for r in out.collect()] == ["t1"] and dict(out.dtypes)["direction_id"] == "int"


def test_newest_eligible_day_per_route(spark):
    silver = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "route_id string, service_date string")
    elig = spark.createDataFrame([("a", "1", "Eligible"), ("a", "2", "Eligible"), ("b", "1", "Eligible"), ("c", "1", "Not Eligible")],
                                 "route_id string, service_date string, eligibility_status string")
    assert sorted(tuple(r) for r in sco.latest_eligible_date(silver, elig).collect()) == [("a", "2"), ("b", "1")]


def test_feed_flattening(spark):
    msg = ('{"entity":[{"id":"1","vehicle":{"trip":{"route_id":"r","trip_id":"t"},"vehicle":{"id":"v"},'
           '"position":{"latitude":49.1,"longitude":-123.0},"timestamp":1700000000}},'
           '{"id":"2"},{"id":"3","vehicle":{"timestamp":0}}]}')
    df = spark.createDataFrame([(T, msg)], "collection_timestamp string, body string")
    got = {r.entity_id: r for r in files.flatten_feed(df).collect()}
    assert set(got) == {"1", "3"}
    assert got["1"].latitude == 49.1 and got["1"].bearing is None and got["1"].api_vehicle_timestamp is not None
    assert got["3"].api_vehicle_timestamp is None and got["3"].vehicle_id is None and got["3"].latitude is None


def test_archive_range_and_missing_day(spark, folder):
    df = _pings(spark, ROWS).withColumn("date", F.date_format("collection_timestamp", "yyyy-MM-dd"))
    sinks.partitioned_sink(df, folder + "/a")
    assert files.scan_partitions(spark, folder + "/a", "2026-05-20", "2026-05-31").count() == 1
    assert files.scan_partitions(spark, folder + "/a", "2026-05-31", "2026-05-20").count() == 0
    assert files.scan_one_date(spark, folder + "/a", "2026-05-19").count() == 4
    with pytest.raises(FileNotFoundError):
        files.scan_one_date(spark, folder + "/a", "2026-06-01")


def test_publish_rejects_bad_batches(spark, folder):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    assert sinks.validated_publish(df, folder + "/s", folder + "/t", ["id"]) == {"rows": 1, "columns": 2}
    with pytest.raises(sinks.PublishError, match="missing columns"):
        sinks.validated_publish(df, folder + "/s", folder + "/t", ["other"])
    with pytest.raises(sinks.PublishError, match="empty"):
        sinks.validated_publish(df.where("id > 1"), folder + "/s", folder + "/t", ["id"])
    with pytest.raises(sinks.PublishError, match="staged"):
        sinks.validated_publish(df, folder + "/s", folder + "/t", ["id"], expected_rows=2)
    assert spark.read.parquet(folder + "/t").count() == 1
    assert sinks.csv_sink(df.where("id > 1"), folder + "/none") is False and not os.path.exists(folder + "/none")


def test_a_failed_publish_leaves_the_old_version_whole(spark, folder, monkeypatch):
    root = folder + "/versions"
    assert sinks.publish_version(spark.range(5), root, ["id"])["version"] == 1
    real = sinks._Store.put

    def fails(*_):
        raise RuntimeError("the writer died")

    monkeypatch.setattr(sinks._Store, "put", fails)  # between the files and the manifest
    with pytest.raises(RuntimeError):
        sinks.publish_version(spark.range(90), root, ["id"])
    assert sinks.read_published(spark, root).count() == 5
    monkeypatch.setattr(sinks._Store, "put", real)
    with pytest.raises(sinks.PublishError, match="empty"):
        sinks.publish_version(spark.range(0), root, ["id"])
    assert sinks.read_published(spark, root).count() == 5
    assert sinks.publish_version(spark.range(7), root, ["id"], mode="append")["version"] == 2
    assert sinks.read_published(spark, root).count() == 12 and sinks.read_published(spark, root, 1).count() == 5
    sinks.publish_version(spark.range(3), root, ["id"])
    assert sinks.read_published(spark, root).count() == 3 and sinks.read_published(spark, root, 2).count() == 12
    with pytest.raises(sinks.PublishError, match="no version"):
        sinks.read_published(spark, root, 1)
    # what the dead writer left is gone, and two writers cannot make one version
    assert len([n for n in os.listdir(root) if n.startswith("data-")]) == 3
    with pytest.raises(sinks.PublishError, match="another writer"):
        sinks._Store(spark, root).put(f"{root}/_manifests/{3:012d}", "{}")


def test_gold_publish_needs_every_table(spark, folder):
    with pytest.raises(sinks.PublishError, match="absent"):
        sinks.gold_publish({"route_type_summary": spark.range(1)}, folder)
    assert sinks.gold_publish({"a": spark.range(3), "b": spark.range(9)}, folder, ["a"]) == {"a": 3}
    assert not os.path.exists(folder + "/b")


def test_views_tables_and_report(spark, folder):
    sinks.replace_view(spark.range(2), "rep_x_view")
    assert sinks.replace_view(spark.range(5), "rep_x_view").count() == 5
    sinks.replace_table(spark.range(4), "rep_x_table", folder + "/tab")
    got = {r.table_name: r.row_count for r in sinks.catalog_report(spark, "rep_x_").collect()}
    assert got == {"rep_x_view": 5, "rep_x_table": 4}
    spark.sql("DROP TABLE rep_x_table")
    assert sinks.catalog_report(spark, "nothing_here").count() == 0


def test_file_health_statuses(spark, folder):
    good = _pings(spark, ROWS[1:3] + ROWS[4:])
    good.coalesce(1).write.parquet(folder + "/date=2026-05-19/ok")
    _pings(spark, ROWS[:2]).coalesce(1).write.parquet(folder + "/date=2026-05-19/dup")
    good.drop("speed").coalesce(1).write.parquet(folder + "/date=2026-05-19/lack")
    for name, content in (("broken.parquet", b"PAR1 not really"), ("zero.parquet", b"")):
        with open(f"{folder}/date=2026-05-19/{name}", "wb") as f:
            f.write(content)
    h = health.file_health(spark, folder)
    rows = {r.path.rsplit("2026-05-19/", 1)[1].split("/")[0]: r for r in h.collect() if r.file_name.endswith(".parquet")}
    assert {k: r.status for k, r in rows.items()} == {
        "ok": "OK", "dup": "WARN", "lack": "FAIL", "broken.parquet": "FAIL", "zero.parquet": "FAIL"}
    assert rows["dup"].duplicate_count == 1 and rows["lack"].missing_columns == "speed"
    only = h.where(F.col("file_name").endswith(".parquet"))
    p = health.pipeline_health(only, F.lit("2026-05-20 09:03:00").cast("timestamp")).first()
    assert (p.total_files, p.valid_files, p.empty_files, p.corrupted_files, p.total_duplicates) == (5, 2, 1, 1, 1)
    assert {p.largest_file, p.smallest_file} == {rows["ok"].file_name, rows["dup"].file_name}
    assert (p.freshness_status, p.freshness_minutes, p.total_rows) == ("FRESH", 3.0, 5)
    assert health.pipeline_health(only.where("false"), F.current_timestamp()).first().freshness_status == "UNKNOWN"
    skipped = {r.file_name for r in files.skipped_files(spark, folder).collect()}
    assert {"broken.parquet", "zero.parquet"} <= skipped


def test_audit_tells_damage_from_empty_files(spark, folder):
    """Names with spaces and signs, files cut or altered at every kind of place, files that are no table."""
    root = folder + "/with space+plus"
    spark.range(50).selectExpr("id", "concat('v', id) AS v").coalesce(1).write.parquet(root + "/whole")
    whole = next(f"{root}/whole/{p}" for p in os.listdir(root + "/whole") if p.endswith(".parquet"))
    raw = open(whole, "rb").read()
    length = int.from_bytes(raw[-8:-4], "little")
    garbled = raw[:-8 - length] + bytes(255 - b for b in raw[-8 - length:-8]) + raw[-8:]
    made = {"zero": b"", "tiny": b"PAR1", "two": b"PAR1PAR1", "cut": raw[: len(raw) // 2], "headless": b"XXXX" + raw[4:],
            "garbled": garbled, "long": raw[:-8] + b"\xff\xff\xff\x7fPAR1", "50% off": raw, "text": b"hello, this is text"}
    for name, content in made.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(content)
    got = {r.file_name: r for r in files.file_audit(spark, root).collect()}
    assert got.keys() == made.keys() | {os.path.basename(whole)}
    assert {k for k, r in got.items() if r.readable} == {"50% off", os.path.basename(whole)}
    assert {k for k, r in got.items() if r.is_parquet} == {"50% off", os.path.basename(whole), "two", "garbled", "long"}
    assert all(got[k].size_bytes == len(v) for k, v in made.items())
    assert (got["50% off"].row_count, got["50% off"].columns) == (50, ["id", "v"])
    assert {r.file_name for r in files.skipped_files(spark, root).collect()} == made.keys() - {"50% off"}


def test_dates_without_files_stay_listed(spark):
    f = spark.createDataFrame([("x/2026-05-19/a.parquet", True, 5)], "path string, readable boolean, row_count bigint").withColumns(
        {"earliest_timestamp": F.lit(T).cast("timestamp"), "latest_timestamp": F.lit(T).cast("timestamp")})
    got = [(str(r.date), r.total_files, r.is_missing) for r in health.all_dates_status(f, "2026-05-18", "2026-05-19").orderBy("date").collect()]
    assert got == [("2026-05-18", 0, True), ("2026-05-19", 1, False)]
    nested = f.withColumn("path", F.lit("file:///2020-01-01/date=2026-05-19/cycle=4/a.parquet"))
    assert health.all_dates_status(nested, "2026-05-19", "2026-05-19").first().total_files == 1


def test_sample_is_bounded_and_repeatable(spark, folder):
    spark.range(2000).select(F.col("id"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude")).repartition(4).write.parquet(folder + "/s")
    df = spark.read.parquet(folder + "/s")
    a = files.sample_per_file(df, ["id"], target=100)
    assert a.count() == 100 and a.exceptAll(files.sample_per_file(df, ["id"], target=100)).isEmpty()
    assert files.sample_cap(df, ["id"], 7).count() == 7


def test_stream_dedup_and_batches(spark, folder):
    _pings(spark, ROWS[:3] + ROWS[4:]).coalesce(1).write.parquet(folder + "/in")
    stream = jobs.read_pings(spark, folder + "/in", files.PING_SCHEMA)
    once = jobs.drain(jobs.stream_dedup(stream), folder + "/out", folder + "/ck")
    assert spark.read.parquet(once).count() == 3
    # a second run finds nothing new
    jobs.drain(jobs.stream_dedup(stream), folder + "/out", folder + "/ck")
    assert spark.read.parquet(once).count() == 3
    bronze = jobs.stream_bronze(stream, folder + "/bronze", folder + "/ck2")
    assert sorted(d for d in os.listdir(bronze) if d.startswith("date=")) == ["date=2026-05-19", "date=2026-05-20"]
    job = jobs.freshness_job(F.lit("2026-05-20 09:30:00").cast("timestamp"))
    r = spark.read.parquet(jobs.drain_batches(stream, job, folder + "/fresh", folder + "/ck3")).first()
    assert (r.freshness_status, r.freshness_minutes) == ("STALE", 30.0)


def test_models_invariants(spark):
    rows = [(f"r{i}", "Regular Bus" if i % 2 else "B-Line", float(i * 5), "x", 100.0 - 4 * i, float(i)) for i in range(20)]
    base = spark.createDataFrame(rows, "route_short_name string, route_type string, fifa_stress_score double, fifa_risk_band string, "
                                       "reliability_score double, bunching_rate_pct double")
    wide = base.withColumns({c: F.lit(0.0) for c in ml.FEATURES if c not in base.columns and c != "route_type_encoded"})
    feats = ml.ml_feature_table(wide)
    assert {(r.route_type, r.route_type_encoded) for r in feats.collect()} == {("B-Line", 0.0), ("Regular Bus", 1.0)}
    table = ml.prepared(feats, folds=3)
    assert ml.logit_out_of_fold(table).filter("prediction is not null").count() == 20
    assert ml.prepared(feats, folds=None).select("fold").distinct().count() == 20
    imp = ml.feature_importance(table, 20)
    assert imp.count() == 15 and imp.agg(F.sum("rf_importance")).first()[0] == pytest.approx(1.0)
    agree = ml.model_agreement(table, 20).collect()
    assert len(agree) == 20 and sum(r.agreement == "agree" for r in agree) >= 17


def _risk_table(spark, n=40, folds=4):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, len(ml.FEATURES))).round(2)
    x[:, 3] = 5.0  # a feature without spread
    label = (x[:, 0] + rng.normal(size=n) > 0.4).astype(int)
    names = ", ".join(f"{c} double" for c in ml.FEATURES)
    rows = [(f"r{k}", "bus", 50.0 * int(y) + k, "b", *v, int(y)) for k, (v, y) in enumerate(zip(x.tolist(), label, strict=True))]
    feats = spark.createDataFrame(
        rows, f"route_short_name string, route_type string, fifa_stress_score double, fifa_risk_band string, {names}, fifa_high_risk int")
    return ml.prepared(feats, folds)


def test_all_folds_reach_the_optimum_of_their_own_rows(spark):
    """Each model is where the penalised, balanced loss of the rows outside its fold is flat."""
    table = _risk_table(spark, folds=None)
    rows = table.select("fold", "label", "z").collect()
    z, y = np.array([r.z for r in rows]), np.array([r.label for r in rows])
    assert np.allclose(z[:, 1:].mean(axis=0), 0) and set(np.round(z[:, 1:].std(axis=0), 9)) == {0.0, 1.0}
    models = ml.fit_folds(table)
    assert set(models) == {r.fold for r in rows} | {ml.ALL}
    for fold, beta in models.items():
        own = np.array([r.fold != fold for r in rows])
        w = np.where(y == 1, own.sum() / 2 / y[own].sum(), own.sum() / 2 / (1 - y[own]).sum())
        p = 1 / (1 + np.exp(-z @ np.array(beta)))
        slope = (w * (p - y) * own) @ z + np.array([0.0, *beta[1:]])
        assert np.abs(slope).max() < 1e-6


def test_passes_do_not_grow_with_the_folds(spark, monkeypatch):
    jobs = []
    real = ml._derivatives
    monkeypatch.setattr(ml, "_derivatives", lambda: jobs.append(1) or real())
    ml.fit_folds(_risk_table(spark, folds=2))
    few = len(jobs)
    ml.fit_folds(_risk_table(spark, folds=None))
    assert few <= ml.PASSES and len(jobs) - few <= ml.PASSES


def test_model_scores_hold_no_function(spark):
    table = _risk_table(spark)
    for df in (ml.logit_out_of_fold(table), ml.logit_agreement(table), ml.model_agreement(table, 5), ml.forest_out_of_fold(table, ml.forest(5))):
        assert "UDF" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 40


def test_forest_arithmetic_equals_the_model(spark):
    from pyspark.ml.functions import vector_to_array

    table = _risk_table(spark)
    vectors = ml.assembled(table)
    model = ml.forest(15).fit(vectors)
    want = {r.route_short_name: r.p for r in model.transform(vectors).select("route_short_name", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.route_short_name: r.v for r in ml.forest_scores(table, model, "v").collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    model = ml.forest_regressor(15).fit(vectors)
    want = {r.route_short_name: r.prediction for r in model.transform(vectors).collect()}
    got = {r.route_short_name: r.v for r in ml.forest_scores(table, model, "v").collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_one_class_left_in_a_fold(spark):
    table = _risk_table(spark).withColumn("fold", F.when(F.col("label") == 1, "ones").otherwise("none"))
    scored = ml.logit_out_of_fold(table).select("label", "prediction").collect()
    assert all(r.prediction == 1 - r.label for r in scored)


def test_contract_columns(spark):
    assert sil.require_columns(_pings(spark, ROWS)) == [] and sil.require_columns(spark.range(1)) == list(PING_COLUMNS)


def test_load_report_counts_damaged_files_and_missing_columns(spark, folder):
    path = folder + "/report"
    whole = spark.createDataFrame([("e1", "v1", 49.0)], "entity_id string, vehicle_id string, latitude double").coalesce(1)
    whole.write.parquet(path)
    good = next(p for p in os.listdir(path) if p.endswith(".parquet"))
    raw = open(f"{path}/{good}", "rb").read()
    open(f"{path}/zero.parquet", "wb").write(b"x")
    open(f"{path}/cut.parquet", "wb").write(raw[: len(raw) // 2])
    row = files.load_report(spark, path).first()
    assert (row.files, row.loaded_files, row.skipped_files) == (3, 1, 2)
    assert row.without_bearing == 1 and row.without_latitude == 0
    assert files.tolerant_load(spark, path).count() == 1


def test_class_report_and_two_rows_per_class(spark):
    rows = [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    report = {r["class"]: r for r in ml.class_report(spark.createDataFrame(rows, "label double, prediction double")).collect()}
    assert (report[1.0].precision, report[1.0].recall, report[1.0].f1, report[1.0].support) == (0.5, 0.5, 0.5, 2)
    assert (report[0.0].precision, report[0.0].recall, report[0.0].support) == (0.667, 0.667, 3)
    single = spark.createDataFrame([("a", 1.0, [1.0] * 16), ("b", 0.0, [1.0] * 16), ("c", 0.0, [1.0] * 16)], "fold string, label double, z array<double>")
    assert ml.logit_out_of_fold(single).filter("prediction is not null").count() == 0


def test_a_snapshot_over_two_files_bunches_whole(spark, folder):
    schema = "event_id long, collection_timestamp timestamp, vehicle_id string, km double"
    def ping(i, at, v, km):
        return (i, dt.datetime(2026, 5, 19, at), v, km)
    parts = [[ping(1, 8, "a", 1.0), ping(2, 9, "c", 3.0)], [ping(3, 8, "b", 1.2), ping(4, 9, "d", 3.1)], [ping(5, 12, "e", 1.0)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder + "/snap")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/snap")

    def pairs(batch):
        return batch.groupBy("collection_timestamp").agg(F.count(F.lit(1)).alias("n"))

    out = jobs.drain_batches(jobs.closed_snapshots(stream, "2 hours"), pairs, folder + "/whole", folder + "/ck-snap")
    got = {r.collection_timestamp.hour: r.n for r in spark.read.parquet(out).collect()}
    assert got == {8: 2, 9: 2}


def _snapshot_files(spark, folder, parts):
    schema = "event_id long, collection_timestamp timestamp, vehicle_id string, km double"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _at(i, hour, vehicle, km):
    return (i, None if hour is None else dt.datetime(2026, 5, 19, hour), vehicle, km)


def test_late_rows_mend_their_slot_and_the_open_tail_is_there(spark, folder):
    """One file per trigger: a late row splits a pair, another leaves a slot without any."""
    parts = [
        [_at(1, 8, "a", 1.0), _at(2, 8, "b", 1.2), _at(3, 9, "a", 5.0), _at(4, 9, "b", 5.1), _at(4, 9, "b", 5.1)],
        [_at(5, 10, "a", 2.0), _at(6, 10, "c", 2.4), _at(7, None, "x", 1.0)],
        [_at(8, 8, "c", 1.1), _at(9, 9, "d", 5.0), _at(10, None, "y", 1.1)],
    ]
    read_slots = []

    def pairs(rows):
        read_slots.append(sorted({r.collection_timestamp.hour if r.collection_timestamp else -1 for r in rows.collect()}))
        own = rows.groupBy("collection_timestamp").agg(F.count(F.lit(1)).alias("n"), F.max("km").alias("far"))
        return own.filter("n != 4")

    places = (folder + "/up-bronze", folder + "/up-sink", folder + "/up-ck")
    jobs.upsert_slots(_snapshot_files(spark, folder + "/up", parts[:2]), pairs, *places)
    first = {r.collection_timestamp and r.collection_timestamp.hour: r.n for r in jobs.slot_results(spark, places[1]).collect()}
    assert first == {8: 2, 9: 3, 10: 2, None: 1}
    # a restart reads the third file only, and only the slots that it touches
    jobs.upsert_slots(_snapshot_files(spark, folder + "/up", parts[2:]), pairs, *places)
    got = {r.collection_timestamp and r.collection_timestamp.hour: r.n for r in jobs.slot_results(spark, places[1]).collect()}
    assert got == {8: 3, 10: 2, None: 2}
    assert read_slots == [[8, 9], [-1, 10], [-1, 8, 9]]


def test_bronze_spreads_the_rows_of_a_slot(spark, folder):
    """One file brings a micro-batch in one task; tasks that sort and write it hold shares of a slot, however few slots."""
    rows = [_at(i, 8, f"v{i}", i / 7) for i in range(4000)]
    places = (folder + "/wide-bronze", folder + "/wide-sink", folder + "/wide-ck")
    small = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for name in small:
        spark.conf.set(name, "8k")
    try:
        stream = _snapshot_files(spark, folder + "/wide", [rows])
        jobs.upsert_slots(stream, lambda r: r.groupBy("collection_timestamp").agg(F.count(F.lit(1)).alias("n")), *places)
    finally:
        for name in small:
            spark.conf.unset(name)
    files = spark.read.parquet(places[0]).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 2000
    assert [r.n for r in jobs.slot_results(spark, places[1]).collect()] == [4000]


def test_newest_record_is_the_state(spark, folder):
    parts = [[_at(1, 8, "a", 1.0)], [_at(2, 11, "b", 1.2), _at(3, 9, "a", 5.0)], [_at(4, None, "b", 5.1)]]
    source = _snapshot_files(spark, folder + "/new", parts)
    for _ in range(2):  # a second run finds nothing new and changes nothing
        table = jobs.drain_upserts(jobs.newest_per_feed(source, F.lit("v")), "feed", folder + "/new-table", folder + "/new-ck")
        rows = spark.read.parquet(table).collect()
        assert [(r.feed, r.collection_timestamp.hour) for r in rows] == [("v", 11)]
    _snapshot_files(spark, folder + "/new", [[_at(5, 12, "c", 0.0)]])
    jobs.drain_upserts(jobs.newest_per_feed(source, F.lit("v")), "feed", folder + "/new-table", folder + "/new-ck")
    assert spark.read.parquet(folder + "/new-table").first().collection_timestamp.hour == 12
