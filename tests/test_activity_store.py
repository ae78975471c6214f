"""The activity store: days are replaced one by one, and sketches stay within their error."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pulseline.config import PING_COLUMNS
from pulseline.operators import activity as act
from pulseline.operators import activity_store as acts
from pulseline.operators.silver import time_columns
from pulseline.sources import files, sinks

DAYS = ("2026-05-18", "2026-05-19", "2026-05-20")


def _pings(spark, rows):
    """Rows of (day, hour, vehicle, route, trip)."""
    full = [(dt.datetime.fromisoformat(f"{day} {hour:02d}:00:00"), None, f"e{i}", v, r, t, 49.2, -123.1, None, None)
            for i, (day, hour, v, r, t) in enumerate(rows)]
    return spark.createDataFrame(full, files.PING_SCHEMA)


def _archive(spark, pings, root):
    return sinks.partitioned_sink(pings.select(*PING_COLUMNS, F.date_format("collection_timestamp", "yyyy-MM-dd").alias("date")), root)


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="pulse-test-")


ROWS = [(day, h, f"v{(h * 7 + k) % 5}" if k else None, f"r{k % 3}" if h % 4 else None, f"t{h}{k}")
        for day in DAYS for h in range(6) for k in range(4)]


def test_a_refresh_touches_its_day_only(spark, root):
    archive, store = root + "/archive", root + "/store"
    _archive(spark, _pings(spark, [r for r in ROWS if r[0] != DAYS[2]]), archive)
    acts.refresh(spark, archive, store)
    kept = {n: os.stat(f"{store}/cells/date={DAYS[0]}/{n}").st_mtime_ns for n in os.listdir(f"{store}/cells/date={DAYS[0]}")}
    for day in DAYS[:2]:  # a refresh that read these days would fail
        for name in os.listdir(f"{archive}/date={day}"):
            if name.endswith(".parquet"):
                with open(f"{archive}/date={day}/{name}", "wb") as f:
                    f.write(b"not a table")
    late = ROWS + [(DAYS[2], 23, "v9", "r9", "t9")]
    _archive(spark, _pings(spark, [r for r in late if r[0] == DAYS[2]]), archive)
    for _ in range(2):
        acts.refresh(spark, archive, store, DAYS[2], DAYS[2])
    assert kept == {n: os.stat(f"{store}/cells/date={DAYS[0]}/{n}").st_mtime_ns for n in os.listdir(f"{store}/cells/date={DAYS[0]}")}
    timed = time_columns(_pings(spark, late))
    for table in (act.route_activity, act.daily_summary, act.vehicle_activity, act.hourly_distribution, act.route_hour_heatmap,
                  act.hourly_network_activity):
        assert _rows(table(acts.read_cells(spark, store))) == _rows(table(timed)), table.__name__
    assert {r.date for r in acts.read_cells(spark, store, DAYS[1], DAYS[1]).select("date").collect()} == {DAYS[1]}


def test_late_pings_replace_a_day(spark, root):
    archive, store = root + "/archive", root + "/store"
    _archive(spark, _pings(spark, ROWS), archive)
    acts.refresh(spark, archive, store)
    late = [(DAYS[1], 5, "v77", "r0", "t77")]
    _archive(spark, _pings(spark, late), archive)
    acts.refresh(spark, archive, store, DAYS[1], DAYS[1])
    want = act.route_activity(time_columns(_pings(spark, ROWS + late)))
    assert _rows(act.route_activity(acts.read_cells(spark, store))) == _rows(want)


def test_sketched_counts_stay_within_their_error(spark, root):
    """One route with a third of all pings and 30,000 vehicles over three days, many small routes."""
    ids = spark.range(90_000)
    hot = F.col("id") % 3 == 0
    day = F.element_at(F.array(*map(F.lit, DAYS)), (F.col("id") % 7 % 3 + 1).cast("int"))
    cells = ids.select(
        (F.col("id") % 24).cast("int").alias("hour"), F.when(hot, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 40)).alias("route_id"),
        F.concat(F.lit("v"), F.when(hot, F.col("id")).otherwise(F.col("id") % 100)).alias("vehicle_id"),
        F.when(F.col("id") % 40 != 1, F.concat(F.lit("t"), F.col("id") % 5000)).alias("trip_id"), F.lit(1).cast("long").alias("__n"),
        F.current_timestamp().alias("__first"), F.current_timestamp().alias("__last"), day.alias("date"))
    cells = cells.cache()
    got = {r.route_id: r for r in acts.sketched(acts.day_sketches(cells), "route_id").collect()}
    want = {r.route_id: r for r in act.route_activity(cells).collect()}
    assert got.keys() == want.keys() and want["hot"].unique_vehicles == 30_000
    for key, w in want.items():
        g = got[key]
        assert (g.total_records, g.days_active, g.active_hours) == (w.total_records, w.days_active, w.active_hours)
        for name in ("unique_vehicles", "unique_trips"):
            assert abs(g[name] - w[name]) <= 4 * acts.SKETCH_ERROR * w[name]
    assert got["r1"].unique_trips == 0  # no trip is known there
    window = acts.sketched(acts.day_sketches(cells)).first()
    assert window.total_records == 90_000 and abs(window.unique_vehicles - 30_067) < 0.066 * 30_067
    assert acts.sketched(acts.day_sketches(cells), "date").count() == 3
    assert acts.sketched(acts.day_sketches(cells.limit(0)), "route_id").count() == 0
