"""Source, sink, health, streaming and model queries.

Those that need files write the given tables to a new folder below the shared checkpoint folder
and read that.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from pulseline.config import FRESH_MINUTES, PING_COLUMNS
from pulseline.functions import columns as C
from pulseline.operators import activity as act
from pulseline.operators import activity_store as acts
from pulseline.operators import geometry as geo
from pulseline.operators import health, ml
from pulseline.operators import scenario as sc
from pulseline.operators import scoring as sco
from pulseline.operators.spacing import CORRIDOR_KEYS
from pulseline.plans.domain import BOUND_SHAPE_KM, Domain
from pulseline.plans.registry import cte, div, query, r
from pulseline.session import scratch_path
from pulseline.sources import files, sinks
from pulseline.streaming import jobs

NOW = "2024-01-31 00:02:00"


def _archive(d: Domain) -> str:
    """The pings as a date-partitioned archive of the ten contract columns."""
    path = scratch_path(d.spark, "archive")
    dated = d.raw_pings.select(*PING_COLUMNS, F.date_format("collection_timestamp", "yyyy-MM-dd").alias("date"))
    return sinks.partitioned_sink(dated, path)


_DRIFT = "2024-01-15"  # days before this one were written without a bearing
_BOUND = {"bearing": f"CASE WHEN date < '{_DRIFT}' THEN NULL ELSE bearing END"} | {
    c: f"CAST({c} AS VARCHAR)" for c in ("collection_timestamp", "api_vehicle_timestamp")
}
_TEN = ", ".join(f"{_BOUND.get(c, c)} AS {c}" for c in PING_COLUMNS)


def _drifting_archive(d: Domain) -> str:
    """A date-partitioned archive whose older files lack a column."""
    path = scratch_path(d.spark, "archive")
    dated = d.raw_pings.select(*PING_COLUMNS, F.date_format("collection_timestamp", "yyyy-MM-dd").alias("date"))
    sinks.partitioned_sink(dated.where(F.col("date") < _DRIFT).drop("bearing"), path)
    return sinks.partitioned_sink(dated.where(F.col("date") >= _DRIFT), path)


@query("bronze_scan", f"SELECT {_TEN} FROM c_timed")
def _(d: Domain):
    return files.scan_archive(d.spark, _drifting_archive(d))


@query("scan_one_date", f"SELECT {_TEN}, date FROM c_timed WHERE date = '2024-01-10'")
def _(d: Domain):
    return files.scan_one_date(d.spark, _drifting_archive(d), "2024-01-10")


@query("scan_date_range", f"SELECT {_TEN}, date FROM c_timed WHERE date BETWEEN '2024-01-13' AND '2024-01-17'")
def _(d: Domain):
    return files.scan_partitions(d.spark, _drifting_archive(d), "2024-01-13", "2024-01-17")


_CUT, _EMPTY = "2024-01-10", "2024-01-11"  # days with one more file, damaged or of zero bytes


def _cycle_archive(d: Domain) -> str:
    """An archive with one file per collection cycle, a damaged and an empty one; cycles before
    _DRIFT lack a bearing."""
    path = scratch_path(d.spark, "cycles")
    day, cycle = F.date_format("collection_timestamp", "yyyy-MM-dd"), F.hour("collection_timestamp")
    dated = d.raw_pings.select(*PING_COLUMNS, day.alias("date"), cycle.alias("cycle")).repartition("date", "cycle")
    early = F.col("date") < _DRIFT
    for part in (dated.where(early).drop("bearing"), dated.where(~early)):
        part.write.mode("append").partitionBy("date", "cycle").parquet(path)
    sinks.write_bytes(d.spark, f"{path}/date={_CUT}/cut.parquet", b"PAR1 and no more of it")
    sinks.write_bytes(d.spark, f"{path}/date={_EMPTY}/empty.parquet", b"")
    return path


_PER_FILE = ", ".join(r(f"avg(CASE WHEN {_BOUND.get(c, c) if c == 'bearing' else c} IS NULL THEN 1e0 ELSE 0e0 END) * 1e2")
                      + f" AS null_pct_{c}" for c in PING_COLUMNS)
_DAMAGED = ", ".join(f"NULL AS {c}" for c in (
    "earliest_timestamp", "latest_timestamp", "unique_routes", *(f"null_pct_{c}" for c in PING_COLUMNS)))
_ALL_MISSING = ",".join(PING_COLUMNS)
_WIDEST = ", ".join(f"null_pct_{c}" for c in PING_COLUMNS)
cte("c_files", f"""
SELECT date, size, is_parquet, readable, row_count, duplicate_count, earliest_timestamp, latest_timestamp, unique_routes,
  {_WIDEST}, missing_columns, CASE WHEN missing_columns <> '' THEN 'FAIL'
    WHEN duplicate_count > 0 OR greatest({_WIDEST}) > 5e1 THEN 'WARN' ELSE 'OK' END AS status
FROM (
  SELECT date, 1 AS size, true AS is_parquet, true AS readable, count(*) AS row_count,
    count(*) - count(DISTINCT (vehicle_id, api_vehicle_timestamp)) AS duplicate_count,
    min(collection_timestamp) AS earliest_timestamp, max(collection_timestamp) AS latest_timestamp,
    count(DISTINCT route_id) AS unique_routes, {_PER_FILE}, CASE WHEN date < '{_DRIFT}' THEN 'bearing' ELSE '' END AS missing_columns
  FROM c_timed GROUP BY date, hour
  UNION ALL SELECT '{_CUT}', 1, false, false, 0, 0, {_DAMAGED}, '{_ALL_MISSING}'
  UNION ALL SELECT '{_EMPTY}', 0, false, false, 0, 0, {_DAMAGED}, '{_ALL_MISSING}')""")


@query("load_report", f"""
SELECT count(*) FILTER (size > 0) AS files, count(*) FILTER (readable) AS loaded_files, count(*) FILTER (size > 0 AND NOT readable) AS skipped_files,
  {', '.join(f"count(*) FILTER (null_pct_{c} = 100) AS without_{c}" for c in PING_COLUMNS)} FROM c_files""")
def _(d: Domain):
    return files.load_report(d.spark, _cycle_archive(d))


@query("skipped_files", "SELECT 'cut.parquet' AS file_name, 22 AS size_bytes UNION ALL SELECT 'empty.parquet', 0 FROM (SELECT count(*) FROM events)")
def _(d: Domain):
    return files.skipped_files(d.spark, _cycle_archive(d))


# --- sources and sinks -----------------------------------------------------------------------------

@query("partitioned_sink", """
SELECT entity_id, vehicle_id, route_id, strftime(collection_timestamp, '%Y-%m-%d') AS date FROM c_pings
WHERE strftime(collection_timestamp, '%Y-%m-%d') BETWEEN '2024-01-08' AND '2024-01-12'""")
def _(d: Domain):
    out = files.scan_partitions(d.spark, _archive(d), "2024-01-08", "2024-01-12")
    return out.select("entity_id", "vehicle_id", "route_id", F.col("date").cast("string").alias("date"))


@query("tolerant_load", "SELECT entity_id, vehicle_id, latitude, longitude FROM c_pings")
def _(d: Domain):
    return files.tolerant_load(d.spark, _archive(d)).select("entity_id", "vehicle_id", "latitude", "longitude")


@query("with_source_file", "SELECT 'events.parquet' AS source_file, count(*) AS row_count FROM events")
def _(d: Domain):
    events = files.with_source_file(d.tables.base("events"))
    return events.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"))


@query("gtfs_csv_scan", "SELECT route_id, route_short_name, route_long_name, CAST(route_type AS VARCHAR) AS route_type FROM c_routes")
def _(d: Domain):
    path = scratch_path(d.spark, "routes-csv")
    sinks.csv_sink(d.routes, path)
    return files.schedule_csv(d.spark, path)


_COUNTS_SCHEMA = T.StructType([
    T.StructField("route_id", T.StringType()), T.StructField("total_records", T.LongType()),
    T.StructField("unique_vehicles", T.LongType()), T.StructField("records_per_vehicle", T.DoubleType())])


@query("typed_csv_scan", "SELECT * FROM c_counts")
def _(d: Domain):
    path = scratch_path(d.spark, "counts-csv")
    sinks.csv_sink(d.counts.select("route_id", "total_records", "unique_vehicles", "records_per_vehicle"), path)
    files.require_inputs(d.spark, [path])
    return files.typed_csv(d.spark, path, _COUNTS_SCHEMA)


@query("csv_sink", "SELECT CAST(route_id AS VARCHAR) AS route_id, CAST(total_records AS VARCHAR) AS total_records FROM c_counts")
def _(d: Domain):
    path = scratch_path(d.spark, "export-csv")
    sinks.csv_sink(d.counts.select("route_id", "total_records"), path)
    return files.schedule_csv(d.spark, path)


@query("flatten_feed", """
SELECT CAST(collection_timestamp AS VARCHAR) AS collection_timestamp,
  CAST(date_trunc('second', api_vehicle_timestamp) AS VARCHAR) AS api_vehicle_timestamp, entity_id, vehicle_id, route_id, trip_id,
  latitude, longitude, bearing, speed FROM c_pings""")
def _(d: Domain):
    return files.flatten_feed(files.pings_to_feed(d.raw_pings))


@query("validated_publish", "SELECT route_id, total_spacing_rows, reliability_score, reliability_band FROM c_scores")
def _(d: Domain):
    target = scratch_path(d.spark, "scores")
    batch = d.scores.select("route_id", "total_spacing_rows", "reliability_score", "reliability_band")
    sinks.validated_publish(batch, scratch_path(d.spark, "staging"), target, ["route_id", "reliability_score"])
    return d.spark.read.parquet(target)


@query("versioned_publish", "SELECT route_id, total_spacing_rows, reliability_score, reliability_band FROM c_scores")
def _(d: Domain):
    """Two versions: the routes without a score band come later, appended to the first."""
    root = scratch_path(d.spark, "versions")
    batch = d.store(d.scores.select("route_id", "total_spacing_rows", "reliability_score", "reliability_band"), "scores")
    first = F.col("route_id").cast("int") % 2 == 0
    sinks.publish_version(batch.filter(first), root, ["route_id"])
    sinks.publish_version(batch.filter(~F.coalesce(first, F.lit(False))), root, ["route_id"], mode="append")
    return sinks.read_published(d.spark, root)


@query("create_or_replace", "SELECT * FROM c_activity")
def _(d: Domain):
    return sinks.replace_view(d.activity, "pulse_route_activity")


def _gold(d: Domain):
    return {
        "route_reliability_scores": d.scores, "corridor_priority_ranking": d.gold_both, "hourly_bunching_pattern": d.hourly,
        "bunching_hotspots_with_stops": geo.hotspots_with_stops(d.gold_hotspots, d.stop_ref), "route_type_summary": sco.route_type_summary(d.scores),
    }


@query("gold_publish", """
SELECT 'route_reliability_scores' AS table_name, count(*) AS row_count FROM c_scores
UNION ALL SELECT 'corridor_priority_ranking', count(*) FROM c_priority UNION ALL SELECT 'hourly_bunching_pattern', count(*) FROM c_hourly
UNION ALL SELECT 'bunching_hotspots_with_stops', count(*) FROM c_hot_stops
UNION ALL SELECT 'route_type_summary', count(DISTINCT route_type) FROM c_scores""")
def _(d: Domain):
    rows = sinks.gold_publish(_gold(d), scratch_path(d.spark, "gold"))
    return d.spark.createDataFrame(list(rows.items()), "table_name string, row_count bigint")


@query("catalog_report", """
SELECT 'pulse_report_routes' AS table_name, count(*) AS row_count FROM c_routes UNION ALL SELECT 'pulse_report_stops', count(*) FROM c_stops
UNION ALL SELECT 'pulse_report_trips', count(*) FROM c_trips""")
def _(d: Domain):
    for name in ("routes", "stops", "trips"):
        sinks.replace_view(getattr(d, name), f"pulse_report_{name}")
    return sinks.catalog_report(d.spark, "pulse_report_")


@query("file_magic_audit")
def _(d: Domain):
    return files.file_magic_audit(d.spark, _archive(d))


@query("sample_per_file", """
SELECT entity_id, route_id, latitude, longitude FROM (
  SELECT *, row_number() OVER (PARTITION BY date, hour ORDER BY md5(entity_id), entity_id) AS place,
    (SELECT count(DISTINCT (date, hour)) FROM c_timed) AS files FROM c_timed)
WHERE place <= greatest(1, 5000 // files) AND latitude IS NOT NULL AND longitude IS NOT NULL""")
def _(d: Domain):
    df = files.tolerant_load(d.spark, _cycle_archive(d))
    return files.sample_per_file(df, ["entity_id"], target=5000).select("entity_id", "route_id", "latitude", "longitude")


@query("sample_cap", """
SELECT event_id, latitude, longitude FROM (SELECT * FROM c_pings ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 500)""")
def _(d: Domain):
    return files.sample_cap(d.raw_pings, ["event_id"], 500).select("event_id", "latitude", "longitude")


# --- health ---------------------------------------------------------------------------------------------

def _cycle_health(d: Domain):
    return health.file_health(d.spark, _cycle_archive(d))


_SPAN = "CAST(earliest_timestamp AS VARCHAR) AS earliest_timestamp, CAST(latest_timestamp AS VARCHAR) AS latest_timestamp"


@query("file_health", f"SELECT * EXCLUDE (date, size) REPLACE ({_SPAN}) FROM c_files")
def _(d: Domain):
    # names and sizes depend on the writer
    return _cycle_health(d).drop("path", "file_name", "size_bytes")


@query("pipeline_health", f"""
SELECT *, {r(div('total_rows', 'valid_files'), 1)} AS avg_rows_per_file,
  {r(f"(epoch_us(TIMESTAMP '{NOW}') / 1e6 - epoch_us(CAST(latest_timestamp AS TIMESTAMP)) / 1e6) / 6e1", 1)} AS freshness_minutes,
  CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(CAST(latest_timestamp AS TIMESTAMP)) <= {FRESH_MINUTES} * 60000000 THEN 'FRESH' ELSE 'STALE' END AS freshness_status
FROM (SELECT count(*) AS total_files, count(*) FILTER (ok) AS valid_files, count(*) FILTER (NOT ok) AS failed_files,
    count(*) FILTER (status = 'WARN') AS warned_files, count(*) FILTER (size = 0) AS empty_files,
    count(*) FILTER (size > 0 AND NOT readable) AS corrupted_files, CAST(sum(row_count) FILTER (ok) AS BIGINT) AS total_rows,
    CAST(sum(duplicate_count) AS BIGINT) AS total_duplicates, CAST(min(earliest_timestamp) FILTER (ok) AS VARCHAR) AS earliest_timestamp,
    CAST(max(latest_timestamp) FILTER (ok) AS VARCHAR) AS latest_timestamp, max(unique_routes) FILTER (ok) AS max_routes_in_file,
    {', '.join(r(f'avg(null_pct_{c}) FILTER (ok)') + f' AS avg_null_pct_{c}' for c in PING_COLUMNS)}
  FROM (SELECT *, status <> 'FAIL' AS ok FROM c_files))""")
def _(d: Domain):
    # names and sizes depend on the writer
    return health.pipeline_health(_cycle_health(d), F.lit(NOW).cast("timestamp")).drop(
        "largest_file", "largest_file_bytes", "smallest_file", "smallest_file_bytes")


@query("files_per_hour", """
SELECT strftime(latest_timestamp, '%Y-%m-%d %H:00') AS hour, count(*) AS files FROM c_files WHERE status <> 'FAIL' GROUP BY 1""")
def _(d: Domain):
    return health.files_per_hour(_cycle_health(d))


@query("all_dates_status", """
SELECT strftime(day, '%Y-%m-%d') AS date, coalesce(total_files, 0) AS total_files, coalesce(valid_files, 0) AS valid_files,
  coalesce(corrupted_files, 0) AS corrupted_files, coalesce(total_rows, 0) AS total_rows, earliest_record, latest_record, total_files IS NULL AS is_missing
FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS day) d
LEFT JOIN (SELECT date, count(*) AS total_files, count(*) FILTER (readable) AS valid_files, count(*) FILTER (NOT readable) AS corrupted_files,
    CAST(sum(row_count) AS BIGINT) AS total_rows, CAST(min(earliest_timestamp) AS VARCHAR) AS earliest_record,
    CAST(max(latest_timestamp) AS VARCHAR) AS latest_record FROM c_files GROUP BY date) f ON strftime(day, '%Y-%m-%d') = f.date""")
def _(d: Domain):
    return health.all_dates_status(_cycle_health(d), "2023-12-30", "2024-02-01")


_PROFILE = " UNION ALL ".join(
    f"SELECT 'null_count', '{c}', count(*) FILTER ({c} IS NULL) FROM c_pings" for c in PING_COLUMNS)


@query("file_profile", f"""
SELECT 'null_count' AS section, 'rows' AS item, count(*) AS value FROM c_pings UNION ALL {_PROFILE}
UNION ALL (SELECT 'top_route', route_id, count(*) AS n FROM c_pings WHERE route_id IS NOT NULL GROUP BY route_id ORDER BY n DESC, route_id LIMIT 10)
UNION ALL SELECT 'unique_routes', 'route_id', count(DISTINCT route_id) FROM c_pings""")
def _(d: Domain):
    return health.file_profile(d.raw_pings)


# --- a growing archive ----------------------------------------------------------------------------------

def _activity_store(d: Domain) -> str:
    """A store that grew: the first half of the month, then the rest, then one day once more."""
    archive, store = _archive(d), scratch_path(d.spark, "activity-store")
    for first, last in ((None, "2024-01-15"), ("2024-01-16", None), ("2024-01-10", "2024-01-10")):
        acts.refresh(d.spark, archive, store, first, last)
    return store


@query("route_activity_store", "SELECT * FROM c_activity")
def _(d: Domain):
    return act.route_activity(acts.read_cells(d.spark, _activity_store(d)))


@query("daily_summary_store", "SELECT * FROM c_daily")
def _(d: Domain):
    return act.daily_summary(acts.read_cells(d.spark, _activity_store(d)))


@query("vehicle_activity_store", "SELECT * FROM c_vehicles")
def _(d: Domain):
    return act.vehicle_activity(acts.read_cells(d.spark, _activity_store(d)))


_EXACT = ("total_records", "days_active", "active_hours", "first_seen", "last_seen")


@query("route_activity_sketched", f"""
SELECT route_id, {', '.join(_EXACT)}, unique_vehicles, unique_trips, true AS vehicles_within, true AS trips_within FROM c_activity""")
def _(d: Domain):
    """Exact and estimated counts side by side: whether an estimate is within four standard errors."""
    store = _activity_store(d)
    exact = act.route_activity(acts.read_cells(d.spark, store)).select("route_id", "unique_vehicles", "unique_trips")
    guess = acts.sketched(acts.read_sketches(d.spark, store), "route_id").withColumnsRenamed(
        {"unique_vehicles": "about_vehicles", "unique_trips": "about_trips"})

    def within(kind: str):
        off = F.abs(F.col(f"about_{kind}") - F.col(f"unique_{kind}"))
        return (off <= F.greatest(F.col(f"unique_{kind}") * (4 * acts.SKETCH_ERROR), F.lit(0.5))).alias(f"{kind}_within")

    return guess.join(exact, "route_id").select(
        "route_id", *_EXACT, "unique_vehicles", "unique_trips", within("vehicles"), within("trips"))


# --- streaming -----------------------------------------------------------------------------------------

def _stream(d: Domain):
    """The bound pings as a stream over the event files."""
    schema = d.tables.base("events").schema
    live = d.spark.readStream.schema(schema).parquet(f"{d.folder}/events.parque[t]")
    bound = type(d.tables)(d.spark, d.folder)
    bound.base = lambda name: live
    return bound.pings()


def _places(d: Domain, name: str) -> tuple[str, str]:
    root = scratch_path(d.spark, name)
    return f"{root}/sink", f"{root}/checkpoint"


@query("stream_bronze", "SELECT event_id, vehicle_id, route_id, strftime(collection_timestamp, '%Y-%m-%d') AS date FROM c_pings")
def _(d: Domain):
    out = d.spark.read.parquet(jobs.stream_bronze(_stream(d), *_places(d, "bronze")))
    return out.select("event_id", "vehicle_id", "route_id", F.col("date").cast("string").alias("date"))


@query("stream_dedup", """
SELECT DISTINCT vehicle_id, CAST(api_vehicle_timestamp AS VARCHAR) AS api_vehicle_timestamp FROM c_pings""")
def _(d: Domain):
    pings = _stream(d).select("vehicle_id", "api_vehicle_timestamp")
    # replayed twice, as a feed that repeats its last report does
    twice = pings.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return d.spark.read.parquet(jobs.drain(jobs.stream_dedup(twice), *_places(d, "dedup")))


@query("stream_files_per_hour", """
SELECT CAST(collection_timestamp AS VARCHAR) AS hour_start, count(DISTINCT collection_timestamp) AS cycles FROM c_pings
WHERE collection_timestamp + INTERVAL 1 HOUR <= (SELECT max(collection_timestamp) - INTERVAL 10 MINUTE FROM c_pings)
GROUP BY collection_timestamp""")
def _(d: Domain):
    return d.spark.read.parquet(jobs.drain(jobs.cycles_per_hour(_stream(d)), *_places(d, "cycles")))


@query("stream_freshness", f"""
SELECT CAST(max(collection_timestamp) AS VARCHAR) AS latest_timestamp,
  {r(f"(epoch_us(TIMESTAMP '{NOW}') / 1e6 - epoch_us(max(collection_timestamp)) / 1e6) / 60e0", 1)} AS freshness_minutes,
  CASE WHEN (epoch_us(TIMESTAMP '{NOW}') / 1e6 - epoch_us(max(collection_timestamp)) / 1e6) / 60e0 <= 5 THEN 'FRESH' ELSE 'STALE' END AS freshness_status
FROM c_pings""")
def _(d: Domain):
    running = jobs.newest_per_feed(_stream(d), F.lit("vehicles"))
    table = jobs.drain_upserts(running, "feed", *_places(d, "fresh"))
    return health.freshness(d.spark.read.parquet(table), F.lit(NOW).cast("timestamp"))


def _late_files(d: Domain):
    """The pings in three arrivals, after each of which the stream over all files so far comes out:
    the first and second half of the days, and every 50th row late, in the last arrival."""
    path = scratch_path(d.spark, "late")
    part = F.when(F.col("event_id") % 50 == 0, 2).when(F.dayofmonth("collection_timestamp") > 15, 1).otherwise(0)
    pings = d.pings.withColumn("part", part)
    for k in range(3):
        pings.filter(F.col("part") == k).drop("part").write.mode("append").parquet(path)
        yield d.spark.readStream.schema(d.pings.schema).parquet(path)


@query("stream_bunching", "SELECT event_id, route_id, next_vehicle_id, distance_to_next_bus_km, bunching_severity FROM c_events")
def _(d: Domain):
    job = jobs.bunching_job(BOUND_SHAPE_KM, "bound_dist_km", CORRIDOR_KEYS)
    sink, checkpoint = _places(d, "bunching")
    for stream in _late_files(d):  # each drained at once, as one micro-batch
        jobs.upsert_slots(stream, job, f"{sink}-bronze", sink, checkpoint, slot="yyyy-MM-dd")
    return jobs.slot_results(d.spark, sink).select("event_id", "route_id", "next_vehicle_id", "distance_to_next_bus_km", "bunching_severity")


@query("stream_gaps", """
SELECT vehicle_id, CAST(min(t) AS VARCHAR) AS first_report, CAST(max(t) AS VARCHAR) AS last_report, count(*) AS reports
FROM (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY vehicle_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT vehicle_id, api_vehicle_timestamp AS t, coalesce(api_vehicle_timestamp
    >= lag(api_vehicle_timestamp) OVER (PARTITION BY vehicle_id ORDER BY api_vehicle_timestamp) + INTERVAL 2 HOUR, false) AS brk
  FROM c_pings WHERE vehicle_id IS NOT NULL))
GROUP BY vehicle_id, s HAVING max(t) + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(api_vehicle_timestamp)) - INTERVAL 10 MINUTE
  FROM c_pings WHERE vehicle_id IS NOT NULL)""")
def _(d: Domain):
    live = _stream(d).select("vehicle_id", "api_vehicle_timestamp")
    return d.spark.read.parquet(jobs.drain(jobs.reporting_sessions(live), *_places(d, "sessions")))


# --- models --------------------------------------------------------------------------------------------

_TREES = 300


def _features(d: Domain):
    return ml.ml_feature_table(sc.stress_scores_minmax(sc.stress_base(d.gold_priority)))


_NUM = ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), 0e0) AS {c}" for c in ml.FEATURES if c != "route_type_encoded")


@query("ml_feature_table", f"""
SELECT route_short_name, route_type, fifa_stress_score, fifa_risk_band, {_NUM},
  CAST(dense_rank() OVER (ORDER BY route_type) - 1 AS DOUBLE) AS route_type_encoded,
  CAST(fifa_stress_score >= 45 AS INT) AS fifa_high_risk FROM c_stress""")
def _(d: Domain):
    return _features(d)


#: The same models in SQL by another road: rows as lists per fold, and accelerated gradient steps to
#: the optimum of the penalised loss, which has one optimum only.
def _ml_sql(fold: str) -> str:
    z = ", ".join(
        f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0e0), 0e0)" for c in ml.FEATURES)
    return f"""
WITH RECURSIVE points AS (
  SELECT route_short_name AS route, route_type, fifa_stress_score, fifa_risk_band, fifa_high_risk AS label, {fold} AS fold, [1e0, {z}] AS x
  FROM (SELECT route_short_name, route_type, fifa_stress_score, fifa_risk_band, {_NUM},
          CAST(dense_rank() OVER (ORDER BY route_type) - 1 AS DOUBLE) AS route_type_encoded,
          CAST(fifa_stress_score >= 45 AS INT) AS fifa_high_risk FROM c_stress)
), folds AS (
  SELECT DISTINCT fold FROM points UNION ALL SELECT 'all rows'
), fitted AS (
  SELECT f.fold, x, label, count(*) OVER (PARTITION BY f.fold) / (2e0 * count(*) OVER (PARTITION BY f.fold, label)) AS w, route
  FROM folds f JOIN points r ON r.fold <> f.fold
), inputs AS (
  SELECT fold, list(x ORDER BY route) AS xs, list(CAST(label AS DOUBLE) ORDER BY route) AS ys, list(w ORDER BY route) AS ws,
         list_transform(range(1, {len(ml.FEATURES) + 2}), lambda j: list_transform(list(x ORDER BY route), lambda v: v[j])) AS cols,
         1e0 + sum(w * list_inner_product(x, x)) / 4e0 AS bound
  FROM fitted GROUP BY fold
), steps AS (
  SELECT 0 AS it, fold, list_transform(range({len(ml.FEATURES) + 1}), lambda j: 0e0) AS b, list_transform(range({len(ml.FEATURES) + 1}), lambda j: 0e0) AS y FROM inputs
  UNION ALL
  SELECT it + 1, fold, next, list_transform(next, lambda v, j: v + 0.9e0 * (v - b[j])) FROM (
    SELECT it, fold, b, list_transform(y, lambda v, j: v - (list_inner_product(cols[j], miss) + CASE WHEN j = 1 THEN 0e0 ELSE v END) / bound) AS next
    FROM (
      SELECT s.it, s.fold, s.b, s.y, d.cols, d.bound,
             list_transform(d.xs, lambda x, i: d.ws[i] * (1e0 / (1e0 + exp(-list_inner_product(x, s.y))) - d.ys[i])) AS miss
      FROM steps s JOIN inputs d USING (fold) WHERE s.it < 1500
    )
  )
), models AS (
  SELECT fold, b FROM steps WHERE it = 1500
), found AS (
  SELECT r.*, 1e0 / (1e0 + exp(-list_inner_product(r.x, m.b))) AS p, CAST(list_inner_product(r.x, m.b) > 0 AS INT) AS prediction
  FROM points r JOIN models m USING (fold)
), agreed AS (
  SELECT r.*, 1e0 / (1e0 + exp(-list_inner_product(r.x, m.b))) AS p, CAST(list_inner_product(r.x, m.b) > 0 AS INT) AS prediction
  FROM points r JOIN models m ON m.fold = 'all rows'
)
"""


_HASHED = _ml_sql("CAST(CAST(('0x' || substr(md5(route_short_name), 1, 8)) AS BIGINT) % 5 AS VARCHAR)")
_EACH = _ml_sql("route_short_name")
_ACCURACY = f"""SELECT 'LogisticRegression' AS model, 'classify high-risk' AS task, '%s' AS cv,
  {r("avg(CAST(prediction = label AS INT))", 3)} AS score, count(*) AS routes FROM found"""


@query("logit_cv", _HASHED + _ACCURACY % "hash folds")
def _(d: Domain):
    return ml.classification_scores(ml.logit_out_of_fold(ml.prepared(_features(d))), "LogisticRegression")


@query("logit_leave_one_out", _EACH + _ACCURACY % "leave one out")
def _(d: Domain):
    return ml.classification_scores(ml.logit_out_of_fold(ml.prepared(_features(d), folds=None)), "LogisticRegression")


@query("logit_class_report", _EACH + f"""
SELECT CAST(c AS DOUBLE) AS class, s AS support, {r("h / nullif(CAST(n AS DOUBLE), 0e0)", 3)} AS precision,
  {r("h / nullif(CAST(s AS DOUBLE), 0e0)", 3)} AS recall, {r("2e0 * h / nullif(CAST(s + n AS DOUBLE), 0e0)", 3)} AS f1
FROM (SELECT c, count(*) FILTER (WHERE label = c) AS s, count(*) FILTER (WHERE prediction = c) AS n,
        count(*) FILTER (WHERE label = c AND prediction = c) AS h
      FROM found, (SELECT unnest([0, 1]) AS c) GROUP BY c) WHERE s + n > 0""")
def _(d: Domain):
    return ml.class_report(ml.logit_out_of_fold(ml.prepared(_features(d), folds=None)))


@query("logit_coefficients", _HASHED + f"""
SELECT unnest({["intercept", *ml.FEATURES]}) AS feature, unnest(list_transform(b, lambda v: {r("v", 3)})) AS coefficient
FROM models WHERE fold = 'all rows'""")
def _(d: Domain):
    table = ml.logit_coefficients(ml.prepared(_features(d)))
    return table.select("feature", C.rnd(F.col("coefficient"), 3).alias("coefficient"))


@query("logit_agreement", _HASHED + f"""
SELECT route AS route_short_name, route_type, fifa_stress_score, fifa_risk_band, label AS fifa_high_risk,
  {r("p", 3)} AS logit_prob_high, prediction AS logit_pred_high,
  CASE WHEN prediction = label THEN 'agree' ELSE 'DISAGREE' END AS agreement FROM agreed""")
def _(d: Domain):
    return ml.logit_agreement(ml.prepared(_features(d)))


@query("rf_cv")
def _(d: Domain):
    return ml.classification_scores(ml.forest_out_of_fold(ml.prepared(_features(d)), ml.forest(_TREES)), "RandomForestClassifier")


@query("rf_regressor_cv")
def _(d: Domain):
    return ml.regression_scores(ml.forest_out_of_fold(ml.prepared(_features(d)), ml.forest_regressor(_TREES)))


@query("feature_importance")
def _(d: Domain):
    return ml.feature_importance(ml.prepared(_features(d)), _TREES)


@query("model_agreement")
def _(d: Domain):
    return ml.model_agreement(ml.prepared(_features(d)), _TREES)


@query("model_summary")
def _(d: Domain):
    return ml.model_summary(ml.prepared(_features(d)), _TREES)
