"""Silver, activity, cadence, quality and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseline.functions import columns as C
from pulseline.operators import activity as act
from pulseline.operators import geometry as geo
from pulseline.operators import network as net
from pulseline.operators import scoring as sco
from pulseline.operators import silver as sil
from pulseline.plans.domain import Domain
from pulseline.plans.registry import CTES, cte, div, gavg, pct, query, r

_PING = ("event_id, CAST(collection_timestamp AS VARCHAR) AS collection_timestamp, "
         "CAST(api_vehicle_timestamp AS VARCHAR) AS api_vehicle_timestamp, entity_id, vehicle_id, route_id, trip_id, "
         "latitude, longitude, bearing, speed")
_SEEN = "CAST(min(collection_timestamp) AS VARCHAR) AS first_seen, CAST(max(collection_timestamp) AS VARCHAR) AS last_seen"
_VALID = "latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)"

cte("c_timed", """
SELECT *, strftime(collection_timestamp, '%Y-%m-%d') AS date, CAST(extract(hour FROM collection_timestamp) AS INT) AS hour
FROM c_pings""")
cte("c_reported", """
SELECT *, strftime(api_vehicle_timestamp, '%Y-%m-%d') AS date, CAST(extract(hour FROM api_vehicle_timestamp) AS INT) AS hour
FROM c_pings""")
cte("c_counts", f"""
SELECT route_id, count(vehicle_id) AS total_records, count(DISTINCT vehicle_id) AS unique_vehicles,
  {r(div('count(vehicle_id)', 'count(DISTINCT vehicle_id)'))} AS records_per_vehicle
FROM c_pings WHERE route_id IS NOT NULL GROUP BY route_id""")
cte("c_activity", f"""
SELECT route_id, count(vehicle_id) AS total_records, count(DISTINCT vehicle_id) AS unique_vehicles,
  count(DISTINCT trip_id) AS unique_trips, count(DISTINCT date) AS days_active, count(DISTINCT hour) AS active_hours,
  {_SEEN}, {r(div('count(vehicle_id)', 'count(DISTINCT vehicle_id)'))} AS records_per_vehicle
FROM c_timed WHERE route_id IS NOT NULL GROUP BY route_id""")
cte("c_daily", f"""
SELECT date, count(vehicle_id) AS total_records, count(DISTINCT vehicle_id) AS unique_vehicles,
  count(DISTINCT route_id) AS unique_routes, count(DISTINCT trip_id) AS unique_trips,
  count(DISTINCT hour) AS active_hours, {_SEEN},
  {r(div('count(vehicle_id)', 'count(DISTINCT vehicle_id)'))} AS records_per_vehicle, dayname(CAST(date AS DATE)) AS day_of_week
FROM c_timed GROUP BY date""")
cte("c_coverage", f"""
SELECT route_id, count(*) AS total_records, {_SEEN}, count(DISTINCT hour) AS active_hours,
  {r("(epoch_us(max(collection_timestamp)) / 1e6 - epoch_us(min(collection_timestamp)) / 1e6) / 3600e0")} AS active_span_hours
FROM c_timed WHERE route_id IS NOT NULL AND collection_timestamp IS NOT NULL GROUP BY route_id""")
cte("c_stability", f"""
SELECT route_id, count(*) AS days_active, {r('avg(n)', 1)} AS mean_daily_records,
  {r('coalesce(stddev_samp(n), 0e0)', 1)} AS std_daily_records, min(n) AS min_daily_records, max(n) AS max_daily_records,
  CAST(sum(n) AS BIGINT) AS total_records, {r('coalesce(stddev_samp(n), 0e0) / avg(n)', 4)} AS cv_daily_records,
  count(*) >= 4 AS is_persistent
FROM (SELECT route_id, date, count(*) AS n FROM c_timed WHERE route_id IS NOT NULL GROUP BY ALL) GROUP BY route_id""")
cte("c_vehicles", f"""
SELECT v.*, p.primary_route FROM (
  SELECT vehicle_id, count(*) AS total_records, count(DISTINCT date) AS days_active, count(DISTINCT route_id) AS routes_served,
    {_SEEN}, {r(div('count(*)', 'count(DISTINCT date)'))} AS records_per_active_day
  FROM c_timed WHERE vehicle_id IS NOT NULL GROUP BY vehicle_id) v
LEFT JOIN (SELECT vehicle_id, first(route_id ORDER BY n DESC, route_id) AS primary_route FROM (
    SELECT vehicle_id, route_id, count(*) AS n FROM c_timed WHERE vehicle_id IS NOT NULL AND route_id IS NOT NULL GROUP BY ALL)
  GROUP BY vehicle_id) p USING (vehicle_id)""")
cte("c_heatmap", """
SELECT route_id, hour, count(vehicle_id) AS records, count(DISTINCT vehicle_id) AS unique_vehicles
FROM c_reported WHERE route_id IS NOT NULL GROUP BY route_id, hour""")
cte("c_intervals", """
SELECT vehicle_id, api_vehicle_timestamp, (epoch_us(api_vehicle_timestamp) - epoch_us(p)) / 1e6 AS interval_seconds
FROM (SELECT vehicle_id, api_vehicle_timestamp,
        lag(api_vehicle_timestamp) OVER (PARTITION BY vehicle_id ORDER BY api_vehicle_timestamp) AS p
      FROM c_pings WHERE vehicle_id IS NOT NULL AND api_vehicle_timestamp IS NOT NULL)
WHERE epoch_us(api_vehicle_timestamp) > epoch_us(p)""")
cte("c_speed", f"""
SELECT route_id, count(*) AS sample_count,
  {r('avg(speed)', 3)} AS mean_speed_mps, {r('avg(speed) * 3.6e0')} AS mean_speed_kmh,
  {r('median(speed)', 3)} AS median_speed_mps, {r('median(speed) * 3.6e0')} AS median_speed_kmh,
  {r('quantile_cont(speed, 0.95)', 3)} AS p95_speed_mps, {r('quantile_cont(speed, 0.95) * 3.6e0')} AS p95_speed_kmh,
  {r('max(speed)', 3)} AS max_speed_mps, {r('max(speed) * 3.6e0')} AS max_speed_kmh
FROM c_pings WHERE route_id IS NOT NULL AND speed IS NOT NULL GROUP BY route_id""")


# --- scans as queries ---------------------------------------------------------------------------

@query("ingest_route_filter", f"SELECT {_PING} FROM c_pings WHERE route_id IN ('4', '10', '15')")
def _(d: Domain):
    return sil.route_allow_list(d.raw_pings, ["4", "10", "15"])


# --- silver --------------------------------------------------------------------------------------

@query("silver_positions", f"SELECT {_PING}, CAST(service_date AS VARCHAR) AS service_date, hour_of_day FROM c_silver")
def _(d: Domain):
    return d.silver.drop("direction_id", "shape_id", "bound_dist_km")


@query("valid_coords", f"SELECT {_PING} FROM c_pings WHERE {_VALID}")
def _(d: Domain):
    return sil.valid_coords(d.raw_pings)


@query("time_columns", "SELECT event_id, date, hour, CAST(isodow(collection_timestamp) - 1 AS INT) AS day_of_week FROM c_timed")
def _(d: Domain):
    return d.timed.select("event_id", "date", "hour", "day_of_week")


@query("local_hour", "SELECT event_id, hour, (hour - 7 + 24) % 24 AS local_hour FROM c_reported")
def _(d: Domain):
    return sil.with_local_hour(d.reported).select("event_id", "hour", "local_hour")


@query("silver_enriched", """
SELECT event_id, CAST(collection_timestamp AS VARCHAR) AS collection_timestamp, vehicle_id, route_id, trip_id,
  direction_id, shape_id, service_id FROM c_enriched""")
def _(d: Domain):
    return d.silver_enriched.select("event_id", "collection_timestamp", "vehicle_id", "route_id", "trip_id",
                                    "direction_id", "shape_id", "service_id")


@query("join_coverage", f"""
SELECT count(*) AS silver_rows, count(shape_id) AS matched_shape_rows, count(direction_id) AS matched_direction_rows,
  count(service_id) AS matched_trip_rows, {pct('count(shape_id)', 'count(*)')} AS shape_match_percentage,
  {pct('count(direction_id)', 'count(*)')} AS direction_match_percentage,
  {pct('count(service_id)', 'count(*)')} AS trip_match_percentage FROM c_enriched""")
def _(d: Domain):
    return sil.join_coverage(d.silver_enriched)


@query("unmatched_labels", """
SELECT count(*) AS routes_in_metrics, count(r.route_id) AS routes_labelled, count(*) FILTER (r.route_id IS NULL) AS unmatched_routes
FROM c_counts a LEFT JOIN c_routes r ON a.route_id = r.route_id""")
def _(d: Domain):
    return sil.unmatched_labels(d.counts, d.routes)


# --- foundation ------------------------------------------------------------------------------------

@query("route_hourly_summary", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, route_id, hour_of_day, count(*) AS total_observations,
  count(DISTINCT vehicle_id) AS unique_vehicles, count(DISTINCT trip_id) AS unique_trips, {_SEEN}
FROM c_silver GROUP BY ALL""")
def _(d: Domain):
    return sco.route_hourly_summary(d.silver)


@query("route_daily_summary", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, route_id, count(*) AS total_observations,
  count(DISTINCT vehicle_id) AS unique_vehicles, count(DISTINCT trip_id) AS unique_trips,
  count(DISTINCT hour_of_day) AS observed_service_hours, {_SEEN}
FROM c_silver WHERE route_id IS NOT NULL GROUP BY service_date, route_id""")
def _(d: Domain):
    return sco.route_daily_summary(d.silver)


@query("route_quality_summary", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM c_quality")
def _(d: Domain):
    return d.quality


@query("raw_quality_summary", f"""
SELECT date, route_id, count(*) AS total_observations, count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_location_rows,
  count(*) FILTER (vehicle_id IS NULL) AS missing_vehicle_rows,
  {pct('count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL AND vehicle_id IS NOT NULL AND route_id IS NOT NULL)', 'count(*)')}
    AS valid_row_percentage FROM c_timed GROUP BY date, route_id""")
def _(d: Domain):
    out = sco.route_quality_summary(d.timed.withColumnRenamed("date", "service_date"))
    return out.select(F.col("service_date").alias("date"), "route_id", "total_observations", "missing_location_rows",
                      "missing_vehicle_rows", "valid_row_percentage")


@query("route_hourly_stability", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM c_stability_hours")
def _(d: Domain):
    return d.stability_hours


@query("coverage_stability_band", """
SELECT CAST(service_date AS VARCHAR) AS service_date, route_id, coverage_band, stability_band FROM c_stability_hours""")
def _(d: Domain):
    return d.stability_hours.select("service_date", "route_id", "coverage_band", "stability_band")


@query("route_eligibility", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM c_eligibility")
def _(d: Domain):
    return d.eligibility


@query("eligibility_status", "SELECT CAST(service_date AS VARCHAR) AS service_date, route_id, eligibility_status FROM c_eligibility")
def _(d: Domain):
    return d.eligibility.select("service_date", "route_id", "eligibility_status")


@query("eligibility_rollups", f"""
SELECT 'eligibility_status' AS rollup, eligibility_status AS label, CAST(count(*) AS DOUBLE) AS value FROM c_eligibility GROUP BY ALL
UNION ALL SELECT 'coverage_band', coverage_band, CAST(count(*) AS DOUBLE) FROM c_eligibility GROUP BY ALL
UNION ALL SELECT 'stability_band', stability_band, CAST(count(*) AS DOUBLE) FROM c_eligibility GROUP BY ALL
UNION ALL SELECT 'valid_row_percentage', 'min', {r('min(valid_row_percentage)')} FROM c_quality
UNION ALL SELECT 'valid_row_percentage', 'avg', {r(gavg('valid_row_percentage', 2))} FROM c_quality
UNION ALL SELECT 'valid_row_percentage', 'max', {r('max(valid_row_percentage)')} FROM c_quality""")
def _(d: Domain):
    return sco.eligibility_rollups(d.eligibility, d.quality)


@query("eligible_days", """
SELECT route_id, count(*) AS route_days FROM c_bound_eligibility WHERE eligibility_status = 'Eligible' GROUP BY route_id""")
def _(d: Domain):
    return sco.eligible_days(d.bound_eligibility)


@query("latest_eligible_date", """
SELECT s.event_id, s.route_id, CAST(s.service_date AS VARCHAR) AS service_date FROM c_silver s JOIN (
  SELECT route_id, max(service_date) AS service_date FROM c_bound_eligibility WHERE eligibility_status = 'Eligible' GROUP BY route_id) e
ON s.route_id = e.route_id AND s.service_date = e.service_date""")
def _(d: Domain):
    return sco.latest_eligible_date(d.silver, d.bound_eligibility).select("event_id", "route_id", "service_date")


@query("volatile_and_stable_days", """
SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM (
(SELECT 'most_volatile' AS listing, service_date, route_id, observed_service_hours, total_observations, observation_cv,
   coverage_band, stability_band FROM c_stability_hours ORDER BY observation_cv DESC, service_date, route_id LIMIT 20)
UNION ALL
(SELECT 'best_high_coverage', service_date, route_id, observed_service_hours, total_observations, observation_cv,
   coverage_band, stability_band FROM c_stability_hours WHERE coverage_band = 'High Coverage'
 ORDER BY observation_cv, service_date, route_id LIMIT 20))""")
def _(d: Domain):
    return sco.volatile_and_stable_days(d.stability_hours)


# --- activity ----------------------------------------------------------------------------------------

@query("route_vehicle_counts", "SELECT * FROM c_counts")
def _(d: Domain):
    return d.counts


@query("route_row_counts", f"""
SELECT route_id, count(*) AS total_records, count(DISTINCT vehicle_id) AS unique_vehicles,
  {r(div('count(*)', 'count(DISTINCT vehicle_id)'))} AS records_per_vehicle FROM c_pings WHERE route_id IS NOT NULL GROUP BY route_id""")
def _(d: Domain):
    return act.route_vehicle_counts(d.raw_pings, count_rows=True)


@query("report_intervals", "SELECT vehicle_id, CAST(api_vehicle_timestamp AS VARCHAR) AS api_vehicle_timestamp, interval_seconds FROM c_intervals")
def _(d: Domain):
    return act.report_intervals(d.raw_pings)


@query("gps_update_frequency", f"""
SELECT vehicle_id, count(*) AS report_count, {r('median(interval_seconds)', 1)} AS median_interval_sec,
  {r('avg(interval_seconds)', 1)} AS mean_interval_sec, {r('max(interval_seconds)', 1)} AS max_interval_sec
FROM c_intervals GROUP BY vehicle_id""")
def _(d: Domain):
    return act.gps_update_frequency(d.raw_pings)


@query("derived_speed", f"""
SELECT vehicle_id, CAST(api_vehicle_timestamp AS VARCHAR) AS api_vehicle_timestamp, {r('m', 1)} AS moved_m, {r('m / s', 3)} AS speed_mps
FROM (SELECT *, 2e0 * 6371000e0 * asin(sqrt(least(1e0, power(sin((radians(latitude) - radians(plat)) / 2), 2)
          + cos(radians(plat)) * cos(radians(latitude)) * power(sin((radians(longitude) - radians(plon)) / 2), 2)))) AS m,
        (epoch_us(api_vehicle_timestamp) - epoch_us(pts)) / 1e6 AS s
      FROM (SELECT vehicle_id, api_vehicle_timestamp, latitude, longitude, lag(latitude) OVER w AS plat,
              lag(longitude) OVER w AS plon, lag(api_vehicle_timestamp) OVER w AS pts
            FROM (SELECT vehicle_id, api_vehicle_timestamp, latitude, longitude FROM c_pings
                  WHERE vehicle_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY vehicle_id, api_vehicle_timestamp ORDER BY latitude, longitude) = 1)
            WINDOW w AS (PARTITION BY vehicle_id ORDER BY api_vehicle_timestamp)))
WHERE pts IS NOT NULL""")
def _(d: Domain):
    return act.derived_speed(d.raw_pings)


@query("route_speed_stats", "SELECT * FROM c_speed")
def _(d: Domain):
    return act.route_speed_stats(d.raw_pings)


@query("route_coverage", "SELECT * FROM c_coverage")
def _(d: Domain):
    return d.coverage


@query("stationary_vehicles", f"""
SELECT v.*, p.primary_route FROM (
  SELECT vehicle_id, count(*) AS total_reports, count(*) FILTER (speed < 0.5e0) AS stationary_reports,
    {r(div('count(*) FILTER (speed < 0.5e0)', 'count(*)') + ' * 1e2')} AS pct_stationary
  FROM c_pings WHERE vehicle_id IS NOT NULL AND speed IS NOT NULL GROUP BY vehicle_id) v
LEFT JOIN (SELECT vehicle_id, first(route_id ORDER BY n DESC, route_id) AS primary_route FROM (
    SELECT vehicle_id, route_id, count(*) AS n FROM c_pings WHERE vehicle_id IS NOT NULL AND speed IS NOT NULL
      AND route_id IS NOT NULL GROUP BY ALL) GROUP BY vehicle_id) p USING (vehicle_id)""")
def _(d: Domain):
    return act.stationary_vehicles(d.raw_pings)


@query("zero_speed_share", f"""
SELECT vehicle_id, count(*) AS total_records, count(*) FILTER (speed = 0) AS zero_speed_records, {r('avg(speed)', 4)} AS mean_speed,
  {r(div('count(*) FILTER (speed = 0)', 'count(*)'), 4)} AS zero_speed_share
FROM c_pings WHERE vehicle_id IS NOT NULL GROUP BY vehicle_id""")
def _(d: Domain):
    return act.zero_speed_share(d.raw_pings)


@query("hourly_distribution", """
SELECT hour, count(vehicle_id) AS total_records, count(DISTINCT vehicle_id) AS unique_vehicles, count(DISTINCT route_id) AS unique_routes
FROM c_reported WHERE hour IS NOT NULL GROUP BY hour""")
def _(d: Domain):
    return act.hourly_distribution(d.reported)


cte("c_hourly_network", f"""
SELECT hour, count(*) AS days_observed, {r('avg(a)', 1)} AS avg_records, {r('avg(b)', 1)} AS avg_unique_vehicles,
  {r('avg(c)', 1)} AS avg_unique_routes, min(a) AS min_records, max(a) AS max_records
FROM (SELECT date, hour, count(vehicle_id) AS a, count(DISTINCT vehicle_id) AS b, count(DISTINCT route_id) AS c
      FROM c_reported GROUP BY date, hour) GROUP BY hour""")


@query("hourly_network_activity", "SELECT * FROM c_hourly_network")
def _(d: Domain):
    return act.hourly_network_activity(d.reported)


@query("route_hour_heatmap", "SELECT * FROM c_heatmap")
def _(d: Domain):
    return d.heatmap


@query("vehicle_activity", "SELECT * FROM c_vehicles")
def _(d: Domain):
    return d.vehicles


_NULLS = ", ".join(
    f"{r(f'avg(CAST({c} IS NULL AS INT)) * 1e2')} AS null_pct_{c}"
    for c in ("collection_timestamp", "api_vehicle_timestamp", "entity_id", "vehicle_id", "route_id", "trip_id",
              "latitude", "longitude", "bearing", "speed")
)


@query("daily_quality_fingerprint", f"""
SELECT date, count(*) AS row_count, {_NULLS},
  {r('avg(CAST(coalesce(latitude = 0, false) OR coalesce(longitude = 0, false) AS INT)) * 1e2')} AS invalid_coord_pct,
  {r('avg(CAST(speed IS DISTINCT FROM 0e0 AS INT)) * 1e2')} AS speed_populated_pct,
  {r('avg(CAST(bearing IS DISTINCT FROM 0e0 AS INT)) * 1e2')} AS bearing_populated_pct
FROM c_timed GROUP BY date""")
def _(d: Domain):
    return act.daily_quality_fingerprint(d.timed)


@query("route_daily_stability", "SELECT * FROM c_stability")
def _(d: Domain):
    return d.stability


# a network with unlike routes, on which the published thresholds keep some and drop others
cte("c_uneven", """
SELECT * REPLACE (CASE WHEN CAST(route_id AS INT) % 5 = 2 AND vehicle_id IS NOT NULL THEN concat('U', event_id % 2) ELSE vehicle_id END AS vehicle_id)
FROM c_pings WHERE NOT coalesce(CAST(route_id AS INT) % 5 = 1 AND extract(hour FROM collection_timestamp) > 4, false)
  AND NOT coalesce(CAST(route_id AS INT) % 5 = 3 AND extract(day FROM collection_timestamp) > 10 AND event_id % 6 <> 0, false)""")
cte("c_uneven_timed", CTES["c_timed"].replace("c_pings", "c_uneven"))
cte("c_uneven_counts", CTES["c_counts"].replace("c_pings", "c_uneven"))
cte("c_uneven_coverage", CTES["c_coverage"].replace("c_timed", "c_uneven_timed"))
cte("c_uneven_stability", CTES["c_stability"].replace("c_timed", "c_uneven_timed"))


@query("outlier_routes", """
SELECT *, 'CV > 0.5: daily record count varies more than expected for a persistent route' AS flag_reason
FROM c_uneven_stability WHERE is_persistent AND cv_daily_records > 0.5e0""")
def _(d: Domain):
    return act.outlier_routes(act.route_daily_stability(d.uneven_timed))


@query("daily_summary", "SELECT * FROM c_daily")
def _(d: Domain):
    return d.daily


@query("route_activity", "SELECT * FROM c_activity")
def _(d: Domain):
    return d.activity


@query("vehicle_report_distribution", f"""
SELECT DISTINCT total_records, count(*) OVER (PARTITION BY total_records) AS vehicles,
  {r('cume_dist() OVER (ORDER BY total_records) * 1e2', 4)} AS cumulative_pct_of_fleet FROM c_vehicles""")
def _(d: Domain):
    return act.vehicle_report_distribution(d.vehicles)


@query("vehicle_report_summary", f"""
SELECT count(*) AS fleet_size, {r('median(total_records)')} AS median_records, {r('avg(total_records)', 1)} AS mean_records,
  count(*) FILTER (total_records < 10) AS under_10_records, count(*) FILTER (total_records >= 300) AS at_least_300_records
FROM c_vehicles""")
def _(d: Domain):
    return act.vehicle_report_summary(d.vehicles)


@query("coverage_histogram", f"""
SELECT active_hours, count(*) AS routes, {r(div('count(*)', 'sum(count(*)) OVER ()'), 4)} AS share_of_routes,
  active_hours = max(active_hours) OVER () AS is_full_coverage, active_hours <= 2 AS is_brief FROM c_coverage GROUP BY active_hours""")
def _(d: Domain):
    return act.coverage_histogram(d.coverage)


@query("brief_routes", "SELECT route_id, active_hours, total_records FROM c_uneven_coverage WHERE active_hours <= 2")
def _(d: Domain):
    return act.brief_routes(act.route_coverage(d.uneven_timed)).select("route_id", "active_hours", "total_records")


@query("small_fleet_outliers", "SELECT * FROM c_uneven_counts WHERE unique_vehicles <= 2 AND total_records >= 100")
def _(d: Domain):
    return act.small_fleet_outliers(act.route_vehicle_counts(d.tables.uneven_pings()))


@query("high_intensity_routes", f"""
SELECT c.*, {r('m.a')} AS network_median, {r('m.b')} AS network_p95 FROM c_counts c,
  (SELECT median(records_per_vehicle) AS a, quantile_cont(records_per_vehicle, 0.95) AS b FROM c_counts) m
WHERE c.records_per_vehicle > m.b""")
def _(d: Domain):
    return act.high_intensity_routes(d.counts)


@query("top15_lists", """
(SELECT 'records' AS listing, * FROM c_counts ORDER BY total_records DESC, route_id LIMIT 15) UNION ALL
(SELECT 'vehicles', * FROM c_counts ORDER BY unique_vehicles DESC, route_id LIMIT 15) UNION ALL
(SELECT 'density', * FROM c_counts WHERE unique_vehicles >= 5 ORDER BY records_per_vehicle DESC, route_id LIMIT 15)""")
def _(d: Domain):
    return act.top_lists(d.counts)


@query("window_span", f"""
SELECT a.*, b.* FROM (SELECT min(first_seen) AS first_seen, max(last_seen) AS last_seen,
    {r("(epoch_us(CAST(max(last_seen) AS TIMESTAMP)) / 1e6 - epoch_us(CAST(min(first_seen) AS TIMESTAMP)) / 1e6) / 3600e0")} AS span_hours
  FROM c_coverage) a,
 (SELECT count(*) FILTER (mean_speed_mps + median_speed_mps + max_speed_mps > 0) AS routes_with_speed,
    count(*) AS routes_with_samples, max(max_speed_mps) AS max_speed_mps FROM c_speed) b""")
def _(d: Domain):
    return act.window_span(d.coverage, act.route_speed_stats(d.raw_pings))


# --- maps ---------------------------------------------------------------------------------------------

cte("c_positions", f"""
SELECT p.*, r.route_short_name, r.route_long_name, r.route_type, r.mode, r.bus_subtype,
  (CAST(extract(hour FROM collection_timestamp) AS INT) - 7 + 24) % 24 AS local_hour
FROM c_pings p LEFT JOIN c_dim r ON p.route_id = r.route_id WHERE {_VALID}""")


@query("positions_enriched", """
SELECT event_id, route_id, route_short_name, route_long_name, route_type, mode, bus_subtype, local_hour FROM c_positions""")
def _(d: Domain):
    return sil.positions_enriched(d.raw_pings, d.dim).select(
        "event_id", "route_id", "route_short_name", "route_long_name", "route_type", "mode", "bus_subtype", "local_hour")


@query("mode_slices", """
SELECT slice, count(*) AS positions, count(DISTINCT route_id) AS routes FROM (
  SELECT route_id, unnest(list_filter([CASE WHEN mode IS NOT NULL THEN 'multimodal' END, CASE WHEN mode = 'Bus' THEN 'bus' END,
    CASE WHEN mode = 'SkyTrain' THEN 'skytrain' END, CASE WHEN route_long_name = 'Expo Line' THEN 'expo_line' END,
    CASE WHEN route_long_name = 'Canada Line' THEN 'canada_line' END, CASE WHEN mode = 'SeaBus' THEN 'seabus' END,
    CASE WHEN mode = 'West Coast Express' THEN 'west_coast_express' END, CASE WHEN bus_subtype = 'RapidBus' THEN 'rapidbus' END,
    CASE WHEN bus_subtype = 'NightBus' THEN 'nightbus' END], lambda x: x IS NOT NULL)) AS slice FROM c_positions) GROUP BY slice""")
def _(d: Domain):
    return sil.slice_counts(sil.positions_enriched(d.raw_pings, d.dim))


@query("mode_slice_rapidbus", "SELECT event_id, route_short_name, latitude, longitude FROM c_positions WHERE bus_subtype = 'RapidBus'")
def _(d: Domain):
    return sil.mode_slice(sil.positions_enriched(d.raw_pings, d.dim), "rapidbus").select(
        "event_id", "route_short_name", "latitude", "longitude")


@query("pm_peak_positions", "SELECT event_id, route_id, local_hour FROM c_positions WHERE local_hour IN (15, 16, 17)")
def _(d: Domain):
    return sil.pm_peak_positions(sil.positions_enriched(d.raw_pings, d.dim)).select("event_id", "route_id", "local_hour")


@query("density_grid", f"""
SELECT CAST(floor(latitude / 0.01e0) AS BIGINT) AS cell_lat, CAST(floor(longitude / 0.01e0) AS BIGINT) AS cell_lon, count(*) AS points
FROM c_pings WHERE {_VALID} GROUP BY ALL""")
def _(d: Domain):
    return geo.density_grid(sil.valid_coords(d.raw_pings))


@query("map_extent", f"""
SELECT {r('avg(latitude)', 4)} AS centre_lat, {r('avg(longitude)', 4)} AS centre_lon, min(latitude) AS min_lat, max(latitude) AS max_lat,
  min(longitude) AS min_lon, max(longitude) AS max_lon FROM c_pings WHERE {_VALID}""")
def _(d: Domain):
    return geo.map_extent(sil.valid_coords(d.raw_pings))
