"""Spacing, bunching, scoring and priority queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseline.functions import columns as C
from pulseline.operators import bunching as bun
from pulseline.operators import geometry as geo
from pulseline.operators import scoring as sco
from pulseline.operators import spacing as spc
from pulseline.plans.domain import Domain
from pulseline.plans.registry import gavg, pct, query, r, txt
from pulseline.plans.tables_sql import GAPS, SEVERITIES, scores_sql

_PAIR = ["event_id", "route_id", "collection_timestamp", "direction_id", "shape_id", "vehicle_id", "bus_rank",
         "approx_shape_dist_traveled", "next_vehicle_id", "next_shape_dist", "distance_to_next_bus_km"]
_PAIR_SQL = ("event_id, route_id, CAST(collection_timestamp AS VARCHAR) AS collection_timestamp, direction_id, "
             "shape_id, vehicle_id, bus_rank, approx_shape_dist_traveled, next_vehicle_id, next_shape_dist, "
             "distance_to_next_bus_km")


@query("bus_rank", """
SELECT event_id, route_id, direction_id, shape_id, row_number() OVER (
  PARTITION BY route_id, collection_timestamp, direction_id, shape_id
  ORDER BY approx_shape_dist_traveled, event_id) AS bus_rank FROM c_in_service""")
def _(d: Domain):
    return spc.bus_rank(d.in_service).select("event_id", "route_id", "direction_id", "shape_id", "bus_rank")


@query("observed_headways", f"SELECT {_PAIR_SQL} FROM c_headways_net")
def _(d: Domain):
    return d.network_headways.select(*_PAIR)


@query("observed_headways_corridor", f"SELECT {_PAIR_SQL} FROM c_headways")
def _(d: Domain):
    return d.headways.select(*_PAIR)


@query("observed_headways_v1", f"""
SELECT {_PAIR_SQL}, next_latitude, next_longitude FROM (
  SELECT *, {r('next_shape_dist - approx_shape_dist_traveled', 4)} AS distance_to_next_bus_km FROM (
    SELECT *, row_number() OVER w AS bus_rank, lead(vehicle_id) OVER w AS next_vehicle_id,
      lead(approx_shape_dist_traveled) OVER w AS next_shape_dist,
      lead(latitude) OVER w AS next_latitude, lead(longitude) OVER w AS next_longitude
    FROM c_placed WINDOW w AS (PARTITION BY collection_timestamp, direction_id, shape_id
                               ORDER BY approx_shape_dist_traveled, event_id)))
WHERE next_vehicle_id IS NOT NULL AND next_shape_dist >= approx_shape_dist_traveled""")
def _(d: Domain):
    return spc.observed_headways_basic(d.placed, spc.CORRIDOR_KEYS).select(*_PAIR, "next_latitude", "next_longitude")


@query("terminal_buffer", "SELECT event_id, shape_id, approx_shape_dist_traveled FROM c_in_service")
def _(d: Domain):
    return d.in_service.select("event_id", "shape_id", "approx_shape_dist_traveled")


@query("severity_band", "SELECT event_id, distance_to_next_bus_km, CASE WHEN distance_to_next_bus_km <= 0.1e0 THEN 'Severe' "
       "WHEN distance_to_next_bus_km <= 0.25e0 THEN 'High' WHEN distance_to_next_bus_km <= 0.5e0 THEN 'Moderate' "
       "ELSE 'Normal' END AS severity FROM c_headways")
def _(d: Domain):
    return d.headways.select("event_id", "distance_to_next_bus_km", C.severity("distance_to_next_bus_km").alias("severity"))


@query("peak_period", "SELECT event_id, hour_of_day, CASE WHEN hour_of_day BETWEEN 7 AND 9 THEN 'AM Peak' WHEN hour_of_day "
       "BETWEEN 15 AND 18 THEN 'PM Peak' ELSE 'Off Peak' END AS peak_period FROM (SELECT event_id, "
       "CAST(extract(hour FROM api_vehicle_timestamp) AS INT) AS hour_of_day FROM c_pings)")
def _(d: Domain):
    h = F.hour("api_vehicle_timestamp")
    return d.pings.select("event_id", h.alias("hour_of_day"), C.peak_period(h).alias("peak_period"))


@query("segment_bin", "SELECT event_id, floor(bound_dist_km / 0.5e0) * 0.5e0 AS route_segment_km FROM c_pings")
def _(d: Domain):
    return d.pings.select("event_id", C.segment_start("bound_dist_km").alias("route_segment_km"))


@query("bunching_events", f"SELECT {_PAIR_SQL}, CAST(service_date AS VARCHAR) AS service_date, bunching_severity, peak_period, "
       "hour_of_day, route_segment_km FROM c_events")
def _(d: Domain):
    return d.events.select(*_PAIR, F.to_date("collection_timestamp").alias("service_date"),
                           "bunching_severity", "peak_period", "hour_of_day", "route_segment_km")


@query("headway_summary", f"""
SELECT count(*) AS spacing_rows, count(DISTINCT collection_timestamp) AS timestamps, count(DISTINCT vehicle_id) AS vehicles,
  {r(gavg('distance_to_next_bus_km', 4), 3)} AS avg_km, {r('median(distance_to_next_bus_km)', 3)} AS median_km,
  {r('min(distance_to_next_bus_km)', 3)} AS min_km, {r('max(distance_to_next_bus_km)', 3)} AS max_km FROM c_headways""")
def _(d: Domain):
    return spc.headway_summary(d.headways)


@query("close_spacing_counts", """
SELECT count(*) FILTER (distance_to_next_bus_km <= 0.5e0) AS events_under_500m,
  count(*) FILTER (distance_to_next_bus_km <= 0.25e0) AS events_under_250m,
  count(*) FILTER (distance_to_next_bus_km <= 0.1e0) AS events_under_100m FROM c_headways""")
def _(d: Domain):
    return spc.close_spacing_counts(d.headways)


@query("headway_by_shape", f"""
SELECT direction_id, shape_id, any_value(shape_length_km) AS shape_length_km, count(*) AS spacing_rows,
  count(DISTINCT vehicle_id) AS vehicles, {r('median(distance_to_next_bus_km)', 3)} AS median_gap_km,
  count(*) FILTER (distance_to_next_bus_km <= 0.25e0) AS events_under_250m
FROM c_headways GROUP BY direction_id, shape_id""")
def _(d: Domain):
    return spc.headway_by_shape(d.headways)


@query("bunching_summary", f"""
SELECT CAST(service_date AS VARCHAR) AS service_date, route_id, {SEVERITIES},
  count(*) FILTER (peak_period = 'AM Peak') AS am_peak_events,
  count(*) FILTER (peak_period = 'PM Peak') AS pm_peak_events,
  count(*) FILTER (peak_period = 'Off Peak') AS off_peak_events, {GAPS},
  {r('min(distance_to_next_bus_km)', 3)} AS closest_gap_km,
  count(DISTINCT vehicle_id) AS vehicles_involved, count(DISTINCT route_segment_km) AS affected_segments
FROM c_events GROUP BY service_date, route_id""")
def _(d: Domain):
    return bun.bunching_summary(d.events)


@query("bunching_hotspots", "SELECT * FROM c_hotspots")
def _(d: Domain):
    return d.hotspots


@query("hourly_bunching", "SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM c_hourly")
def _(d: Domain):
    return d.hourly


@query("reliability_scores", "SELECT * FROM c_scores")
def _(d: Domain):
    return d.scores


@query("reliability_scores_by_day",
       f"SELECT * REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM ({scores_sql('service_date, route_id')})")
def _(d: Domain):
    return sco.reliability_scores(d.headways.withColumn("service_date", F.to_date("collection_timestamp")))


@query("route_type_summary", f"""
SELECT route_type, count(*) AS route_count, {r(gavg('reliability_score', 2))} AS avg_reliability_score,
  {r('min(reliability_score)')} AS worst_reliability_score, {r('max(reliability_score)')} AS best_reliability_score,
  {r(gavg('bunching_rate_pct', 2))} AS avg_bunching_rate_pct,
  {r(gavg('severe_bunching_rate_pct', 2))} AS avg_severe_bunching_rate_pct,
  {r(gavg('peak_bunching_share_pct', 2))} AS avg_peak_bunching_share_pct,
  CAST(sum(total_bunching_events) AS BIGINT) AS total_bunching_events, CAST(sum(severe_events) AS BIGINT) AS total_severe_events
FROM c_scores GROUP BY route_type""")
def _(d: Domain):
    return sco.route_type_summary(d.scores)


@query("corridor_priority", "SELECT * FROM c_priority")
def _(d: Domain):
    return d.priority


@query("stop_reference", "SELECT * FROM c_stop_ref")
def _(d: Domain):
    return d.stop_ref


@query("stop_before_segment", "SELECT * FROM c_stop_before")
def _(d: Domain):
    return geo.stop_before_segment(d.hotspots, d.stop_ref)


@query("stop_after_segment", "SELECT * FROM c_stop_after")
def _(d: Domain):
    return geo.stop_after_segment(d.hotspots, d.stop_ref)


@query("hotspots_with_stops", "SELECT * FROM c_hot_stops")
def _(d: Domain):
    return d.hot_stops


@query("closest_pairs", f"SELECT {_PAIR_SQL} FROM c_headways ORDER BY distance_to_next_bus_km, event_id LIMIT 25")
def _(d: Domain):
    return spc.closest_pairs(d.headways).select(*_PAIR)


@query("hotspot_filter", "SELECT * FROM c_hotspots WHERE severe_events >= 1 AND bunching_events >= 2")
def _(d: Domain):
    return bun.hotspot_filter(d.hotspots, severity_mode="any_severe", min_events=2)


@query("hourly_curve", """
SELECT hour_of_day, CAST(sum(bunching_events) AS BIGINT) AS bunching_events, CAST(sum(severe_events) AS BIGINT) AS severe_events
FROM c_hourly WHERE route_short_name = 'R10' GROUP BY hour_of_day""")
def _(d: Domain):
    return bun.hourly_curve(d.hourly, "R10")


@query("fragile_routes", "SELECT * FROM c_priority WHERE reliability_score < (SELECT median(reliability_score) FROM c_priority)")
def _(d: Domain):
    return sco.fragile_routes(d.gold_priority)


@query("network_kpis", f"""
SELECT count(*) AS routes_monitored, {r(gavg('reliability_score', 2), 1)} AS avg_reliability,
  CAST(sum(total_bunching_events) AS BIGINT) AS total_bunching,
  first(route_short_name ORDER BY reliability_score, route_short_name) AS worst_corridor,
  {r('min(reliability_score)', 1)} AS worst_corridor_score,
  first(route_short_name ORDER BY intervention_priority_score DESC, route_short_name) AS biggest_win,
  {r('max(intervention_priority_score)', 1)} AS biggest_win_score FROM c_priority""")
def _(d: Domain):
    return sco.network_kpis(d.priority)
