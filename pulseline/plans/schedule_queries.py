"""Schedule-table, geometry and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseline.functions import columns as C
from pulseline.operators import dimensions as dims
from pulseline.operators import geometry as geo
from pulseline.operators import spacing as spc
from pulseline.plans.domain import BOUND_ERROR_M, Domain
from pulseline.plans.registry import cte, gavg, query, r
from pulseline.plans.tables_sql import CORRIDOR, headways_sql
from pulseline.sources import files

# Name of the typed dimension, its columns, its SQL and the key test.
_DIMS = {
    "dim_routes": ("routes", "c_routes", "route_id, route_short_name, route_long_name, route_type"),
    "dim_trips": ("trips", "c_trips", "trip_id, route_id, service_id, shape_id, direction_id"),
    "dim_stops": ("stops", "c_stops", "stop_id, stop_name, stop_lat, stop_lon"),
    "dim_shapes": ("shapes", "c_shapes",
                   "shape_id, shape_pt_lat, shape_pt_lon, shape_pt_sequence, shape_dist_traveled"),
    "dim_stop_times": ("stop_times", "c_stop_times",
                       "trip_id, CAST(NULL AS VARCHAR) AS arrival_time, CAST(NULL AS VARCHAR) AS departure_time, stop_id, "
                       "stop_sequence, shape_dist_traveled"),
}


def _dim(name: str):
    table, rel, cols = _DIMS[name]

    @query(name, f"SELECT {cols} FROM {rel}")
    def _(d: Domain):
        raw = getattr(d, table)
        # back to all-text first, as the schedule files arrive
        return dims.clean_dimension(raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]), table)


for _name in _DIMS:
    _dim(_name)

_CLEAN = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {rel}" for name, (_, rel, _) in _DIMS.items())


@query("dims_clean", _CLEAN)
def _(d: Domain):
    cleaned = {}
    for name, (table, _, _) in _DIMS.items():
        raw = getattr(d, table)
        cleaned[name] = dims.clean_dimension(raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]), table)
    return dims.table_counts(cleaned)


cte("c_buses", """
SELECT route_id, trim(route_short_name) AS route_short_name, route_long_name, route_type,
  CASE WHEN route_id IN ('6641') THEN 'B-Line' WHEN regexp_matches(route_short_name, '^N[0-9]+$') THEN 'NightBus'
    WHEN regexp_matches(route_short_name, '^R[0-9]+$') THEN 'RapidBus'
    WHEN lower(route_long_name) LIKE '%express%' OR route_short_name LIKE '5%' THEN 'Express' ELSE 'Regular Bus' END AS bus_subtype
FROM c_routes WHERE route_type = 3""")
cte("c_membership", """
SELECT DISTINCT t.route_id, st.stop_id FROM c_stop_times st JOIN c_trips t ON st.trip_id = t.trip_id
WHERE t.route_id IN (SELECT route_id FROM c_buses)""")
cte("c_representative", """
SELECT route_id, shape_id, n_points FROM (SELECT DISTINCT t.route_id, t.shape_id, p.n_points
  FROM c_trips t JOIN (SELECT shape_id, count(*) AS n_points FROM c_shapes GROUP BY shape_id) p ON t.shape_id = p.shape_id
  WHERE t.route_id IN (SELECT route_id FROM c_buses))
QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY n_points DESC, shape_id) = 1""")
cte("c_corridors", """
SELECT *, row_number() OVER (ORDER BY total_records DESC, route_id) AS activity_rank,
  row_number() OVER (ORDER BY total_records DESC, route_id) <= 20 AS is_critical
FROM (SELECT b.*, coalesce(s.n, 0) AS static_stop_count, p.shape_id IS NOT NULL AS has_shape,
        coalesce(a.total_records, 0) AS total_records, coalesce(a.unique_vehicles, 0) AS unique_vehicles,
        coalesce(a.days_active, 0) AS days_active
      FROM c_buses b LEFT JOIN (SELECT route_id, count(*) AS n FROM c_membership GROUP BY route_id) s ON b.route_id = s.route_id
      LEFT JOIN c_representative p ON b.route_id = p.route_id LEFT JOIN c_activity a ON b.route_id = a.route_id)""")


@query("shape_distance_summary", "SELECT * FROM c_shape_summary")
def _(d: Domain):
    return d.shape_summary


@query("route_shape_summary", "SELECT * FROM c_route_shapes")
def _(d: Domain):
    return d.route_shapes


@query("route_trip_shapes", "SELECT route_id, direction_id, shape_id, count(*) AS trip_count FROM c_trips GROUP BY ALL")
def _(d: Domain):
    return dims.route_trip_shapes(d.trips)


cte("c_days_ok", "SELECT route_id, count(*) AS eligible_days FROM c_bound_eligibility WHERE eligibility_status = 'Eligible' GROUP BY route_id")
cte("c_eligible_shapes", """
SELECT rs.*, e.eligible_days FROM c_route_shapes rs JOIN c_days_ok e ON rs.route_id = e.route_id
WHERE rs.shape_length_km IS NOT NULL AND rs.shape_points >= 2""")


def _eligible_shapes(d: Domain):
    return dims.eligible_route_shapes(d.route_shapes, d.bound_eligibility)


@query("eligible_route_shapes", "SELECT * FROM c_eligible_shapes")
def _(d: Domain):
    return _eligible_shapes(d)


@query("shape_reference_stats", f"""
SELECT * FROM (SELECT count(DISTINCT shape_id) AS total_shapes, {r(gavg('shape_length_km', 2))} AS avg_shape_length_km,
  {r('max(shape_length_km)')} AS max_shape_length_km FROM c_shape_summary),
 (SELECT count(*) AS eligible_route_shape_rows, count(DISTINCT route_id) AS eligible_routes,
    count(DISTINCT shape_id) AS eligible_shapes FROM c_eligible_shapes)""")
def _(d: Domain):
    return dims.shape_reference_stats(d.shape_summary, _eligible_shapes(d))


@query("union_all_counts", """
SELECT 'dim_routes' AS table_name, count(*) AS row_count FROM c_routes UNION ALL SELECT 'dim_trips', count(*) FROM c_trips
UNION ALL SELECT 'dim_stops', count(*) FROM c_stops UNION ALL SELECT 'dim_shapes', count(*) FROM c_shapes
UNION ALL SELECT 'dim_stop_times', count(*) FROM c_stop_times UNION ALL SELECT 'silver_enriched', count(*) FROM c_silver""")
def _(d: Domain):
    return dims.table_counts({"dim_routes": d.routes, "dim_trips": d.trips, "dim_stops": d.stops, "dim_shapes": d.shapes,
                              "dim_stop_times": d.stop_times, "silver_enriched": d.silver_enriched})


@query("bus_only", "SELECT * FROM c_buses")
def _(d: Domain):
    return d.buses


@query("bus_semi_filter", "SELECT * FROM c_trips WHERE route_id IN (SELECT route_id FROM c_buses)")
def _(d: Domain):
    return dims.semi_filter(d.trips, d.buses, "route_id")


@query("route_stop_membership", "SELECT * FROM c_membership")
def _(d: Domain):
    return d.membership


@query("stop_times_scan", """
SELECT DISTINCT trip_id, stop_id FROM c_stop_times WHERE trip_id IN (
  SELECT trip_id FROM c_trips WHERE route_id IN (SELECT route_id FROM c_buses))""")
def _(d: Domain):
    return files.stop_times_scan(d.stop_times, dims.semi_filter(d.trips, d.buses, "route_id"))


@query("distinct_pairs", "SELECT DISTINCT route_id, shape_id FROM c_trips")
def _(d: Domain):
    return d.trips.select("route_id", "shape_id").distinct()


@query("concat_frames", """
SELECT 'headway' AS source, route_id, count(*) AS n FROM c_headways GROUP BY route_id
UNION ALL SELECT 'event', route_id, count(*) FROM c_events GROUP BY route_id""")
def _(d: Domain):
    a = d.headways.groupBy("route_id").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("headway"))
    b = d.events.groupBy("route_id").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("event"))
    return a.unionByName(b)


@query("representative_shape", "SELECT * FROM c_representative")
def _(d: Domain):
    return d.representative


@query("corridor_geometry", """
SELECT p.route_id, s.shape_id, s.shape_pt_sequence AS sequence, s.shape_pt_lat AS lat, s.shape_pt_lon AS lon
FROM c_shapes s JOIN (SELECT shape_id, max(route_id) AS route_id FROM c_representative GROUP BY shape_id) p ON s.shape_id = p.shape_id""")
def _(d: Domain):
    return geo.corridor_geometry(d.representative, d.shapes)


@query("polyline_midpoints", """
SELECT shape_id, shape_pt_lat AS mid_lat, shape_pt_lon AS mid_lon FROM (SELECT *,
  row_number() OVER (PARTITION BY shape_id ORDER BY shape_pt_sequence) AS rn, count(*) OVER (PARTITION BY shape_id) AS n FROM c_shapes)
WHERE rn = n // 2 + 1""")
def _(d: Domain):
    return geo.polyline_midpoints(d.shapes)


@query("critical_corridors", "SELECT * FROM c_corridors")
def _(d: Domain):
    return d.corridors


@query("stop_counts", "SELECT route_id, count(*) AS static_stop_count FROM c_membership GROUP BY route_id")
def _(d: Domain):
    return geo.stop_counts(d.membership)


@query("subtype_route_counts", "SELECT bus_subtype, count(*) AS routes FROM c_corridors GROUP BY bus_subtype")
def _(d: Domain):
    return geo.subtype_route_counts(d.corridors)


@query("stop_count_distribution", f"""
SELECT bin, {r('m')} AS median_stops, count(*) AS routes, count(*) FILTER (is_critical) AS critical_routes FROM (
  SELECT c.*, e.m, CASE WHEN e.hi = e.lo THEN 0 ELSE CAST(least(floor((c.static_stop_count - e.lo) / ((e.hi - e.lo) / 30e0)), 29) AS INT) END AS bin
  FROM c_corridors c, (SELECT CAST(min(static_stop_count) AS DOUBLE) AS lo, CAST(max(static_stop_count) AS DOUBLE) AS hi,
                         median(static_stop_count) AS m FROM c_corridors) e) GROUP BY bin, m""")
def _(d: Domain):
    return geo.stop_count_distribution(d.corridors)


def _top_stops_sql(where: str, n: int | None) -> str:
    limit = "" if n is None else f"ORDER BY total_records DESC, route_id LIMIT {n}"
    return f"""
SELECT t.route_id, t.route_short_name, t.bus_subtype, s.stop_id, s.stop_name, s.stop_lat, s.stop_lon
FROM (SELECT * FROM c_corridors {where} {limit}) t
JOIN c_membership m ON t.route_id = m.route_id JOIN c_stops s ON m.stop_id = s.stop_id"""


@query("top10_with_stops", _top_stops_sql("", 10))
def _(d: Domain):
    return geo.top_routes_with_stops(d.corridors, d.membership, d.stops)


@query("top25_regular_express_with_stops", _top_stops_sql("WHERE bus_subtype IN ('Regular Bus', 'Express')", 25))
def _(d: Domain):
    return geo.top_routes_with_stops(d.corridors, d.membership, d.stops, 25, ("Regular Bus", "Express"))


@query("rapid_night_bline_with_stops", _top_stops_sql("WHERE bus_subtype IN ('RapidBus', 'NightBus', 'B-Line')", None))
def _(d: Domain):
    return geo.top_routes_with_stops(d.corridors, d.membership, d.stops, None, ("RapidBus", "NightBus", "B-Line"))


# --- projection ---------------------------------------------------------------------------------------

cte("c_projected", """
SELECT * EXCLUDE (rn, term, bound_dist_km), 2e0 * 6371000e0 * asin(sqrt(least(1e0, term))) AS projection_error_m FROM (
  SELECT p.*, s.shape_pt_sequence AS nearest_shape_sequence, s.shape_dist_traveled AS approx_shape_dist_traveled, s.term,
    row_number() OVER (PARTITION BY p.event_id ORDER BY s.term, s.shape_pt_sequence) AS rn
  FROM c_silver p, LATERAL (SELECT v.*, power(sin((radians(v.shape_pt_lat) - radians(p.latitude)) / 2e0), 2)
      + cos(radians(p.latitude)) * cos(radians(v.shape_pt_lat))
        * power(sin((radians(v.shape_pt_lon) - radians(p.longitude)) / 2e0), 2) AS term
    FROM c_shapes v WHERE v.shape_id = p.shape_id) s)
WHERE rn = 1""")


@query("project_to_shape", f"""
SELECT event_id, shape_id, nearest_shape_sequence, approx_shape_dist_traveled, {r('projection_error_m', 1)} AS projection_error_m FROM c_projected""")
def _(d: Domain):
    return d.projected.select("event_id", "shape_id", "nearest_shape_sequence", "approx_shape_dist_traveled",
                              C.rnd("projection_error_m", 1).alias("projection_error_m"))


@query("projection_filter", "SELECT event_id, shape_id FROM c_projected WHERE projection_error_m <= 500 AND approx_shape_dist_traveled IS NOT NULL")
def _(d: Domain):
    return spc.projection_filter(d.projected, BOUND_ERROR_M).select("event_id", "shape_id")


@query("projection_quality", f"""
SELECT count(*) AS projected_rows, {r('avg(projection_error_m)')} AS avg_projection_error_m,
  {r('median(projection_error_m)')} AS median_projection_error_m, {r('max(projection_error_m)')} AS max_projection_error_m FROM c_projected""")
def _(d: Domain):
    return geo.projection_quality(d.projected)


@query("projection_by_shape", f"""
SELECT direction_id, shape_id, count(*) AS observations, count(DISTINCT vehicle_id) AS vehicles,
  {r('min(approx_shape_dist_traveled)')} AS min_shape_dist, {r('max(approx_shape_dist_traveled)')} AS max_shape_dist
FROM c_projected GROUP BY direction_id, shape_id""")
def _(d: Domain):
    return geo.projection_by_shape(d.projected)


@query("projected_sample", """
SELECT event_id, CAST(collection_timestamp AS VARCHAR) AS collection_timestamp, vehicle_id, nearest_shape_sequence FROM c_projected
ORDER BY collection_timestamp, vehicle_id, event_id LIMIT 5000""")
def _(d: Domain):
    return geo.projected_sample(d.projected).select("event_id", "collection_timestamp", "vehicle_id", "nearest_shape_sequence")


cte("c_spatial_service", """
SELECT p.*, s.shape_length_km FROM c_projected p LEFT JOIN c_shape_summary s ON p.shape_id = s.shape_id
WHERE p.projection_error_m <= 500 AND p.approx_shape_dist_traveled IS NOT NULL AND p.approx_shape_dist_traveled > 0.75e0
  AND (s.shape_length_km IS NULL OR p.approx_shape_dist_traveled < s.shape_length_km - 0.75e0)""")
cte("c_spatial_headways", headways_sql("c_spatial_service", CORRIDOR))


def _spatial(d: Domain):
    placed = spc.with_shape_length(d.projected, d.shape_summary)
    return placed, spc.observed_headways(
        spc.terminal_buffer(spc.projection_filter(placed, BOUND_ERROR_M)), spc.CORRIDOR_KEYS)


@query("spatial_headways", """
SELECT event_id, route_id, vehicle_id, next_vehicle_id, bus_rank, distance_to_next_bus_km FROM c_spatial_headways""")
def _(d: Domain):
    return _spatial(d)[1].select("event_id", "route_id", "vehicle_id", "next_vehicle_id", "bus_rank", "distance_to_next_bus_km")


@query("cleaning_funnel", """
SELECT *, raw_rows - rows_after_projection AS removed_by_projection, rows_after_projection - rows_in_service AS removed_by_terminal
FROM (SELECT (SELECT count(*) FROM c_projected) AS raw_rows,
  (SELECT count(*) FROM c_projected WHERE projection_error_m <= 500 AND approx_shape_dist_traveled IS NOT NULL) AS rows_after_projection,
  (SELECT count(*) FROM c_spatial_service) AS rows_in_service, (SELECT count(*) FROM c_spatial_headways) AS clean_rows)""")
def _(d: Domain):
    placed, headways = _spatial(d)
    return spc.cleaning_funnel(placed, headways, BOUND_ERROR_M)
