"""Common table expressions: the binding of the base tables and the domain tables on it."""

from __future__ import annotations

from pulseline.plans.registry import cte, div, gavg, pct, r

cte("c_pings", """
SELECT event_id,
       date_trunc('hour', ts) - (CAST(extract(hour FROM ts) AS INT) % 4) * INTERVAL '1' HOUR AS collection_timestamp,
       ts AS api_vehicle_timestamp,
       concat('E', CAST(event_id AS STRING)) AS entity_id,
       CASE WHEN event_id % 103 = 0 THEN NULL ELSE concat('V', CAST(user_id AS STRING)) END AS vehicle_id,
       CAST((user_id + event_id) % 25 AS STRING) AS route_id,
       CAST(event_id * 2 AS STRING) AS trip_id,
       CASE WHEN event_id % 101 = 0 THEN CAST(NULL AS DOUBLE) WHEN event_id % 97 = 0 THEN 0.0E0
            ELSE 49.2E0 + (CAST(round(value * 100) AS BIGINT) % 100) / 1000.0E0 END AS latitude,
       CASE WHEN event_id % 101 = 0 THEN CAST(NULL AS DOUBLE) WHEN event_id % 97 = 0 THEN 0.0E0
            ELSE -123.1E0 + (user_id % 100) / 1000.0E0 END AS longitude,
       CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE 0.0E0 END AS bearing,
       CASE WHEN event_type = 'error' THEN 0.0E0 ELSE value / 25.0E0 END AS speed,
       CAST(event_id % 2 AS INT) AS direction_id,
       concat('s', CAST(user_id % 10 AS STRING)) AS shape_id,
       (CAST(round(value * 100) AS BIGINT) % 2000) / 100.0E0 AS bound_dist_km
FROM events
""")

cte("c_routes", """
SELECT CAST(n_nationkey AS STRING) AS route_id,
       CASE WHEN n_nationkey = 4 THEN '099' WHEN n_nationkey % 5 = 0 THEN concat('R', CAST(n_nationkey AS STRING))
            WHEN n_nationkey % 7 = 0 THEN concat('N', CAST(n_nationkey AS STRING)) ELSE concat('5', lpad(CAST(n_nationkey AS STRING), 2, '0')) END AS route_short_name,
       CASE WHEN n_nationkey % 3 = 0 THEN concat(n_name, ' Station') WHEN n_nationkey % 4 = 0 THEN concat(n_name, ' Express') ELSE n_name END AS route_long_name,
       CASE n_regionkey WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 4 END AS route_type
FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation
      UNION ALL SELECT 25 + r_regionkey, r_name, r_regionkey FROM region)
""")

cte("c_trips", """
SELECT CAST(o_orderkey AS STRING) AS trip_id, CAST(o_custkey % 25 AS STRING) AS route_id, o_orderstatus AS service_id,
       concat('s', CAST(o_custkey % 10 AS STRING)) AS shape_id, CAST(floor(o_orderkey / 2.0E0) AS INT) % 2 AS direction_id
FROM orders
""")

cte("c_stops", """
SELECT CAST(s_suppkey AS STRING) AS stop_id, s_name AS stop_name,
       49.2E0 + (s_suppkey % 100) / 1000.0E0 AS stop_lat, -123.1E0 + (s_suppkey % 90) / 1000.0E0 AS stop_lon
FROM supplier
""")

cte("c_stop_times", """
SELECT CAST(l_orderkey AS STRING) AS trip_id, CAST(l_suppkey AS STRING) AS stop_id, l_linenumber AS stop_sequence,
       CAST(l_suppkey % 200 AS DOUBLE) / 10.0E0 AS shape_dist_traveled
FROM lineitem
""")

cte("c_shapes", """
SELECT concat('s', CAST(p_partkey % 10 AS STRING)) AS shape_id, CAST(floor(p_partkey / 10.0E0) AS INT) AS shape_pt_sequence,
       49.2E0 + (p_size % 50) / 500.0E0 AS shape_pt_lat, -123.1E0 + (CAST(floor(p_partkey / 10.0E0) AS INT) % 100) / 1000.0E0 AS shape_pt_lon,
       CAST(floor(p_partkey / 10.0E0) AS DOUBLE) * 20.0E0 / (SELECT floor(count(*) / 10.0E0) FROM part) AS shape_dist_traveled
FROM part
""")

cte("c_questions", """
SELECT o_orderkey AS question_id,
       CASE o_orderkey % 12
         WHEN 0 THEN concat('What was the reliability score of route ', CAST(o_custkey % 25 AS STRING), '?')
         WHEN 1 THEN 'Which routes have the highest bunching rate?'
         WHEN 2 THEN 'Which routes are least reliable?'
         WHEN 3 THEN 'Which routes perform worst during PM Peak?'
         WHEN 4 THEN concat('Compare R', CAST(o_custkey % 30 AS STRING), ' and 099.')
         WHEN 5 THEN 'How many passengers ride each day?'
         WHEN 6 THEN 'Which SkyTrain line is most delayed?'
         WHEN 7 THEN 'What is the on-time performance against schedule?'
         WHEN 8 THEN concat('How has R', CAST(o_custkey % 30 AS STRING), ' changed over the past 6 months?')
         WHEN 9 THEN 'Which corridors should operations prioritize in the morning rush?'
         WHEN 10 THEN 'Worst severe bunching at rush hour?'
         ELSE concat('Is the data quality on ', ['Hastings St', 'Broadway B-Line', 'Kingsway', 'marine drive', 'King  Edward', 'the port coquitlam run'][o_custkey % 6 + 1],
           ' or ', ['49th Avenue', '41ST AVE Route 4', 'Broadway 9/the R7', 'the 99 B-Line', 'Hastings/UBC Exchange', 'king george blvd'][o_orderkey // 12 % 6 + 1], ' good enough?') END AS text
FROM orders
""")

# --- silver and foundation ---------------------------------------------------------------------

cte("c_silver", """
SELECT *, CAST(collection_timestamp AS DATE) AS service_date,
       CAST(extract(hour FROM collection_timestamp) AS INT) AS hour_of_day
FROM c_pings
WHERE vehicle_id IS NOT NULL AND route_id IS NOT NULL
  AND latitude BETWEEN 48e0 AND 50e0 AND longitude BETWEEN -124e0 AND -121e0
""")

cte("c_enriched", """
SELECT s.* EXCLUDE (direction_id, shape_id, bound_dist_km), t.direction_id, t.shape_id, t.service_id
FROM c_silver s LEFT JOIN c_trips t ON s.trip_id = t.trip_id
""")

cte("c_stability_hours", f"""
SELECT service_date, route_id, count(*) AS observed_service_hours,
       CAST(sum(n) AS BIGINT) AS total_observations,
       {r('avg(n)')} AS avg_hourly_observations,
       {r('coalesce(stddev_samp(n), 0e0)')} AS stddev_hourly_observations,
       {r('avg(v)')} AS avg_hourly_vehicles, {r('avg(t)')} AS avg_hourly_trips,
       {r('coalesce(stddev_samp(n), 0e0) / nullif(avg(n), 0e0)', 4)} AS observation_cv,
       CASE WHEN count(*) >= 18 THEN 'High Coverage' WHEN count(*) >= 10 THEN 'Medium Coverage'
            ELSE 'Low Coverage' END AS coverage_band,
       CASE WHEN coalesce(stddev_samp(n), 0e0) / nullif(avg(n), 0e0) <= 0.5e0 THEN 'Stable'
            WHEN coalesce(stddev_samp(n), 0e0) / nullif(avg(n), 0e0) <= 1e0 THEN 'Moderate'
            ELSE 'Volatile' END AS stability_band
FROM (SELECT service_date, route_id, hour_of_day, count(*) AS n,
             count(DISTINCT vehicle_id) AS v, count(DISTINCT trip_id) AS t
      FROM c_silver GROUP BY ALL)
GROUP BY service_date, route_id
""")

cte("c_quality", f"""
SELECT service_date, route_id, count(*) AS total_observations,
       count(DISTINCT vehicle_id) AS unique_vehicles, count(DISTINCT trip_id) AS unique_trips,
       count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_location_rows,
       count(*) FILTER (vehicle_id IS NULL) AS missing_vehicle_rows,
       count(*) FILTER (route_id IS NULL) AS missing_route_rows,
       {pct('count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL AND vehicle_id IS NOT NULL AND route_id IS NOT NULL)', 'count(*)')}
         AS valid_row_percentage
FROM c_silver GROUP BY service_date, route_id
""")

cte("c_bound_eligibility", """
SELECT s.*, q.valid_row_percentage,
       CASE WHEN s.observed_service_hours >= 5 AND s.total_observations >= 6
             AND q.valid_row_percentage >= 90 THEN 'Eligible' ELSE 'Not Eligible' END AS eligibility_status
FROM c_stability_hours s LEFT JOIN c_quality q ON s.service_date = q.service_date AND s.route_id = q.route_id
""")

cte("c_eligibility", """
SELECT s.service_date, s.route_id, s.observed_service_hours, s.total_observations, s.observation_cv,
       s.coverage_band, s.stability_band, q.valid_row_percentage,
       CASE WHEN s.observed_service_hours >= 12 AND s.total_observations >= 1000
             AND q.valid_row_percentage >= 95 THEN 'Eligible' ELSE 'Not Eligible' END AS eligibility_status
FROM c_stability_hours s LEFT JOIN c_quality q ON s.service_date = q.service_date AND s.route_id = q.route_id
""")

cte("c_shape_summary", f"""
SELECT shape_id, count(*) AS shape_points, min(shape_pt_sequence) AS first_sequence,
       max(shape_pt_sequence) AS last_sequence, min(shape_dist_traveled) AS min_shape_distance,
       max(shape_dist_traveled) AS max_shape_distance, {r('max(shape_dist_traveled)')} AS shape_length_km
FROM c_shapes WHERE shape_dist_traveled IS NOT NULL GROUP BY shape_id
""")

cte("c_route_shapes", """
SELECT t.route_id, r.route_short_name, r.route_long_name, t.direction_id, t.shape_id,
       count(DISTINCT t.trip_id) AS scheduled_trip_count, s.shape_points, s.shape_length_km
FROM c_trips t LEFT JOIN c_routes r ON t.route_id = r.route_id
LEFT JOIN c_shape_summary s ON t.shape_id = s.shape_id
WHERE t.shape_id IS NOT NULL
GROUP BY t.route_id, r.route_short_name, r.route_long_name, t.direction_id, t.shape_id, s.shape_points, s.shape_length_km
""")

# --- spacing and bunching ------------------------------------------------------------------------

cte("c_placed", """
SELECT * EXCLUDE (bound_dist_km), bound_dist_km AS approx_shape_dist_traveled, 20e0 AS shape_length_km
FROM c_silver
""")

cte("c_in_service", """
SELECT * FROM c_placed
WHERE approx_shape_dist_traveled > 0.75e0
  AND (shape_length_km IS NULL OR approx_shape_dist_traveled < shape_length_km - 0.75e0)
""")

def headways_sql(source: str, keys: str) -> str:
    return f"""
SELECT *, {r('next_shape_dist - approx_shape_dist_traveled', 4)} AS distance_to_next_bus_km
FROM (SELECT *,
        row_number() OVER w AS bus_rank,
        lead(vehicle_id) OVER w AS next_vehicle_id,
        lead(approx_shape_dist_traveled) OVER w AS next_shape_dist
      FROM {source}
      WINDOW w AS (PARTITION BY {keys} ORDER BY approx_shape_dist_traveled, event_id))
WHERE next_vehicle_id IS NOT NULL AND next_vehicle_id <> vehicle_id
  AND next_shape_dist - approx_shape_dist_traveled > 0
"""


CORRIDOR = "collection_timestamp, direction_id, shape_id"
NETWORK = "route_id, " + CORRIDOR
cte("c_headways", headways_sql("c_in_service", CORRIDOR))
cte("c_headways_net", headways_sql("c_in_service", NETWORK))

cte("c_events", """
SELECT *,
  CASE WHEN distance_to_next_bus_km <= 0.10e0 THEN 'Severe' WHEN distance_to_next_bus_km <= 0.25e0 THEN 'High'
       WHEN distance_to_next_bus_km <= 0.50e0 THEN 'Moderate' ELSE 'Normal' END AS bunching_severity,
  CASE WHEN hour_of_day BETWEEN 7 AND 9 THEN 'AM Peak' WHEN hour_of_day BETWEEN 15 AND 18 THEN 'PM Peak'
       ELSE 'Off Peak' END AS peak_period,
  floor(approx_shape_dist_traveled / 0.5e0) * 0.5e0 AS route_segment_km
FROM c_headways WHERE distance_to_next_bus_km <= 0.50e0
""")

cte("c_names", """
SELECT route_id, route_short_name, route_long_name,
  CASE WHEN route_short_name LIKE 'R%' THEN 'RapidBus' WHEN route_short_name = '099' THEN 'B-Line'
       WHEN route_short_name IN ('503', '502', '250', '160') THEN 'Express / Regional'
       ELSE 'Regular Bus' END AS route_type
FROM c_routes
""")

SEVERITIES = """count(*) AS bunching_events,
  count(*) FILTER (bunching_severity = 'Severe') AS severe_events,
  count(*) FILTER (bunching_severity = 'High') AS high_events,
  count(*) FILTER (bunching_severity = 'Moderate') AS moderate_events"""
GAPS = f"""{r(gavg('distance_to_next_bus_km', 4), 3)} AS avg_gap_km,
  {r('median(distance_to_next_bus_km)', 3)} AS median_gap_km"""

cte("c_hotspots", f"""
SELECT h.*, n.route_short_name, n.route_long_name, n.route_type FROM (
  SELECT route_id, direction_id, shape_id, route_segment_km, {SEVERITIES}, {GAPS},
    {r('min(distance_to_next_bus_km)', 3)} AS closest_gap_km,
    count(DISTINCT vehicle_id) AS vehicles_involved, count(DISTINCT collection_timestamp) AS active_timestamps
  FROM c_events GROUP BY route_id, direction_id, shape_id, route_segment_km) h
LEFT JOIN c_names n ON h.route_id = n.route_id
""")

cte("c_hourly", f"""
SELECT h.*, n.route_short_name, n.route_long_name, n.route_type FROM (
  SELECT service_date, route_id, hour_of_day, peak_period, {SEVERITIES}, {GAPS}
  FROM c_events GROUP BY service_date, route_id, hour_of_day, peak_period) h
LEFT JOIN c_names n ON h.route_id = n.route_id
""")


def scores_sql(grain: str) -> str:
    """Reliability scores at a grain, e.g. 'route_id' or 'service_date, route_id'."""
    keys = [k.strip() for k in grain.split(",")]
    on = " AND ".join(f"s.{k} = b.{k}" for k in keys)
    picked = ", ".join(f"s.{k}" for k in keys)
    raw = ("100e0 - bunching_rate_pct * 1.2e0 - severe_bunching_rate_pct * 2e0"
           " - coalesce(peak_bunching_share_pct, 0e0) * 0.1e0")
    return f"""
SELECT *, greatest(0e0, {r(raw)}) AS reliability_score,
  CASE WHEN greatest(0e0, {raw}) >= 85 THEN 'Reliable' WHEN greatest(0e0, {raw}) >= 70 THEN 'Watch'
       WHEN greatest(0e0, {raw}) >= 55 THEN 'Degraded' ELSE 'Critical' END AS reliability_band
FROM (SELECT *, {pct('total_bunching_events', 'total_spacing_rows')} AS bunching_rate_pct,
        {pct('severe_events', 'total_spacing_rows')} AS severe_bunching_rate_pct,
        {pct('peak_events', 'total_bunching_events')} AS peak_bunching_share_pct
      FROM (SELECT {picked}, s.total_spacing_rows, coalesce(b.e, 0) AS total_bunching_events,
              coalesce(b.sv, 0) AS severe_events, coalesce(b.pk, 0) AS peak_events
            FROM (SELECT {grain}, count(*) AS total_spacing_rows FROM c_headways GROUP BY {grain}) s
            LEFT JOIN (SELECT {grain}, count(*) AS e,
                         count(*) FILTER (bunching_severity = 'Severe') AS sv,
                         count(*) FILTER (peak_period IN ('AM Peak', 'PM Peak')) AS pk
                       FROM c_events GROUP BY {grain}) b ON {on}))
"""


cte("c_scores", f"""
SELECT x.*, n.route_short_name, n.route_long_name, n.route_type
FROM ({scores_sql('route_id')}) x LEFT JOIN c_names n ON x.route_id = n.route_id
""")

cte("c_priority", f"""
SELECT *, {r('(100e0 - reliability_score) + bunching_rate_pct * 1.5e0 + severe_bunching_rate_pct * 3e0 + worst_segment_events * 0.05e0')}
  AS intervention_priority_score
FROM (SELECT s.*, coalesce(h.n, 0) AS hotspot_segments, coalesce(h.m, 0) AS distinct_segments,
        coalesce(h.e, 0) AS worst_segment_events, coalesce(h.sv, 0) AS worst_segment_severe_events
      FROM c_scores s LEFT JOIN (
        SELECT route_id, count(route_segment_km) AS n, count(DISTINCT route_segment_km) AS m,
          max(bunching_events) AS e, max(severe_events) AS sv
        FROM c_hotspots GROUP BY route_id) h ON s.route_id = h.route_id)
""")

cte("c_stop_ref", """
SELECT t.route_id, t.direction_id, t.shape_id, st.stop_id, s.stop_name,
  min(st.stop_sequence) AS stop_sequence, min(st.shape_dist_traveled) AS stop_dist_km
FROM c_stop_times st JOIN c_trips t ON st.trip_id = t.trip_id LEFT JOIN c_stops s ON st.stop_id = s.stop_id
WHERE st.shape_dist_traveled IS NOT NULL
GROUP BY t.route_id, t.direction_id, t.shape_id, st.stop_id, s.stop_name
""")


def stop_side_sql(tag: str, test: str, order: str) -> str:
    return f"""
SELECT route_id, direction_id, shape_id, route_segment_km, stop_{tag}_id, stop_{tag}_name, stop_{tag}_dist_km
FROM (SELECT h.route_id, h.direction_id, h.shape_id, h.route_segment_km, u.stop_id AS stop_{tag}_id,
        u.stop_name AS stop_{tag}_name, {r('u.stop_dist_km')} AS stop_{tag}_dist_km,
        row_number() OVER (PARTITION BY h.route_id, h.direction_id, h.shape_id, h.route_segment_km
                           ORDER BY u.stop_dist_km {order}, u.stop_id) AS rn
      FROM c_hotspots h LEFT JOIN c_stop_ref u ON h.route_id = u.route_id
        AND h.direction_id = u.direction_id AND h.shape_id = u.shape_id AND {test})
WHERE rn = 1
"""


cte("c_stop_before", stop_side_sql("before", "u.stop_dist_km <= h.route_segment_km", "DESC"))
cte("c_stop_after", stop_side_sql("after", "u.stop_dist_km >= h.route_segment_km + 0.5e0", "ASC"))

cte("c_hot_stops", """
SELECT h.*, h.route_segment_km AS segment_start_km, h.route_segment_km + 0.5e0 AS segment_end_km,
  b.stop_before_id, b.stop_before_name, b.stop_before_dist_km,
  a.stop_after_id, a.stop_after_name, a.stop_after_dist_km
FROM c_hotspots h
LEFT JOIN c_stop_before b USING (route_id, direction_id, shape_id, route_segment_km)
LEFT JOIN c_stop_after a USING (route_id, direction_id, shape_id, route_segment_km)
""")
