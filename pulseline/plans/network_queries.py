"""Network-intelligence queries: modes, concentration, rhythm, feeders, fleet, resilience."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseline.config import STATION_KEYWORDS
from pulseline.functions import columns as C
from pulseline.operators import activity as act
from pulseline.operators import network as net
from pulseline.plans.domain import Domain
from pulseline.plans.registry import cte, div, gavg, query, r

_MODE = ("CASE route_type WHEN 1 THEN 'SkyTrain' WHEN 2 THEN 'West Coast Express' WHEN 3 THEN 'Bus' WHEN 4 THEN 'SeaBus' "
         "WHEN 715 THEN 'HandyDART' ELSE 'Unknown' END")
_SUBTYPE = ("CASE WHEN regexp_matches(route_short_name, '^R[0-9]{1,2}$') THEN 'RapidBus' "
            "WHEN regexp_matches(route_short_name, '^N[0-9]+$') THEN 'NightBus' "
            "WHEN lower(route_long_name) LIKE '%b-line%' OR route_short_name = '099' THEN 'B-Line' "
            "WHEN lower(route_long_name) LIKE '%express%' THEN 'Express' "
            "WHEN regexp_matches(route_short_name, '^C[0-9]+$') THEN 'Community Shuttle' ELSE 'Regular Bus' END")
_FEEDER = "regexp_matches(route_long_name, '(" + "|".join(STATION_KEYWORDS) + ")', 'i')"

cte("c_dim", f"""
SELECT r.*, {_MODE} AS mode, CASE WHEN route_type = 3 THEN {_SUBTYPE} ELSE {_MODE} END AS bus_subtype,
  route_id IN (SELECT route_id FROM c_pings) AS is_in_telemetry
FROM c_routes r""")
cte("c_net", """
SELECT a.*, d.route_short_name, d.route_long_name, d.route_type, d.mode, d.bus_subtype
FROM c_activity a LEFT JOIN c_dim d ON a.route_id = d.route_id""")
cte("c_pareto", f"""
SELECT route_rank, {r(div('route_rank', 'n') + ' * 1e2', 4)} AS route_rank_pct, route_id, route_short_name, route_long_name,
  mode, bus_subtype, total_records, cumulative_records, {r(div('cumulative_records', 't') + ' * 1e2', 4)} AS cumulative_pct
FROM (SELECT *, row_number() OVER w AS route_rank,
        CAST(sum(total_records) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_records,
        count(*) OVER () AS n, sum(total_records) OVER () AS t
      FROM c_net WINDOW w AS (ORDER BY total_records DESC, route_id))""")
cte("c_profile", """
SELECT bus_subtype, (hour - 7 + 24) % 24 AS local_hour, CAST(sum(records) AS BIGINT) AS records
FROM c_heatmap h JOIN c_dim d ON h.route_id = d.route_id GROUP BY ALL""")
cte("c_dense", """
SELECT s.bus_subtype, h.local_hour, coalesce(p.records, 0) AS records
FROM (SELECT DISTINCT bus_subtype FROM c_profile) s, (SELECT CAST(unnest(range(24)) AS INT) AS local_hour) h
LEFT JOIN c_profile p ON p.bus_subtype = s.bus_subtype AND p.local_hour = h.local_hour""")
cte("c_feeder_hourly", f"""
SELECT {_FEEDER} AS serves_rail, (hour - 7 + 24) % 24 AS local_hour, CAST(sum(records) AS BIGINT) AS records
FROM c_heatmap h JOIN c_dim d ON h.route_id = d.route_id WHERE d.mode = 'Bus' GROUP BY ALL""")
cte("c_stable_scores", f"""
SELECT s.route_id, d.route_short_name, d.route_long_name, d.mode, d.bus_subtype, s.days_active, s.mean_daily_records,
  s.cv_daily_records, s.is_persistent,
  {r(f"(0.6e0 * (1e0 - {div('least(s.cv_daily_records, m.cap)', 'm.cap')}) + 0.4e0 * {div('s.days_active', 'm.most')}) * 1e2")}
    AS stability_score
FROM c_stability s LEFT JOIN c_dim d ON s.route_id = d.route_id,
  (SELECT quantile_cont(cv_daily_records, 0.95) AS cap, max(days_active) AS most FROM c_stability) m""")


@query("mode_map", f"SELECT route_id, {_MODE} AS mode FROM c_routes")
def _(d: Domain):
    return d.routes.select("route_id", C.mode_of("route_type").alias("mode"))


@query("bus_subtype", f"SELECT route_id, {_SUBTYPE} AS bus_subtype FROM c_routes")
def _(d: Domain):
    return d.routes.select("route_id", C.bus_subtype("route_short_name", "route_long_name").alias("bus_subtype"))


@query("bus_subtype_static", """
SELECT route_id, CASE WHEN route_id IN ('6641') THEN 'B-Line' WHEN regexp_matches(route_short_name, '^N[0-9]+$') THEN 'NightBus'
  WHEN regexp_matches(route_short_name, '^R[0-9]+$') THEN 'RapidBus'
  WHEN lower(route_long_name) LIKE '%express%' OR route_short_name LIKE '5%' THEN 'Express' ELSE 'Regular Bus' END AS bus_subtype
FROM c_routes""")
def _(d: Domain):
    return d.routes.select("route_id", C.bus_subtype_static("route_id", "route_short_name", "route_long_name").alias("bus_subtype"))


@query("route_class", "SELECT route_id, route_type AS route_class FROM c_names")
def _(d: Domain):
    return d.routes.select("route_id", C.route_class("route_short_name").alias("route_class"))


@query("feeder_flag", f"SELECT route_id, {_FEEDER} AS serves_rail FROM c_routes")
def _(d: Domain):
    return d.routes.select("route_id", C.feeder_flag("route_long_name").alias("serves_rail"))


@query("route_label", """
SELECT route_id, trim(route_short_name) || ' — ' || trim(route_long_name) AS route_label,
  coalesce(nullif(ltrim(route_short_name, '0'), ''), route_short_name) AS bare_code FROM c_routes""")
def _(d: Domain):
    return d.routes.select("route_id", C.route_label("route_short_name", "route_long_name").alias("route_label"),
                           C.bare_route_code("route_short_name").alias("bare_code"))


@query("route_dimension", "SELECT * FROM c_dim")
def _(d: Domain):
    return d.dim


@query("telemetry_blind_spots", "SELECT route_id, route_short_name, route_long_name, mode FROM c_dim WHERE NOT is_in_telemetry")
def _(d: Domain):
    return net.telemetry_blind_spots(d.routes, d.raw_pings)


@query("modal_activity_share", f"""
SELECT mode, count(DISTINCT route_id) AS routes_in_telemetry, CAST(sum(total_records) AS BIGINT) AS total_records,
  CAST(sum(unique_vehicles) AS BIGINT) AS unique_vehicles,
  {r(div('sum(total_records)', 'sum(sum(total_records)) OVER ()') + ' * 1e2')} AS pct_of_records FROM c_net GROUP BY mode""")
def _(d: Domain):
    return net.modal_activity_share(d.enriched)


@query("modal_coverage", f"""
SELECT mode, count(route_id) AS routes_in_static, count(*) FILTER (is_in_telemetry) AS routes_in_telemetry,
  {r(div('count(*) FILTER (is_in_telemetry)', 'count(route_id)') + ' * 1e2', 1)} AS coverage_pct FROM c_dim GROUP BY mode""")
def _(d: Domain):
    return net.modal_coverage(d.dim)


@query("bus_subtype_share", f"""
SELECT bus_subtype, count(DISTINCT route_id) AS routes, CAST(sum(total_records) AS BIGINT) AS total_records,
  CAST(sum(unique_vehicles) AS BIGINT) AS unique_vehicles,
  {r(div('sum(total_records)', 'sum(sum(total_records)) OVER ()') + ' * 1e2')} AS pct_of_bus_records
FROM c_net WHERE mode = 'Bus' GROUP BY bus_subtype""")
def _(d: Domain):
    return net.bus_subtype_share(d.enriched)


@query("top_corridors", """
SELECT route_id, route_short_name, route_long_name, mode, bus_subtype, total_records, unique_vehicles, days_active
FROM c_net ORDER BY total_records DESC, route_id LIMIT 20""")
def _(d: Domain):
    return net.top_corridors(d.enriched)


@query("pareto_concentration", "SELECT * FROM c_pareto")
def _(d: Domain):
    return net.pareto_concentration(d.enriched)


@query("pareto_threshold", "SELECT min(route_rank_pct) AS route_rank_pct FROM c_pareto WHERE cumulative_pct >= 80")
def _(d: Domain):
    return net.pareto_threshold(net.pareto_concentration(d.enriched))


@query("network_centralization", f"""
SELECT unnest(['Top 10% share (index)', 'Top 20% share (index)', 'Top 10% share (ranked)', 'Top 20% share (ranked)',
               'Gini coefficient', 'Routes with telemetry', 'Persistent routes']) AS metric,
       unnest([a, b, c1, d1, g, n1, p]) AS value
FROM (SELECT {r('max(c) FILTER (rank = least(floor(0.1e0 * n) + 1, n))')} AS a,
        {r('max(c) FILTER (rank = least(floor(0.2e0 * n) + 1, n))')} AS b,
        {r('max(c) FILTER (' + div('rank', 'n') + ' * 1e2 <= 10e0)')} AS c1,
        {r('max(c) FILTER (' + div('rank', 'n') + ' * 1e2 <= 20e0)')} AS d1,
        {r('coalesce((2e0 * CAST(sum(i * total_records) AS DOUBLE) - (max(n) + 1e0) * CAST(sum(total_records) AS DOUBLE)) / nullif(max(n) * CAST(sum(total_records) AS DOUBLE), 0e0), 0e0)', 4)} AS g,
        CAST(count(*) AS DOUBLE) AS n1, (SELECT CAST(count(*) FILTER (is_persistent) AS DOUBLE) FROM c_stability) AS p
      FROM (SELECT *, {div('cum', 't')} * 1e2 AS c FROM (
        SELECT total_records, row_number() OVER (ORDER BY total_records, route_id) AS i,
          row_number() OVER (ORDER BY total_records DESC, route_id) AS rank,
          sum(total_records) OVER (ORDER BY total_records DESC, route_id ROWS UNBOUNDED PRECEDING) AS cum,
          sum(total_records) OVER () AS t, count(*) OVER () AS n FROM c_activity)))""")
def _(d: Domain):
    return net.network_centralization(d.activity, d.stability)


@query("subtype_hourly_profile", "SELECT * FROM c_profile")
def _(d: Domain):
    return d.profile


_HOURS = ", ".join(
    f"coalesce(max({r(div('records', 't') + ' * 1e2', 4)}) FILTER (local_hour = {h}), 0e0) AS h{h:02d}" for h in range(24))


@query("subtype_profile_normalized", f"""
SELECT bus_subtype, {_HOURS} FROM (SELECT *, sum(records) OVER (PARTITION BY bus_subtype) AS t FROM c_profile) GROUP BY bus_subtype""")
def _(d: Domain):
    return net.subtype_profile_normalized(d.profile)


@query("subtype_correlation", f"""
SELECT a.bus_subtype AS subtype_a, b.bus_subtype AS subtype_b, {r('corr(a.records, b.records)', 3)} AS correlation
FROM c_dense a JOIN c_dense b ON a.local_hour = b.local_hour GROUP BY ALL""")
def _(d: Domain):
    return net.subtype_correlation(d.profile)


@query("peak_windows", f"""
SELECT bus_subtype, printf('%02d:00–%02d:00', s, (s + 3) % 24) AS peak_window_local, w AS peak_window_records,
  {r(div('w', 't') + ' * 1e2')} AS share_of_subtype_records_in_peak
FROM (SELECT bus_subtype, s, w, t, row_number() OVER (PARTITION BY bus_subtype ORDER BY w DESC, s) AS rn FROM (
  SELECT a.bus_subtype, a.local_hour AS s, CAST(sum(b.records) AS BIGINT) AS w,
    (SELECT sum(records) FROM c_dense z WHERE z.bus_subtype = a.bus_subtype) AS t
  FROM c_dense a JOIN c_dense b ON a.bus_subtype = b.bus_subtype AND (b.local_hour - a.local_hour + 24) % 24 < 3
  GROUP BY a.bus_subtype, a.local_hour)) WHERE rn = 1""")
def _(d: Domain):
    return net.peak_windows(d.profile)


@query("subtype_variability", f"""
SELECT d.bus_subtype, count(*) AS routes, {r(gavg('s.cv_daily_records', 4), 3)} AS mean_cv,
  {r('median(s.cv_daily_records)', 3)} AS median_cv, {r('avg(s.days_active)', 3)} AS mean_days_active
FROM c_stability s JOIN c_dim d ON s.route_id = d.route_id GROUP BY d.bus_subtype""")
def _(d: Domain):
    return net.subtype_variability(d.stability, d.dim)


@query("feeder_routes", f"""
SELECT d.route_id, route_short_name, route_long_name, bus_subtype, total_records, unique_vehicles, days_active,
  {r(div('total_records', '(SELECT sum(total_records) FROM c_activity)') + ' * 1e2')} AS pct_of_all_records
FROM c_dim d JOIN c_activity a ON d.route_id = a.route_id WHERE mode = 'Bus' AND {_FEEDER}""")
def _(d: Domain):
    return net.feeder_routes(d.dim, d.activity)


@query("feeder_hourly", "SELECT * FROM c_feeder_hourly")
def _(d: Domain):
    return net.feeder_hourly(d.heatmap, d.dim)


@query("feeder_peak_hours", """
SELECT serves_rail, local_hour AS peak_hour, records AS peak_records FROM c_feeder_hourly
QUALIFY row_number() OVER (PARTITION BY serves_rail ORDER BY records DESC, local_hour) = 1""")
def _(d: Domain):
    return net.feeder_peak_hours(net.feeder_hourly(d.heatmap, d.dim))


@query("fleet_flexibility", f"""
SELECT category, n AS vehicle_count, {r(div('n', 'sum(n) OVER ()') + ' * 1e2')} AS pct_of_fleet FROM (
  SELECT 'Single-route workhorse (1 route)' AS category, count(*) FILTER (routes_served = 1) AS n FROM c_vehicles
  UNION ALL SELECT 'Light cross-route (2 routes)', count(*) FILTER (routes_served = 2) FROM c_vehicles
  UNION ALL SELECT 'Connector (3-5 routes)', count(*) FILTER (routes_served BETWEEN 3 AND 5) FROM c_vehicles
  UNION ALL SELECT 'High-flexibility (6+ routes)', count(*) FILTER (routes_served >= 6) FROM c_vehicles)""")
def _(d: Domain):
    return net.fleet_flexibility(d.vehicles)


@query("top_connectors", """
SELECT vehicle_id, total_records, days_active, routes_served, primary_route, records_per_active_day FROM c_vehicles
ORDER BY routes_served DESC, total_records DESC, vehicle_id LIMIT 20""")
def _(d: Domain):
    return net.top_connectors(d.vehicles)


@query("stability_score", "SELECT * FROM c_stable_scores")
def _(d: Domain):
    return d.stable_scores


@query("most_least_stable", """
(SELECT 'most_stable' AS listing, route_id, bus_subtype, cv_daily_records, stability_score FROM c_stable_scores
 WHERE is_persistent ORDER BY stability_score DESC, route_id LIMIT 15) UNION ALL
(SELECT 'least_stable', route_id, bus_subtype, cv_daily_records, stability_score FROM c_stable_scores
 WHERE is_persistent ORDER BY cv_daily_records DESC, route_id LIMIT 15)""")
def _(d: Domain):
    return net.most_least_stable(d.stable_scores)


@query("daily_volume_anomalies", f"""
SELECT *, abs(volume_z) > 1.5 AS is_anomaly FROM (SELECT date, day_of_week, total_records,
  {r('coalesce((total_records - avg(total_records) OVER ()) / nullif(stddev_pop(total_records) OVER (), 0e0), 0e0)', 3)} AS volume_z
FROM c_daily)""")
def _(d: Domain):
    return net.daily_volume_anomalies(d.daily)


@query("fragile_critical_routes", """
SELECT s.route_id, d.route_short_name, d.route_long_name, d.bus_subtype, s.mean_daily_records, s.cv_daily_records, s.days_active
FROM c_stability s LEFT JOIN c_dim d ON s.route_id = d.route_id,
  (SELECT quantile_cont(mean_daily_records, 0.75) AS a, quantile_cont(cv_daily_records, 0.75) AS b FROM c_stability WHERE is_persistent) q
WHERE s.is_persistent AND s.mean_daily_records >= q.a AND s.cv_daily_records >= q.b""")
def _(d: Domain):
    return net.fragile_critical_routes(d.stability, d.dim)


@query("weekday_weekend", f"""
SELECT {r('w')} AS weekday_avg_records, {r('e')} AS weekend_avg_records, {r(div('e', 'w') + ' * 1e2', 1)} AS weekend_pct_of_weekday
FROM (SELECT avg(total_records) FILTER (day_of_week NOT IN ('Saturday', 'Sunday')) AS w,
        avg(total_records) FILTER (day_of_week IN ('Saturday', 'Sunday')) AS e FROM c_daily)""")
def _(d: Domain):
    return net.weekday_weekend(d.daily)


@query("night_share", f"""
SELECT bus_subtype, {r(div('sum(records) FILTER (local_hour >= 22 OR local_hour <= 4)', 'sum(records)') + ' * 1e2', 1)} AS night_share_pct
FROM c_profile WHERE bus_subtype = 'NightBus' GROUP BY bus_subtype""")
def _(d: Domain):
    return net.night_share(d.profile)


@query("peak_quiet_hour", f"""
SELECT (t.hour - 7 + 24) % 24 AS peak_hour, t.avg_records AS peak_avg_records, (l.hour - 7 + 24) % 24 AS quiet_hour,
  l.avg_records AS quiet_avg_records, {r(div('t.avg_records', 'l.avg_records'), 1)} AS swing
FROM (SELECT * FROM c_hourly_network ORDER BY avg_records DESC, hour LIMIT 1) t,
     (SELECT * FROM c_hourly_network ORDER BY avg_records, hour LIMIT 1) l""")
def _(d: Domain):
    return net.peak_quiet_hour(act.hourly_network_activity(d.reported))
