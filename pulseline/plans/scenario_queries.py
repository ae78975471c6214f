"""Scenario-stress, narrative and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseline.config import SCENARIO
from pulseline.operators import geometry as geo
from pulseline.operators import gold, scoring
from pulseline.operators import scenario as sc
from pulseline.plans.domain import Domain
from pulseline.plans.registry import cte, div, gavg, query, r

MATCH = SCENARIO.primary
LABEL = "a PM-peak match"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


cte("c_tags", f"""
SELECT p.*, CAST(route_short_name IN {_in(SCENARIO.bc_place)} AS INT) AS bc_place_exposure,
  CAST(route_short_name IN {_in(SCENARIO.downtown)} AS INT) AS downtown_exposure,
  CAST(route_short_name IN {_in(SCENARIO.festival)} AS INT) AS fan_festival_exposure,
  CAST(route_long_name LIKE '%Station%' AS INT) AS skytrain_connector_exposure,
  coalesce(CAST(peak_bunching_share_pct >= m.a AS INT), 0) AS pm_peak_vulnerability,
  CAST(reliability_score < m.b AS INT) AS existing_reliability_weakness,
  CAST(route_short_name IN {_in(SCENARIO.extra_service)} AS INT) AS has_extra_service
FROM c_priority p, (SELECT median(peak_bunching_share_pct) AS a, median(reliability_score) AS b FROM c_priority) m""")
_UPLIFT = " + ".join(f"{w}e0 * {n}" for n, _, w in SCENARIO.exposures)
cte("c_base", f"""
SELECT *, least(1e0 + exposure_uplift, 2.5e0) AS stress_multiplier FROM (
  SELECT *, {r(_UPLIFT, 4)} AS exposure_uplift,
    {r('(100e0 - reliability_score) + bunching_rate_pct + 2e0 * severe_bunching_rate_pct', 4)} AS base_fragility FROM c_tags)""")


def _raw(p: str) -> str:
    return f"base_fragility * stress_multiplier * (1e0 + {p}) * CASE WHEN has_extra_service = 1 THEN 0.85e0 ELSE 1e0 END"


cte("c_stress", f"""
SELECT *, CASE WHEN fifa_stress_score < 25 THEN 'Low' WHEN fifa_stress_score < 45 THEN 'Medium'
  WHEN fifa_stress_score < 65 THEN 'High' ELSE 'Critical' END AS fifa_risk_band
FROM (SELECT *, {r("CASE WHEN max(raw_stress) OVER () = min(raw_stress) OVER () THEN 50e0 ELSE (raw_stress - min(raw_stress) OVER ()) / (max(raw_stress) OVER () - min(raw_stress) OVER ()) * 1e2 END")} AS fifa_stress_score
  FROM (SELECT *, {r(_raw('0.55e0'), 4)} AS raw_stress FROM c_base))""")
cte("c_long", " UNION ALL ".join(
    f"SELECT route_short_name, route_type, '{n}' AS scenario, {_raw(f'{p}e0')} AS raw FROM c_base" for n, p in SCENARIO.pressures))
_NAMES = [n for n, _ in SCENARIO.pressures]
_WIDE = ", ".join(f"max(score) FILTER (scenario = '{n}') AS {n}" for n in _NAMES)
cte("c_matrix", f"""
SELECT route_short_name, route_type, {_WIDE} FROM (
  SELECT l.*, {r('l.raw / m.ref * 1e2')} AS score FROM c_long l, (SELECT coalesce(nullif(max({_raw('0.8e0')}), 0e0), 1e0) AS ref FROM c_base) m)
GROUP BY route_short_name, route_type""")
cte("c_matrix_minmax", f"""
SELECT route_short_name, route_type, {_WIDE} FROM (SELECT *, {r("CASE WHEN max(x) OVER w = min(x) OVER w THEN 50e0 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 1e2 END")} AS score
  FROM (SELECT *, {r('raw', 4)} AS x FROM c_long) WINDOW w AS (PARTITION BY scenario))
GROUP BY route_short_name, route_type""")


def _band(c: str) -> str:
    return f"CASE WHEN {c} < 25 THEN 'Low' WHEN {c} < 45 THEN 'Medium' WHEN {c} < 65 THEN 'High' ELSE 'Critical' END"


cte("c_scen", f"SELECT route_short_name, route_type, {MATCH} AS fifa_stress_score, {_band(MATCH)} AS fifa_risk_band FROM c_matrix")


def _adjust(rel: str) -> str:
    return f"""
SELECT *, {r('reliability_score - fifa_adjusted_reliability')} AS reliability_drop FROM (
  SELECT s.*, p.reliability_score, {r('s.fifa_stress_score / 1e2 * 25e0', 4)} AS fifa_penalty,
    {r('least(greatest(p.reliability_score - s.fifa_stress_score / 1e2 * 25e0, 0e0), 1e2)')} AS fifa_adjusted_reliability
  FROM {rel} s LEFT JOIN (SELECT route_short_name, reliability_score FROM c_scores) p ON s.route_short_name = p.route_short_name)"""


cte("c_stress_only", "SELECT * EXCLUDE (reliability_score) FROM c_stress")
cte("c_adjusted", _adjust("c_stress_only"))
cte("c_ranked", """
SELECT *, row_number() OVER (ORDER BY fifa_stress_score DESC, route_short_name) AS fifa_priority_rank FROM c_adjusted""")
cte("c_delta", f"""
SELECT route_short_name, route_type, normal_day AS stress_normal, {MATCH} AS stress_scenario, {r(f'{MATCH} - normal_day')} AS stress_delta,
  {_band('normal_day')} AS band_normal, {_band(MATCH)} AS band_scenario FROM c_matrix""")


class _Stress:
    """Scenario tables of one domain, declared on demand."""

    def __init__(self, d: Domain, with_hotspots: bool = False):
        self.priority = d.gold_both if with_hotspots else d.gold_priority
        self.base = sc.stress_base(self.priority)
        self.stress = sc.stress_scores_minmax(self.base)
        self.adjusted = sc.adjusted_reliability(self.stress, self.priority)
        self.ranked = sc.stress_ranking(self.adjusted)

    @property
    def matrix(self):
        return sc.scenario_matrix(self.base)


@query("exposure_tags", "SELECT * FROM c_tags")
def _(d: Domain):
    return sc.exposure_tags(d.gold_priority)


@query("stress_multiplier", "SELECT route_short_name, exposure_uplift, stress_multiplier FROM c_base")
def _(d: Domain):
    return _Stress(d).base.select("route_short_name", "exposure_uplift", "stress_multiplier")


@query("base_fragility", "SELECT route_short_name, base_fragility FROM c_base")
def _(d: Domain):
    return _Stress(d).base.select("route_short_name", "base_fragility")


@query("reliability_anatomy", f"""
SELECT route_short_name, component, {r('contribution')} AS contribution FROM (
  SELECT route_short_name, 'Reliability gap (100 - score)' AS component, 1e2 - reliability_score AS contribution FROM c_base
  UNION ALL SELECT route_short_name, 'Bunching rate', bunching_rate_pct FROM c_base
  UNION ALL SELECT route_short_name, 'Severe bunching (weighted ×2)', 2e0 * severe_bunching_rate_pct FROM c_base)""")
def _(d: Domain):
    return sc.reliability_anatomy(_Stress(d).base)


@query("stress_scores_minmax", "SELECT route_short_name, raw_stress, fifa_stress_score, fifa_risk_band FROM c_stress")
def _(d: Domain):
    return _Stress(d).stress.select("route_short_name", "raw_stress", "fifa_stress_score", "fifa_risk_band")


@query("scenario_matrix", "SELECT * FROM c_matrix")
def _(d: Domain):
    return _Stress(d).matrix


@query("scenario_matrix_minmax", "SELECT * FROM c_matrix_minmax")
def _(d: Domain):
    return sc.scenario_matrix_minmax(_Stress(d).base)


@query("scenario_scores", "SELECT * FROM c_scen")
def _(d: Domain):
    return sc.scenario_scores(_Stress(d).matrix, MATCH)


@query("adjusted_reliability", f"SELECT * FROM ({_adjust('c_scen')})")
def _(d: Domain):
    s = _Stress(d)
    return sc.adjusted_reliability(sc.scenario_scores(s.matrix, MATCH), s.priority)


@query("scenario_delta", "SELECT * FROM c_delta")
def _(d: Domain):
    return sc.scenario_delta(_Stress(d).matrix, MATCH)


@query("scenario_band_counts", """
SELECT b AS fifa_risk_band, count(s.route_short_name) AS routes FROM (SELECT unnest(['Low', 'Medium', 'High', 'Critical']) AS b) x
LEFT JOIN c_scen s ON s.fifa_risk_band = x.b GROUP BY b""")
def _(d: Domain):
    return sc.scenario_band_counts(sc.scenario_scores(_Stress(d).matrix, MATCH))


_RANK = ["fifa_priority_rank", "route_short_name", "route_type", "reliability_score", "fifa_adjusted_reliability",
         "reliability_drop", "stress_multiplier", "fifa_stress_score", "fifa_risk_band", "has_extra_service"]


@query("stress_ranking", f"SELECT {', '.join(_RANK)} FROM c_ranked")
def _(d: Domain):
    return _Stress(d).ranked.select(*_RANK)


@query("stress_by_type", f"""
SELECT route_type, count(*) AS routes, {r(gavg('reliability_score', 2))} AS avg_baseline_rel,
  {r(gavg('fifa_adjusted_reliability', 2))} AS avg_fifa_adj_rel, {r(gavg('fifa_stress_score', 2))} AS avg_stress,
  {r(gavg('reliability_drop', 2))} AS avg_drop FROM c_ranked GROUP BY route_type""")
def _(d: Domain):
    return sc.stress_by_type(_Stress(d).ranked)


_PARTS = " UNION ALL ".join(
    ["SELECT route_short_name, 'Baseline reliability weakness' AS component, base_fragility * 0.5e0 AS w FROM c_base"]
    + [f"SELECT route_short_name, '{label}', base_fragility * {w}e0 FROM c_base WHERE {n} = 1" for n, label, w in SCENARIO.exposures]
    + ["SELECT route_short_name, 'FIFA scenario pressure', base_fragility * 0.55e0 FROM c_base"])


@query("stress_decomposition", f"""
SELECT route_short_name, component, {r('w', 4)} AS raw_weight, {r('w / CASE WHEN t = 0 THEN 1e0 ELSE t END * 1e2', 1)} AS share_pct
FROM (SELECT *, sum(w) OVER (PARTITION BY route_short_name) AS t FROM ({_PARTS}))""")
def _(d: Domain):
    return sc.stress_decomposition(_Stress(d).base, MATCH)


_A, _B = "R10", "099"
_PAIR = " UNION ALL ".join(
    f"SELECT route_short_name, '{label}' AS metric, CAST({c} AS DOUBLE) AS value, {str(worse).lower()} AS worse FROM c_ranked "
    f"WHERE route_short_name IN ('{_A}', '{_B}')" for c, label, worse in sc.PAIR_METRICS)


@query("pair_normalized", f"""
SELECT route_short_name, metric, value, {r('CASE WHEN worse THEN n ELSE 1e0 - n END', 4)} AS risk FROM (
  SELECT *, CASE WHEN max(value) OVER w = min(value) OVER w THEN 0.5e0
    ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END AS n
  FROM ({_PAIR}) WINDOW w AS (PARTITION BY metric))""")
def _(d: Domain):
    return sc.pair_normalized(_Stress(d).ranked, _A, _B)


@query("pair_verdict", f"""
SELECT route_short_name AS worse_route, fifa_stress_score AS stress FROM c_ranked WHERE route_short_name IN ('{_A}', '{_B}')
ORDER BY fifa_stress_score DESC, route_short_name <> '{_A}' LIMIT 1""")
def _(d: Domain):
    return sc.pair_verdict(_Stress(d).ranked, _A, _B)


@query("route_comparison", f"""
SELECT p.*, a.fifa_stress_score, a.fifa_risk_band, a.fifa_adjusted_reliability, a.reliability_drop, h.hotspot_count, h.severe_total
FROM c_priority p LEFT JOIN c_adjusted a ON p.route_short_name = a.route_short_name
LEFT JOIN (SELECT route_short_name, count(*) AS hotspot_count, CAST(sum(severe_events) AS BIGINT) AS severe_total
           FROM c_hotspots GROUP BY route_short_name) h ON p.route_short_name = h.route_short_name
WHERE p.route_short_name IN ('{_A}', '{_B}')""")
def _(d: Domain):
    s = _Stress(d, True)
    return sc.route_comparison(s.priority, s.adjusted, d.gold_hotspots, _A, _B)


@query("route_record", f"""
SELECT p.route_short_name, p.route_long_name, p.intervention_priority_score, p.hotspot_segments, s.reliability_score,
  s.reliability_band, s.bunching_rate_pct, f.stress_multiplier, f.fifa_stress_score, f.fifa_risk_band
FROM c_priority p LEFT JOIN c_scores s ON p.route_short_name = s.route_short_name
LEFT JOIN c_stress f ON p.route_short_name = f.route_short_name WHERE p.route_short_name = '{_B}'""")
def _(d: Domain):
    s = _Stress(d)
    return sc.route_record(_B, s.priority, s.priority, s.stress)


@query("hotspot_risk_overlay", f"""
SELECT h.*, s.fifa_stress_score, s.fifa_risk_band, s.fifa_priority_rank,
  {r('(h.bunching_events + 3 * h.severe_events) * (s.fifa_stress_score / 1e2)')} AS hotspot_risk_score
FROM c_hot_stops h LEFT JOIN c_ranked s ON h.route_short_name = s.route_short_name
ORDER BY hotspot_risk_score DESC NULLS LAST, h.route_short_name, direction_id, shape_id, route_segment_km LIMIT 15""")
def _(d: Domain):
    s = _Stress(d, True)
    return sc.hotspot_risk_overlay(geo.hotspots_with_stops(d.gold_hotspots, d.stop_ref), s.ranked)


@query("executive_callouts", f"""
(SELECT 'Most vulnerable route' AS title, route_short_name AS route, {r('fifa_stress_score')} AS value FROM c_ranked
 ORDER BY fifa_stress_score DESC, route_short_name LIMIT 1) UNION ALL
(SELECT 'Largest FIFA reliability drop', route_short_name, {r('reliability_drop')} FROM c_ranked
 ORDER BY reliability_drop DESC, route_short_name LIMIT 1) UNION ALL
(SELECT 'Most severe hotspot corridor', route_short_name, {r('CAST(sum(severe_events) AS DOUBLE)')} FROM c_hotspots GROUP BY route_short_name
 ORDER BY sum(severe_events) DESC, route_short_name LIMIT 1) UNION ALL
(SELECT 'Highest intervention priority', route_short_name, {r('intervention_priority_score')} FROM c_priority
 ORDER BY intervention_priority_score DESC, route_short_name LIMIT 1)""")
def _(d: Domain):
    s = _Stress(d, True)
    return sc.executive_callouts(s.ranked, d.gold_hotspots, s.priority)


@query("extra_service_gap", f"""
SELECT route_short_name, CASE WHEN route_short_name IN (SELECT route_short_name FROM c_priority) THEN 'monitored' ELSE 'gap' END AS status
FROM (SELECT unnest([{', '.join(repr(x) for x in SCENARIO.extra_service)}]) AS route_short_name)""")
def _(d: Domain):
    return sc.extra_service_gap(d.gold_priority)


@query("frame_quality_gate", """
SELECT count(*) AS row_count, count(route_id) - count(DISTINCT route_id) AS duplicate_keys,
  count(*) FILTER (peak_bunching_share_pct IS NULL) + count(*) FILTER (route_long_name IS NULL) AS null_cells,
  count(*) FILTER (reliability_score NOT BETWEEN 0 AND 100) AS score_out_of_range,
  count(*) FILTER (bunching_rate_pct < 0) AS negative_rates FROM c_priority""")
def _(d: Domain):
    return sc.frame_quality_gate(d.gold_priority)


@query("stress_headline", """
SELECT count(*) FILTER (fifa_risk_band IN ('High', 'Critical')) AS high_or_critical,
  count(*) FILTER (existing_reliability_weakness = 1) AS already_weak,
  coalesce(string_agg(route_short_name, ', ' ORDER BY fifa_priority_rank) FILTER (fifa_priority_rank <= 3), '') AS top_three,
  coalesce(string_agg(route_short_name, ', ' ORDER BY fifa_priority_rank) FILTER (fan_festival_exposure = 1), '') AS festival_routes
FROM c_ranked""")
def _(d: Domain):
    return sc.stress_headline(_Stress(d).ranked)


def _int(e: str) -> str:
    return f"CAST(CAST({r(e, 0)} AS BIGINT) AS VARCHAR)"


_REASONS = ("list_filter([CASE WHEN existing_reliability_weakness = 1 THEN 'already-elevated bunching' END, "
            "CASE WHEN bc_place_exposure = 1 OR downtown_exposure = 1 THEN 'a downtown / BC Place corridor' END, "
            "CASE WHEN fan_festival_exposure = 1 THEN 'Fan Festival access to Hastings Park' END, "
            "CASE WHEN pm_peak_vulnerability = 1 THEN 'strong peak-period concentration' END, "
            "CASE WHEN skytrain_connector_exposure = 1 THEN 'a SkyTrain transfer point' END], lambda x: x IS NOT NULL)")
_HEAD = "'Route ' || route_short_name || ' (' || route_long_name || ')'"
_RELIEF = "CASE WHEN has_extra_service = 1 THEN ' Announced extra service partly offsets this.' ELSE '' END"


_ROUTE_TEXT = f"""
SELECT route_short_name, CASE
  WHEN fifa_risk_band IN ('High', 'Critical') THEN {_HEAD} || ' is ' || lower(fifa_risk_band) || '-risk under {LABEL}'
    || CASE WHEN len(z) > 0 THEN ' because it combines ' || array_to_string(z[1:3], ', ') || '.' ELSE '.' END
    || ' Projected reliability falls about ' || {_int('reliability_drop')} || ' points, from ' || {_int('reliability_score')} || '.' || {_RELIEF}
  WHEN fifa_risk_band = 'Medium' THEN {_HEAD} || ' sees moderate degradation under {LABEL}'
    || CASE WHEN len(z) > 0 THEN ' — driven by ' || array_to_string(z[1:2], ', ') || '.' ELSE '.' END
    || ' Reliability eases ~' || {_int('reliability_drop')} || ' points but stays workable.' || {_RELIEF}
  ELSE {_HEAD} || ' stays low-risk under {LABEL}, benefiting from a strong baseline (' || {_int('reliability_score')}
    || ') and limited venue exposure.' || {_RELIEF} END AS narrative
FROM (SELECT *, {_REASONS} AS z FROM c_adjusted)"""
_HOTSPOT_TEXT = f"""
SELECT route_short_name, direction_id, shape_id, route_segment_km,
  'Between ' || coalesce(stop_before_name, 'None') || ' and ' || coalesce(stop_after_name, 'None') || ', route ' || route_short_name
  || ' recorded ' || bunching_events || ' bunching events'
  || CASE WHEN severe_events > 0 THEN ' including ' || severe_events || ' severe events' ELSE '' END
  || ' with a median spacing gap of about ' || {_int('median_gap_km * 1000')} || ' m. This represents '
  || CASE WHEN severe_events >= 5 OR bunching_events >= 80 THEN 'one of the most severe reliability issues in the monitored network'
       WHEN bunching_events >= 30 THEN 'a recurring reliability pressure point' ELSE 'a localized issue' END || '.' AS narrative
FROM c_hot_stops"""


@query("route_narratives", _ROUTE_TEXT)
def _(d: Domain):
    return sc.route_narratives(_Stress(d).adjusted, LABEL)


@query("hotspot_narratives", _HOTSPOT_TEXT)
def _(d: Domain):
    return sc.hotspot_narratives(d.hot_stops)


@query("row_narratives", f"""
SELECT 'route' AS kind, route_short_name, narrative FROM ({_ROUTE_TEXT})
UNION ALL SELECT 'hotspot', route_short_name, narrative FROM ({_HOTSPOT_TEXT})""")
def _(d: Domain):
    s = _Stress(d, True)
    routes = sc.route_narratives(s.adjusted, LABEL).withColumn("kind", F.lit("route"))
    spots = sc.hotspot_narratives(geo.hotspots_with_stops(d.gold_hotspots, d.stop_ref)).withColumn("kind", F.lit("hotspot"))
    fields = ["kind", "route_short_name", "narrative"]
    return routes.select(*fields).unionByName(spots.select(*fields))


@query("verdict_sentence", f"""
SELECT (SELECT count(*) FROM c_priority WHERE reliability_score < (SELECT median(reliability_score) FROM c_priority)) || ' of '
  || (SELECT count(*) FROM c_priority) || ' corridors are fragile (below-median reliability). '
  || count(*) FILTER (fifa_risk_band IN ('High', 'Critical')) || ' go FIFA-critical under {LABEL}. Top concern: route '
  || first(route_short_name ORDER BY fifa_priority_rank) || ' (' || first(route_long_name ORDER BY fifa_priority_rank) || ').' AS verdict
FROM c_ranked""")
def _(d: Domain):
    s = _Stress(d)
    return sc.verdict_sentence(s.priority, s.ranked, LABEL)


@query("display_top_n", """
(SELECT 'scenario_delta' AS listing, route_short_name, stress_delta AS value FROM c_delta ORDER BY stress_delta DESC, route_short_name LIMIT 12)
UNION ALL (SELECT 'adjusted_reliability', route_short_name, fifa_adjusted_reliability FROM c_adjusted
  ORDER BY fifa_adjusted_reliability, route_short_name LIMIT 12)
UNION ALL (SELECT 'stress', route_short_name, fifa_stress_score FROM c_ranked ORDER BY fifa_stress_score DESC, route_short_name LIMIT 10)""")
def _(d: Domain):
    s = _Stress(d)
    return sc.display_top_n(sc.scenario_delta(s.matrix, MATCH), s.adjusted, s.ranked)


# --- curated gold lookups -----------------------------------------------------------------------------

@query("gold_lookup", """
SELECT s.route_short_name, s.route_long_name, s.reliability_score, s.reliability_band, s.total_bunching_events, p.intervention_priority_score
FROM c_scores s JOIN c_priority p ON s.route_id = p.route_id WHERE s.route_short_name = '099' OR s.route_long_name = 'CANADA Station'""")
def _(d: Domain):
    return gold.lookup(d.gold_priority, d.gold_priority, short="099", long="CANADA Station")


@query("gold_ranking", """
(SELECT 'bunching_rate' AS ranking, route_short_name, bunching_rate_pct AS value FROM c_scores ORDER BY value DESC, route_short_name LIMIT 5)
UNION ALL (SELECT 'priority', route_short_name, intervention_priority_score FROM c_priority
  ORDER BY intervention_priority_score DESC, route_short_name LIMIT 5)
UNION ALL (SELECT 'severe_events', route_short_name, CAST(severe_events AS DOUBLE) FROM c_scores ORDER BY severe_events DESC, route_short_name LIMIT 5)
UNION ALL (SELECT 'least_reliable', route_short_name, reliability_score FROM c_scores ORDER BY reliability_score, route_short_name LIMIT 5)""")
def _(d: Domain):
    return gold.rankings(d.gold_priority, d.gold_priority)


@query("gold_comparison", """
SELECT route_short_name, reliability_score, reliability_band, bunching_rate_pct, severe_events, total_bunching_events
FROM c_scores WHERE route_short_name IN ('099', 'R10') ORDER BY reliability_score DESC""")
def _(d: Domain):
    return gold.comparison(d.scores, "099", "R10")


@query("gold_type_compare", f"""
SELECT route_type, count(*) AS route_count, {r(gavg('reliability_score', 2))} AS avg_reliability_score,
  {r(gavg('bunching_rate_pct', 2))} AS avg_bunching_rate_pct FROM c_scores WHERE route_type IN ('RapidBus', 'Regular Bus') GROUP BY route_type""")
def _(d: Domain):
    return gold.type_compare(scoring.route_type_summary(d.scores), "RapidBus", "Regular Bus")


@query("gold_pm_peak_worst", """
SELECT route_short_name, route_long_name, CAST(sum(bunching_events) AS BIGINT) AS pm_peak_bunching_events,
  CAST(sum(severe_events) AS BIGINT) AS pm_peak_severe_events FROM c_hourly WHERE peak_period = 'PM Peak'
GROUP BY route_short_name, route_long_name ORDER BY pm_peak_bunching_events DESC, route_short_name LIMIT 5""")
def _(d: Domain):
    return gold.pm_peak_worst(d.hourly)


@query("gold_busiest_hour", """
SELECT hour_of_day, peak_period, CAST(sum(bunching_events) AS BIGINT) AS total_bunching_events FROM c_hourly
GROUP BY hour_of_day, peak_period ORDER BY total_bunching_events DESC, hour_of_day LIMIT 1""")
def _(d: Domain):
    return gold.busiest_hour(d.hourly)


@query("gold_network_total", "SELECT CAST(sum(total_bunching_events) AS BIGINT) AS network_total_bunching_events FROM c_scores")
def _(d: Domain):
    return gold.network_total(d.scores)


@query("gold_route_hotspot", """
SELECT route_short_name, stop_before_name, stop_after_name, bunching_events FROM c_hot_stops WHERE route_short_name = 'R10'
ORDER BY bunching_events DESC, direction_id, shape_id, route_segment_km LIMIT 1""")
def _(d: Domain):
    return gold.route_hotspot(d.hot_stops, "R10")


@query("exposed_columns", """
SELECT * FROM (SELECT route_short_name, route_long_name, route_type, total_spacing_rows, total_bunching_events, severe_events,
  peak_events, bunching_rate_pct, severe_bunching_rate_pct, peak_bunching_share_pct, reliability_score, reliability_band
FROM c_scores)""")
def _(d: Domain):
    return gold.exposed_view("route_reliability_scores", d.scores)


@query("exposed_hourly", "SELECT * EXCLUDE (route_id) REPLACE (CAST(service_date AS VARCHAR) AS service_date) FROM c_hourly")
def _(d: Domain):
    return gold.exposed_view("hourly_bunching_pattern", d.hourly)


@query("exposed_hotspots", "SELECT * EXCLUDE (route_id, shape_id, stop_before_id, stop_after_id) FROM c_hot_stops")
def _(d: Domain):
    return gold.exposed_view("bunching_hotspots_with_stops", d.hot_stops)
