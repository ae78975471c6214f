"""End-to-end batch jobs on a real feed: pings and schedule tables in, named tables out.

Each function declares its tables lazily; only the tables that several others read are written to
the shared checkpoint folder first. Nothing loops over routes, dates or files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from pulseline.config import ELIGIBILITY, SPACING, EligibilityRules, SpacingRules
from pulseline.functions import rollups as roll
from pulseline.operators import activity as act
from pulseline.operators import bunching as bun
from pulseline.operators import dimensions as dims
from pulseline.operators import geometry as geo
from pulseline.operators import network as net
from pulseline.operators import scoring as sco
from pulseline.operators import silver as sil
from pulseline.operators import spacing as spc
from pulseline.session import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def network_reliability(
    pings: DataFrame, schedule: Mapping[str, DataFrame], route_names: Sequence[str] | None = None, tz: str = "UTC",
    eligibility_rules: EligibilityRules = ELIGIBILITY, spacing: SpacingRules = SPACING,
) -> dict[str, DataFrame]:
    """From raw pings and the five schedule tables to the gold reliability tables.

    `route_names` limits the scored routes by public code; every route is used otherwise. Each
    route is scored on its newest eligible service day.
    """
    routes, trips, stops = schedule["routes"], schedule["trips"], schedule["stops"]
    shapes, stop_times = schedule["shapes"], schedule["stop_times"]

    raw = pings if "event_id" in pings.columns else sil.with_event_id(pings)
    silver = sil.silver_positions(raw, tz=tz)
    eligibility = sco.route_eligibility(
        sco.route_hourly_stability(silver), sco.route_quality_summary(silver), eligibility_rules
    )
    scored = routes if route_names is None else routes.where(F.col("route_short_name").isin(*route_names))
    newest = sco.latest_eligible_date(dims.semi_filter(silver, scored, "route_id"), eligibility)
    enriched = sil.silver_enriched(newest, trips).where(F.col("shape_id").isNotNull())

    lengths = dims.shape_distance_summary(shapes)
    projected = spc.with_shape_length(geo.project_to_shape(enriched, shapes), lengths)
    clean = spc.projection_filter(projected, spacing.max_projection_error_m)
    in_service = spc.terminal_buffer(clean, spacing.terminal_buffer_km)
    headways = _written(spc.observed_headways(in_service), "headways")

    events = spc.bunching_events(headways, tz, spacing)
    hotspots = _written(bun.with_route_names(bun.bunching_hotspots(events), routes), "hotspots")
    scores = _written(
        bun.with_route_names(sco.reliability_scores(headways, tz=tz, spacing=spacing), routes), "scores"
    )
    stop_ref = geo.stop_reference(stop_times, trips, stops)
    return {
        "route_eligibility_summary": eligibility,
        "observed_headways": headways,
        "bunching_events": events,
        "bunching_hotspots": hotspots,
        "bunching_hotspots_with_stops": geo.hotspots_with_stops(hotspots, stop_ref, spacing.segment_km),
        "hourly_bunching_pattern": bun.with_route_names(bun.hourly_bunching(events), routes),
        "route_reliability_scores": scores,
        "route_type_summary": sco.route_type_summary(scores),
        "corridor_priority_ranking": sco.corridor_priority(scores, hotspots),
    }


def activity_metrics(pings: DataFrame) -> dict[str, DataFrame]:
    """The activity tables of a ping window."""
    timed = sil.time_columns(pings)
    cells = _written(roll.cells(timed, roll.ACTIVITY_GRAIN), "cells")  # one scan for five tables
    stability = act.route_daily_stability(timed)
    return {
        "daily_summary": act.daily_summary(cells),
        "route_activity_summary": act.route_activity(cells),
        "hourly_network_activity": act.hourly_network_activity(cells),
        "route_hour_heatmap": act.route_hour_heatmap(cells),
        "vehicle_activity_summary": act.vehicle_activity(cells),
        "telemetry_quality_summary": act.daily_quality_fingerprint(timed),
        "route_stability_summary": stability,
        "outlier_routes": act.outlier_routes(stability),
        "gps_update_frequency": act.gps_update_frequency(pings),
        "route_avg_speed": act.route_speed_stats(pings),
        "route_coverage": act.route_coverage(timed),
        "stationary_vehicles": act.stationary_vehicles(pings),
    }


def network_intelligence(metrics: Mapping[str, DataFrame], routes: DataFrame) -> dict[str, DataFrame]:
    """The five intelligence layers on the tables of `activity_metrics`."""
    activity = _written(metrics["route_activity_summary"], "activity")
    stability = _written(metrics["route_stability_summary"], "stability")
    vehicles = _written(metrics["vehicle_activity_summary"], "vehicles")
    heatmap = _written(metrics["route_hour_heatmap"], "heatmap")
    daily, hourly = metrics["daily_summary"], metrics["hourly_network_activity"]
    dim = net.route_dimension(routes, activity)
    enriched = net.enrich_activity(activity, dim)
    profile = net.subtype_hourly_profile(heatmap, dim)
    scores = net.stability_score(stability, dim)
    feeders = net.feeder_hourly(heatmap, dim)
    return {
        "modal_activity_share": net.modal_activity_share(enriched),
        "modal_telemetry_coverage": net.modal_coverage(dim),
        "bus_subtype_share": net.bus_subtype_share(enriched),
        "top_corridors": net.top_corridors(enriched),
        "pareto_concentration": net.pareto_concentration(enriched),
        "subtype_hourly_profile": profile,
        "subtype_temporal_correlation": net.subtype_correlation(profile),
        "subtype_peak_windows": net.peak_windows(profile),
        "peak_and_quiet_hour": net.peak_quiet_hour(hourly),
        "weekday_weekend": net.weekday_weekend(daily),
        "operational_stability_score": scores,
        "most_and_least_stable_routes": net.most_least_stable(scores),
        "subtype_variability_profile": net.subtype_variability(stability, dim),
        "feeder_routes": net.feeder_routes(dim, activity),
        "feeder_hourly": feeders,
        "feeder_peak_hours": net.feeder_peak_hours(feeders),
        "fleet_flexibility": net.fleet_flexibility(vehicles),
        "top_connector_vehicles": net.top_connectors(vehicles),
        "network_centralization": net.network_centralization(activity, stability),
        "telemetry_blind_spots": net.telemetry_blind_spots(routes, activity),
        "daily_volume_anomalies": net.daily_volume_anomalies(daily),
        "fragile_critical_routes": net.fragile_critical_routes(stability, dim),
    }
