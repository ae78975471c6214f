"""Curated reads of the gold tables: lookups, rankings, comparisons and exposed views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Gold tables open to analysts, and their identifiers that stay hidden.
EXPOSED = {
    "route_reliability_scores": ("route_id",),
    "corridor_priority_ranking": ("route_id",),
    "hourly_bunching_pattern": ("route_id",),
    "bunching_hotspots_with_stops": ("route_id", "shape_id", "stop_before_id", "stop_after_id"),
    "route_type_summary": (),
}


def exposed_view(name: str, table: DataFrame) -> DataFrame:
    """A read view of an open table: all its rows, without the hidden identifiers.

    Order and page size belong to the caller.
    """
    if name not in EXPOSED:
        raise PermissionError(f"table {name} is not open to questions")
    return table.select(*[c for c in table.columns if c not in EXPOSED[name]])


def lookup(scores: DataFrame, priority: DataFrame, short: str | None = None, long: str | None = None) -> DataFrame:
    wanted = (F.col("route_short_name") == F.lit(short)) | (F.col("route_long_name") == F.lit(long))
    found = scores.where(wanted).select("route_id", "route_short_name", "route_long_name", "reliability_score",
                                        "reliability_band", "total_bunching_events")
    return found.join(priority.select("route_id", "intervention_priority_score"), "route_id").drop("route_id")


def top(table: DataFrame, measure: str, n: int = 5, descending: bool = True) -> DataFrame:
    order = F.desc(measure) if descending else F.asc(measure)
    return table.orderBy(order, "route_short_name").limit(n).select(
        "route_short_name", F.col(measure).cast("double").alias("value")
    )


def rankings(scores: DataFrame, priority: DataFrame) -> DataFrame:
    parts = (
        ("bunching_rate", scores, "bunching_rate_pct", True),
        ("priority", priority, "intervention_priority_score", True),
        ("severe_events", scores, "severe_events", True),
        ("least_reliable", scores, "reliability_score", False),
    )
    out = None
    for name, table, measure, down in parts:
        one = top(table, measure, descending=down).withColumn("ranking", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def comparison(scores: DataFrame, a: str, b: str) -> DataFrame:
    return scores.where(F.col("route_short_name").isin(a, b)).select(
        "route_short_name", "reliability_score", "reliability_band", "bunching_rate_pct", "severe_events",
        "total_bunching_events",
    ).orderBy(F.desc("reliability_score"))


def type_compare(summary: DataFrame, a: str, b: str) -> DataFrame:
    return summary.where(F.col("route_type").isin(a, b)).select(
        "route_type", "route_count", "avg_reliability_score", "avg_bunching_rate_pct")


def pm_peak_worst(hourly: DataFrame, n: int = 5) -> DataFrame:
    return (
        hourly.where(F.col("peak_period") == "PM Peak").groupBy("route_short_name", "route_long_name")
        .agg(F.sum("bunching_events").alias("pm_peak_bunching_events"),
             F.sum("severe_events").alias("pm_peak_severe_events"))
        .orderBy(F.desc("pm_peak_bunching_events"), "route_short_name").limit(n)
    )


def busiest_hour(hourly: DataFrame) -> DataFrame:
    return (
        hourly.groupBy("hour_of_day", "peak_period").agg(F.sum("bunching_events").alias("total_bunching_events"))
        .orderBy(F.desc("total_bunching_events"), "hour_of_day").limit(1)
    )


def network_total(scores: DataFrame) -> DataFrame:
    return scores.agg(F.sum("total_bunching_events").alias("network_total_bunching_events"))


def route_hotspot(hot_stops: DataFrame, route: str) -> DataFrame:
    return (
        hot_stops.where(F.col("route_short_name") == route)
        .orderBy(F.desc("bunching_events"), "direction_id", "shape_id", "route_segment_km").limit(1)
        .select("route_short_name", "stop_before_name", "stop_after_name", "bunching_events")
    )
