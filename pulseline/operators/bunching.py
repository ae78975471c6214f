"""Aggregates over bunching events: summaries, hotspots, hourly pattern and their consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseline.functions import columns as C


def _severity_counts():
    sev = F.col("bunching_severity")
    return [
        F.count(F.lit(1)).alias("bunching_events"),
        F.count_if(sev == "Severe").alias("severe_events"),
        F.count_if(sev == "High").alias("high_events"),
        F.count_if(sev == "Moderate").alias("moderate_events"),
    ]


def _gap_stats(low: bool = True):
    gap = F.col("distance_to_next_bus_km")
    # gaps are multiples of 0.0001 km up to the moderate limit: a median buffer holds <= 5001 values
    out = [C.rnd(C.grid_avg(gap, 4), 3).alias("avg_gap_km"), C.rnd(F.median(gap), 3).alias("median_gap_km")]
    return out + ([C.rnd(F.min(gap), 3).alias("closest_gap_km")] if low else [])


def bunching_summary(events: DataFrame) -> DataFrame:
    """Per service date and route: events by severity and part of day, gaps, reach."""
    return events.groupBy("service_date", "route_id").agg(
        *_severity_counts(),
        F.count_if(F.col("peak_period") == "AM Peak").alias("am_peak_events"),
        F.count_if(F.col("peak_period") == "PM Peak").alias("pm_peak_events"),
        F.count_if(F.col("peak_period") == "Off Peak").alias("off_peak_events"),
        *_gap_stats(),
        F.count_distinct("vehicle_id").alias("vehicles_involved"),
        F.count_distinct("route_segment_km").alias("affected_segments"),
    )


def bunching_hotspots(events: DataFrame) -> DataFrame:
    """Per half-kilometre segment of every route, direction and shape."""
    return events.groupBy("route_id", "direction_id", "shape_id", "route_segment_km").agg(
        *_severity_counts(), *_gap_stats(),
        F.count_distinct("vehicle_id").alias("vehicles_involved"),
        F.count_distinct("collection_timestamp").alias("active_timestamps"),
    )


def hourly_bunching(events: DataFrame) -> DataFrame:
    return events.groupBy("service_date", "route_id", "hour_of_day", "peak_period").agg(
        *_severity_counts(), *_gap_stats(low=False)
    )


def with_route_names(table: DataFrame, routes: DataFrame) -> DataFrame:
    """Attach public names and the service class to a route-grained table, after aggregation."""
    names = routes.select(
        "route_id", "route_short_name", "route_long_name",
        C.route_class("route_short_name").alias("route_type"),
    )
    return table.join(names, "route_id", "left")


def hotspot_filter(
    hotspots: DataFrame, route: str | None = None, severity_mode: str = "all", min_events: int = 0
) -> DataFrame:
    """Explorer filters: one route, severity mode all / any_severe / severe_heavy, event floor."""
    floor = {"all": 0, "any_severe": 1, "severe_heavy": 5}[severity_mode]
    out = hotspots.where((F.col("severe_events") >= floor) & (F.col("bunching_events") >= min_events))
    return out if route is None else out.where(F.col("route_short_name") == route)


def hourly_curve(hourly: DataFrame, route: str | None = None) -> DataFrame:
    """Events and severe events by hour, of one route or of the network."""
    out = hourly if route is None else hourly.where(F.col("route_short_name") == route)
    return out.groupBy("hour_of_day").agg(
        F.sum("bunching_events").alias("bunching_events"), F.sum("severe_events").alias("severe_events")
    )
