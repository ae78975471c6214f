"""Observed spacing between consecutive vehicles of one snapshot, and bunching events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from pulseline.config import SPACING, SpacingRules
from pulseline.functions import columns as C
from pulseline.functions.joins import with_scalars
from pulseline.functions.ordered import ranked_neighbours

# network form: vehicles of one route; corridor form: every vehicle on the shape
SNAPSHOT_KEYS = ("route_id", "collection_timestamp", "direction_id", "shape_id")
CORRIDOR_KEYS = ("collection_timestamp", "direction_id", "shape_id")
DIST = "approx_shape_dist_traveled"


def projection_filter(projected: DataFrame, max_error_m: float = SPACING.max_projection_error_m) -> DataFrame:
    return projected.where((F.col("projection_error_m") <= max_error_m) & F.col(DIST).isNotNull())


def terminal_buffer(projected: DataFrame, km: float = SPACING.terminal_buffer_km) -> DataFrame:
    """Keep vehicles between the two terminal zones; an unknown length passes the upper test."""
    length = F.col("shape_length_km")
    return projected.where(
        (F.col(DIST) > km) & (length.isNull() | (F.col(DIST) < length - F.lit(km)))
    )


def with_shape_length(projected: DataFrame, shape_summary: DataFrame) -> DataFrame:
    return projected.join(shape_summary.select("shape_id", "shape_length_km"), "shape_id", "left")


def bus_rank(projected: DataFrame, keys: Sequence[str] = SNAPSHOT_KEYS) -> DataFrame:
    """Position of every vehicle within its snapshot, ordered by distance then event id."""
    ranked = ranked_neighbours(projected, keys, DIST, "event_id")
    return ranked.withColumnRenamed("rank", "bus_rank").drop(f"next_{DIST}")


CARRIED = ("trip_id", "api_vehicle_timestamp", "latitude", "longitude", "route_id", "projection_error_m",
           "shape_length_km", "service_date")


def observed_headways(
    in_service: DataFrame, keys: Sequence[str] = SNAPSHOT_KEYS, carry: Sequence[str] = CARRIED
) -> DataFrame:
    """Gap from each vehicle to the next different vehicle ahead in the same snapshot.

    A row can only have a positive gap if it is the last of its distance in the snapshot, and its
    neighbour is the first of the next distance. So rows are reduced to one per (snapshot,
    distance) before the ordered window: the reduction runs map-side, and a window partition
    holds at most the distinct distances of one shape, however many pings a snapshot has.
    A same-vehicle or zero-gap neighbour still hides the vehicle beyond it.

    `carry` names the further columns of the row to keep. They travel inside the aggregate, where
    Catalyst cannot prune them, so scoring jobs pass only what they read.
    """
    row = F.struct("event_id", "vehicle_id", *[c for c in carry if c in in_service.columns and c not in keys])
    head = F.struct("event_id", "vehicle_id")
    stands = in_service.groupBy(*keys, DIST).agg(
        F.count(F.lit(1)).alias("n"), F.max(row).alias("me"), F.min(head).alias("head")
    )
    along = Window.partitionBy(*keys).orderBy(DIST)
    paired = stands.select(
        *keys, DIST, "me",
        F.sum("n").over(along).alias("bus_rank"),
        F.lead("head").over(along)["vehicle_id"].alias("next_vehicle_id"),
        F.lead(DIST).over(along).alias("next_shape_dist"),
    )
    return (
        paired.where(F.col("next_vehicle_id").isNotNull() & (F.col("next_vehicle_id") != F.col("me.vehicle_id")))
        .select(
            *keys, "me.*", "bus_rank", DIST, "next_vehicle_id", "next_shape_dist",
            C.rnd(F.col("next_shape_dist") - F.col(DIST), 4).alias("distance_to_next_bus_km"),
        )
    )


def observed_headways_basic(projected: DataFrame, keys: Sequence[str] = SNAPSHOT_KEYS) -> DataFrame:
    """First-generation rule: every neighbour counts, also at zero gap or of the same vehicle."""
    ranked = ranked_neighbours(projected, keys, DIST, "event_id", ["vehicle_id", "latitude", "longitude"])
    return (
        ranked.where(F.col("next_vehicle_id").isNotNull())
        .withColumnsRenamed({"rank": "bus_rank", f"next_{DIST}": "next_shape_dist"})
        .withColumn("distance_to_next_bus_km", C.rnd(F.col("next_shape_dist") - F.col(DIST), 4))
    )


def bunching_events(headways: DataFrame, tz: str = "UTC", rules: SpacingRules = SPACING) -> DataFrame:
    """Close pairs with severity, part of day and half-kilometre segment."""
    hour = F.hour(C.in_zone("collection_timestamp", tz))
    return headways.where(F.col("distance_to_next_bus_km") <= rules.moderate_km).withColumns(
        {
            "bunching_severity": C.severity("distance_to_next_bus_km"),
            "peak_period": C.peak_period(hour),
            "hour_of_day": hour,
            "route_segment_km": C.segment_start(DIST, rules.segment_km),
        }
    )


def headway_summary(headways: DataFrame) -> DataFrame:
    """Network spacing statistics. Gaps lie on a 0.1 m grid, so the median's buffer is bounded."""
    gap = "distance_to_next_bus_km"
    return headways.agg(
        F.count(F.lit(1)).alias("spacing_rows"),
        F.count_distinct("collection_timestamp").alias("timestamps"),
        F.count_distinct("vehicle_id").alias("vehicles"),
        C.rnd(C.grid_avg(gap, 4), 3).alias("avg_km"), C.rnd(F.median(gap), 3).alias("median_km"),
        C.rnd(F.min(gap), 3).alias("min_km"), C.rnd(F.max(gap), 3).alias("max_km"),
    )


def close_spacing_counts(headways: DataFrame) -> DataFrame:
    gap = F.col("distance_to_next_bus_km")
    return headways.agg(
        F.count_if(gap <= 0.50).alias("events_under_500m"),
        F.count_if(gap <= 0.25).alias("events_under_250m"),
        F.count_if(gap <= 0.10).alias("events_under_100m"),
    )


def headway_by_shape(headways: DataFrame) -> DataFrame:
    gap = F.col("distance_to_next_bus_km")
    return headways.groupBy("direction_id", "shape_id").agg(
        F.max("shape_length_km").alias("shape_length_km"),
        F.count(F.lit(1)).alias("spacing_rows"),
        F.count_distinct("vehicle_id").alias("vehicles"),
        C.rnd(F.median(gap), 3).alias("median_gap_km"),
        F.count_if(gap <= 0.25).alias("events_under_250m"),
    )


def cleaning_funnel(
    projected: DataFrame, headways: DataFrame, max_error_m: float = SPACING.max_projection_error_m,
    km: float = SPACING.terminal_buffer_km,
) -> DataFrame:
    """Rows before and after each cleaning step. The first three counts share one scan."""
    near = (F.col("projection_error_m") <= max_error_m) & F.col(DIST).isNotNull()
    length = F.col("shape_length_km")
    inside = near & (F.col(DIST) > km) & (length.isNull() | (F.col(DIST) < length - F.lit(km)))
    steps = projected.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(near).alias("rows_after_projection"),
        F.count_if(inside).alias("rows_in_service"),
    )
    out = with_scalars(steps, headways.agg(F.count(F.lit(1)).alias("clean_rows")))
    return out.withColumns({
        "removed_by_projection": F.col("raw_rows") - F.col("rows_after_projection"),
        "removed_by_terminal": F.col("rows_after_projection") - F.col("rows_in_service"),
    })


def closest_pairs(headways: DataFrame, n: int = 25) -> DataFrame:
    return headways.orderBy("distance_to_next_bus_km", "event_id").limit(n)
