"""Typed schedule dimensions and the route-shape reference built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseline.functions import columns as C
from pulseline.functions.joins import with_scalars

# Typed columns and required (not null) columns of each schedule table.
SCHEDULE_SCHEMAS = {
    "routes": (
        {"route_id": "string", "route_short_name": "string", "route_long_name": "string",
         "route_type": "int"},
        (),
    ),
    "trips": (
        {"trip_id": "string", "route_id": "string", "service_id": "string", "shape_id": "string",
         "direction_id": "int"},
        ("trip_id", "route_id"),
    ),
    "stops": (
        {"stop_id": "string", "stop_name": "string", "stop_lat": "double", "stop_lon": "double"},
        ("stop_id", "stop_lat", "stop_lon"),
    ),
    "shapes": (
        {"shape_id": "string", "shape_pt_lat": "double", "shape_pt_lon": "double",
         "shape_pt_sequence": "int", "shape_dist_traveled": "double"},
        ("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"),
    ),
    "stop_times": (
        {"trip_id": "string", "arrival_time": "string", "departure_time": "string",
         "stop_id": "string", "stop_sequence": "int", "shape_dist_traveled": "double"},
        ("trip_id", "stop_id", "stop_sequence"),
    ),
}


def clean_dimension(raw: DataFrame, name: str) -> DataFrame:
    """Cast an all-text schedule table to its types and drop rows without their keys.

    Columns absent from the file come out as NULL, so an optional column never fails a load.
    """
    types, required = SCHEDULE_SCHEMAS[name]
    typed = raw.select(
        *[(F.col(c) if c in raw.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    )
    return typed.dropna(subset=list(required)) if required else typed


def bus_routes(routes: DataFrame) -> DataFrame:
    """Bus routes only, short names trimmed, with the schedule-side subtype."""
    return routes.where(F.col("route_type") == 3).select(
        "route_id", F.trim("route_short_name").alias("route_short_name"), "route_long_name", "route_type",
        C.bus_subtype_static("route_id", "route_short_name", "route_long_name").alias("bus_subtype"),
    )


def semi_filter(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in the other table; the id list never leaves the executors."""
    return df.join(allowed.select(key), key, "left_semi")


def shape_distance_summary(shapes: DataFrame) -> DataFrame:
    return (
        shapes.where(F.col("shape_dist_traveled").isNotNull())
        .groupBy("shape_id")
        .agg(
            F.count(F.lit(1)).alias("shape_points"),
            F.min("shape_pt_sequence").alias("first_sequence"),
            F.max("shape_pt_sequence").alias("last_sequence"),
            F.min("shape_dist_traveled").alias("min_shape_distance"),
            F.max("shape_dist_traveled").alias("max_shape_distance"),
        )
        .withColumn("shape_length_km", C.rnd("max_shape_distance"))
    )


def route_trip_shapes(trips: DataFrame) -> DataFrame:
    return trips.groupBy("route_id", "direction_id", "shape_id").agg(F.count(F.lit(1)).alias("trip_count"))


def route_shape_summary(trips: DataFrame, routes: DataFrame, shape_summary: DataFrame) -> DataFrame:
    """Scheduled trips per (route, direction, shape) with names and shape length.

    Trips are aggregated before the two joins, so only one row per combination is joined.
    """
    counted = (
        trips.where(F.col("shape_id").isNotNull())
        .groupBy("route_id", "direction_id", "shape_id")
        .agg(F.count_distinct("trip_id").alias("scheduled_trip_count"))
    )
    names = routes.select("route_id", "route_short_name", "route_long_name")
    lengths = shape_summary.select("shape_id", "shape_points", "shape_length_km")
    return counted.join(names, "route_id", "left").join(lengths, "shape_id", "left")


def eligible_route_shapes(route_shapes: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Measurable shapes of routes with at least one eligible day."""
    days = (
        eligibility.where(F.col("eligibility_status") == "Eligible")
        .groupBy("route_id").agg(F.count(F.lit(1)).alias("eligible_days"))
    )
    usable = route_shapes.where(F.col("shape_length_km").isNotNull() & (F.col("shape_points") >= 2))
    return usable.join(days, "route_id", "inner")


def shape_reference_stats(shape_summary: DataFrame, eligible_shapes: DataFrame) -> DataFrame:
    """Headline numbers of the shape reference as one row of metric columns."""
    left = shape_summary.agg(
        F.count_distinct("shape_id").alias("total_shapes"),
        C.rnd(C.grid_avg("shape_length_km", 2)).alias("avg_shape_length_km"),
        C.rnd(F.max("shape_length_km")).alias("max_shape_length_km"),
    )
    right = eligible_shapes.agg(
        F.count(F.lit(1)).alias("eligible_route_shape_rows"),
        F.count_distinct("route_id").alias("eligible_routes"),
        F.count_distinct("shape_id").alias("eligible_shapes"),
    )
    return with_scalars(left, right)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of row counts; each count is a metadata-light scan of its own."""
    frames = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
