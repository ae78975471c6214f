"""Cleaning and enrichment of raw pings: narrow projections and filters, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseline.config import BOX, PING_COLUMNS, Box
from pulseline.functions import columns as C
from pulseline.functions.joins import lookup_join


def silver_positions(pings: DataFrame, box: Box = BOX, tz: str = "UTC") -> DataFrame:
    """Pings with a vehicle, a route and a position inside the service area, plus date and hour."""
    ts = C.in_zone("collection_timestamp", tz)
    return pings.where(
        F.col("vehicle_id").isNotNull()
        & F.col("route_id").isNotNull()
        & F.col("latitude").between(box.lat_min, box.lat_max)
        & F.col("longitude").between(box.lon_min, box.lon_max)
    ).withColumns({"service_date": F.to_date(ts), "hour_of_day": F.hour(ts)})


def valid_coords(pings: DataFrame) -> DataFrame:
    """Drop missing positions and the 0/0 value that receivers send without a fix."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return pings.where(lat.isNotNull() & lon.isNotNull() & ~((lat == 0.0) & (lon == 0.0)))


def time_columns(pings: DataFrame, ts: str = "collection_timestamp") -> DataFrame:
    """UTC calendar columns: date text, hour, day of week with Monday = 0.

    A text timestamp that does not parse gives NULL parts, never an error.
    """
    value = F.try_to_timestamp(F.col(ts)) if dict(pings.dtypes)[ts] == "string" else F.col(ts)
    return pings.withColumns(
        {
            "date": F.date_format(value, "yyyy-MM-dd"),
            "hour": F.hour(value),
            "day_of_week": F.weekday(value),
        }
    )


def with_local_hour(df: DataFrame, hour: str = "hour", name: str = "local_hour") -> DataFrame:
    return df.withColumn(name, C.local_hour(hour))


def route_allow_list(pings: DataFrame, routes: list[str] | None) -> DataFrame:
    """Keep only the listed routes; None keeps all."""
    return pings if routes is None else pings.where(F.col("route_id").isin(*routes))


def with_event_id(pings: DataFrame) -> DataFrame:
    """A repeatable bigint id per ping, for feeds that bring none; it only breaks ties."""
    return pings.withColumn(
        "event_id", F.xxhash64("collection_timestamp", "entity_id", "vehicle_id", "api_vehicle_timestamp")
    )


def silver_enriched(silver: DataFrame, trips: DataFrame, spread_by: str = "event_id") -> DataFrame:
    """Silver pings with direction, shape and service of their trip (NULL where unmatched)."""
    fields = trips.select("trip_id", "direction_id", "shape_id", "service_id")
    base = silver.drop("direction_id", "shape_id", "service_id")
    return lookup_join(base, fields, "trip_id", spread_by)


def join_coverage(enriched: DataFrame) -> DataFrame:
    """How many silver rows found a shape, a direction and a trip, as counts and percent."""
    n = F.count(F.lit(1))

    def found(c: str):
        return F.count(F.col(c))

    return enriched.agg(
        n.alias("silver_rows"),
        found("shape_id").alias("matched_shape_rows"),
        found("direction_id").alias("matched_direction_rows"),
        found("service_id").alias("matched_trip_rows"),
        C.rnd(C.ratio(found("shape_id"), n, 100)).alias("shape_match_percentage"),
        C.rnd(C.ratio(found("direction_id"), n, 100)).alias("direction_match_percentage"),
        C.rnd(C.ratio(found("service_id"), n, 100)).alias("trip_match_percentage"),
    )


def unmatched_labels(route_metrics: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes in the metrics, in the catalog, and those without a catalog label."""
    labels = routes.select("route_id", C.route_label("route_short_name", "route_long_name").alias("route_label"))
    joined = route_metrics.select("route_id").join(labels, "route_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("routes_in_metrics"),
        F.count("route_label").alias("routes_labelled"),
        F.count_if(F.col("route_label").isNull()).alias("unmatched_routes"),
    )


def require_columns(df: DataFrame, expected: tuple[str, ...] = PING_COLUMNS) -> list[str]:
    """Names missing from a frame's schema (metadata only)."""
    return [c for c in expected if c not in df.columns]


def positions_enriched(pings: DataFrame, route_dim: DataFrame) -> DataFrame:
    """Valid positions with mode, subtype and names of their route, and the local hour."""
    dim = route_dim.select(
        "route_id", "route_short_name", "route_long_name", "route_type", "mode", "bus_subtype"
    )
    out = lookup_join(valid_coords(pings), dim, "route_id", "entity_id")
    return out.withColumn("local_hour", C.local_hour(F.hour("collection_timestamp")))


def _slice_tests() -> dict:
    mode, sub, line = F.col("mode"), F.col("bus_subtype"), F.col("route_long_name")
    return {
        "multimodal": mode.isNotNull(),
        "bus": mode == "Bus",
        "skytrain": mode == "SkyTrain",
        "expo_line": line == "Expo Line",
        "canada_line": line == "Canada Line",
        "seabus": mode == "SeaBus",
        "west_coast_express": mode == "West Coast Express",
        "rapidbus": sub == "RapidBus",
        "nightbus": sub == "NightBus",
    }


def mode_slice(enriched: DataFrame, name: str) -> DataFrame:
    """One of the named network slices that the maps are drawn from."""
    return enriched.where(_slice_tests()[name])


def slice_counts(enriched: DataFrame) -> DataFrame:
    """Positions and routes of every non-empty slice in one pass, in long form."""
    by_route = enriched.groupBy("route_id", "mode", "bus_subtype", "route_long_name").agg(
        F.count(F.lit(1)).alias("n")
    )
    picked = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in _slice_tests().items()]))
    return (
        by_route.withColumn("slice", F.explode(picked))
        .groupBy("slice")
        .agg(F.sum("n").alias("positions"), F.count("route_id").alias("routes"))
    )


def pm_peak_positions(enriched: DataFrame) -> DataFrame:
    return enriched.where(F.col("local_hour").isin(15, 16, 17))
