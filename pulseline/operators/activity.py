"""Activity, cadence, speed and quality metrics of the raw ping table.

All of these drop NULL group keys, as the activity layer defines it; the SQL-style tables in
`scoring` keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulseline.config import OUTLIER_CV, PERSISTENT_DAYS, PING_COLUMNS, STATIONARY_MPS
from pulseline.functions import columns as C
from pulseline.functions import rollups as roll
from pulseline.functions.joins import with_scalars
from pulseline.functions.ordered import previous_in_series
from pulseline.functions.quantiles import exact_percentiles

def _n():
    return F.count(F.lit(1))


def _seen():
    return F.min("collection_timestamp").alias("first_seen"), F.max("collection_timestamp").alias("last_seen")


def _known(df: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def route_vehicle_counts(pings: DataFrame, count_rows: bool = False) -> DataFrame:
    """Records and vehicles per route; `count_rows` counts rows without a vehicle too."""
    records = roll.rows() if count_rows else roll.rows_with("vehicle_id")
    return roll.cells(_known(pings, "route_id"), ["route_id", "vehicle_id"]).groupBy("route_id").agg(
        records.alias("total_records"), F.count_distinct("vehicle_id").alias("unique_vehicles")
    ).withColumn("records_per_vehicle", C.rnd(C.ratio("total_records", "unique_vehicles")))


def report_intervals(pings: DataFrame) -> DataFrame:
    """Positive time between consecutive reports of a vehicle.

    Repeated reports of the same moment have a zero interval and are dropped by definition, so
    the series is made distinct (map-side first) before it is ordered.
    """
    series = _known(pings, "vehicle_id", "api_vehicle_timestamp").select(
        "vehicle_id", "api_vehicle_timestamp"
    ).distinct()
    ordered = previous_in_series(series, "vehicle_id", "api_vehicle_timestamp")
    return ordered.where(F.col("previous_api_vehicle_timestamp").isNotNull()).select(
        "vehicle_id", "api_vehicle_timestamp",
        ((F.unix_micros("api_vehicle_timestamp") - F.unix_micros("previous_api_vehicle_timestamp"))
         / F.lit(1e6)).alias("interval_seconds"),
    )


def gps_update_frequency(pings: DataFrame) -> DataFrame:
    gaps = report_intervals(pings)
    stats = gaps.groupBy("vehicle_id").agg(
        _n().alias("report_count"),
        C.rnd(F.avg("interval_seconds"), 1).alias("mean_interval_sec"),
        C.rnd(F.max("interval_seconds"), 1).alias("max_interval_sec"),
    )
    mid = exact_percentiles(gaps, ["vehicle_id"], "interval_seconds", {"m": 0.5})
    return stats.join(mid, "vehicle_id").withColumn("median_interval_sec", C.rnd("m", 1)).drop("m")


def derived_speed(pings: DataFrame) -> DataFrame:
    """Speed from consecutive positions of a vehicle, for feeds whose own speed is empty."""
    place = F.min(F.struct("latitude", "longitude"))
    series = (
        _known(pings, "vehicle_id", "api_vehicle_timestamp", "latitude", "longitude")
        .groupBy("vehicle_id", "api_vehicle_timestamp").agg(place.alias("p"))
        .select("vehicle_id", "api_vehicle_timestamp", "p.latitude", "p.longitude")
    )
    moved = previous_in_series(series, "vehicle_id", "api_vehicle_timestamp", ["latitude", "longitude"])
    secs = (F.unix_micros("api_vehicle_timestamp") - F.unix_micros("previous_api_vehicle_timestamp")) / F.lit(1e6)
    metres = C.haversine_m("previous_latitude", "previous_longitude", "latitude", "longitude")
    return moved.where(F.col("previous_api_vehicle_timestamp").isNotNull()).select(
        "vehicle_id", "api_vehicle_timestamp",
        C.rnd(metres, 1).alias("moved_m"), C.rnd(metres / secs, 3).alias("speed_mps"),
    )


def route_speed_stats(pings: DataFrame) -> DataFrame:
    """Mean, median, 95th percentile and maximum speed per route, in m/s and km/h."""
    known = _known(pings, "route_id", "speed")
    plain = known.groupBy("route_id").agg(
        _n().alias("sample_count"), F.avg("speed").alias("mean"), F.max("speed").alias("max")
    )
    parts = exact_percentiles(known, ["route_id"], "speed", {"median": 0.5, "p95": 0.95})
    cols = []
    for k in ("mean", "median", "p95", "max"):
        cols += [C.rnd(k, 3).alias(f"{k}_speed_mps"), C.rnd(F.col(k) * 3.6).alias(f"{k}_speed_kmh")]
    return plain.join(parts, "route_id").select("route_id", "sample_count", *cols)


def route_coverage(pings: DataFrame) -> DataFrame:
    return _known(pings, "route_id", "collection_timestamp").groupBy("route_id").agg(
        _n().alias("total_records"), *_seen(), F.count_distinct("hour").alias("active_hours")
    ).withColumn(
        "active_span_hours",
        C.rnd((C.epoch_seconds("last_seen") - C.epoch_seconds("first_seen")) / F.lit(3600.0)),
    )


def stationary_vehicles(pings: DataFrame, threshold: float = STATIONARY_MPS) -> DataFrame:
    known = _known(pings, "vehicle_id", "speed")
    return known.groupBy("vehicle_id").agg(
        _n().alias("total_reports"),
        F.count_if(F.col("speed") < threshold).alias("stationary_reports"),
        F.mode("route_id", True).alias("primary_route"),
    ).withColumn("pct_stationary", C.rnd(C.ratio("stationary_reports", "total_reports") * 100.0))


def zero_speed_share(pings: DataFrame) -> DataFrame:
    return _known(pings, "vehicle_id").groupBy("vehicle_id").agg(
        _n().alias("total_records"),
        F.count_if(F.col("speed") == 0.0).alias("zero_speed_records"),
        C.rnd(F.avg("speed"), 4).alias("mean_speed"),
    ).withColumn("zero_speed_share", C.rnd(C.ratio("zero_speed_records", "total_records"), 4))


def hourly_distribution(pings: DataFrame) -> DataFrame:
    return roll.cells(_known(pings, "hour"), ["hour", "vehicle_id", "route_id"]).groupBy("hour").agg(
        roll.rows_with("vehicle_id").alias("total_records"),
        F.count_distinct("vehicle_id").alias("unique_vehicles"),
        F.count_distinct("route_id").alias("unique_routes"),
    )


def hourly_network_activity(pings: DataFrame) -> DataFrame:
    """A typical hour: totals per (date, hour) first, then averaged over days."""
    keys = ["date", "hour"]
    per_day = roll.cells(_known(pings, *keys), [*keys, "vehicle_id", "route_id"]).groupBy(*keys).agg(
        roll.rows_with("vehicle_id").alias("r"), F.count_distinct("vehicle_id").alias("v"),
        F.count_distinct("route_id").alias("t"),
    )
    return per_day.groupBy("hour").agg(
        _n().alias("days_observed"), C.rnd(F.avg("r"), 1).alias("avg_records"),
        C.rnd(F.avg("v"), 1).alias("avg_unique_vehicles"), C.rnd(F.avg("t"), 1).alias("avg_unique_routes"),
        F.min("r").alias("min_records"), F.max("r").alias("max_records"),
    )


def route_hour_heatmap(pings: DataFrame) -> DataFrame:
    keys = ["route_id", "hour"]
    return roll.cells(_known(pings, *keys), [*keys, "vehicle_id"]).groupBy(*keys).agg(
        roll.rows_with("vehicle_id").alias("records"), F.count_distinct("vehicle_id").alias("unique_vehicles")
    )


def vehicle_activity(pings: DataFrame) -> DataFrame:
    """Per vehicle; the primary route is the one with most records, of equals the least."""
    own = roll.cells(_known(pings, "vehicle_id"), ["vehicle_id", "route_id", "date"])
    served = own.where(F.col("route_id").isNotNull()).groupBy("vehicle_id", "route_id").agg((-roll.rows()).alias("__less"))
    primary = served.groupBy("vehicle_id").agg(F.min(F.struct("__less", "route_id"))["route_id"].alias("primary_route"))
    return own.groupBy("vehicle_id").agg(
        roll.rows().alias("total_records"), F.count_distinct("date").alias("days_active"),
        F.count_distinct("route_id").alias("routes_served"), *roll.seen(),
    ).join(primary, "vehicle_id", "left").withColumn("records_per_active_day", C.rnd(C.ratio("total_records", "days_active")))


def daily_quality_fingerprint(pings: DataFrame, columns=PING_COLUMNS) -> DataFrame:
    """NULL share of every expected column and coordinate / speed / bearing population per day.

    A NULL speed or bearing differs from 0.0 and therefore counts as populated, as published.
    """
    def share(flag):
        return C.rnd(F.avg(flag.cast("int")) * 100.0)

    zero = F.coalesce(F.col("latitude") == 0.0, F.lit(False)) | F.coalesce(F.col("longitude") == 0.0, F.lit(False))
    return _known(pings, "date").groupBy("date").agg(
        _n().alias("row_count"),
        *[share(F.col(c).isNull()).alias(f"null_pct_{c}") for c in columns if c in pings.columns],
        share(zero).alias("invalid_coord_pct"),
        share(~F.col("speed").eqNullSafe(F.lit(0.0))).alias("speed_populated_pct"),
        share(~F.col("bearing").eqNullSafe(F.lit(0.0))).alias("bearing_populated_pct"),
    )


def route_daily_stability(pings: DataFrame, persistent: int = PERSISTENT_DAYS) -> DataFrame:
    daily = _known(pings, "route_id", "date").groupBy("route_id", "date").agg(_n().alias("n"))
    stats = daily.groupBy("route_id").agg(
        _n().alias("days_active"), F.avg("n").alias("mu"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd"),
        F.min("n").alias("min_daily_records"), F.max("n").alias("max_daily_records"),
        F.sum("n").alias("total_records"),
    )
    return stats.select(
        "route_id", "days_active",
        C.rnd("mu", 1).alias("mean_daily_records"), C.rnd("sd", 1).alias("std_daily_records"),
        "min_daily_records", "max_daily_records", "total_records",
        C.rnd(C.ratio("sd", "mu"), 4).alias("cv_daily_records"),
        (F.col("days_active") >= persistent).alias("is_persistent"),
    )


def outlier_routes(stability: DataFrame, cv: float = OUTLIER_CV) -> DataFrame:
    reason = f"CV > {cv}: daily record count varies more than expected for a persistent route"
    return stability.where(F.col("is_persistent") & (F.col("cv_daily_records") > cv)).withColumn(
        "flag_reason", F.lit(reason)
    )


def daily_summary(pings: DataFrame) -> DataFrame:
    return roll.cells(_known(pings, "date"), roll.ACTIVITY_GRAIN).groupBy("date").agg(
        roll.rows_with("vehicle_id").alias("total_records"),
        F.count_distinct("vehicle_id").alias("unique_vehicles"),
        F.count_distinct("route_id").alias("unique_routes"),
        F.count_distinct("trip_id").alias("unique_trips"),
        F.count_distinct("hour").alias("active_hours"), *roll.seen(),
    ).withColumns({
        "records_per_vehicle": C.rnd(C.ratio("total_records", "unique_vehicles")),
        "day_of_week": F.date_format(F.to_date("date"), "EEEE"),
    })


def route_activity(pings: DataFrame) -> DataFrame:
    return roll.cells(_known(pings, "route_id"), roll.ACTIVITY_GRAIN).groupBy("route_id").agg(
        roll.rows_with("vehicle_id").alias("total_records"),
        F.count_distinct("vehicle_id").alias("unique_vehicles"),
        F.count_distinct("trip_id").alias("unique_trips"),
        F.count_distinct("date").alias("days_active"),
        F.count_distinct("hour").alias("active_hours"), *roll.seen(),
    ).withColumn("records_per_vehicle", C.rnd(C.ratio("total_records", "unique_vehicles")))


def vehicle_report_distribution(vehicles: DataFrame) -> DataFrame:
    """Cumulative share of the fleet by records per vehicle.

    Vehicles are counted per distinct record count first; the ordered pass sees only those counts.
    """
    counts = vehicles.groupBy("total_records").agg(_n().alias("vehicles"))
    upto = Window.orderBy("total_records").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("vehicles").over(Window.partitionBy())
    return counts.select(
        "total_records", "vehicles",
        C.rnd(C.ratio(F.sum("vehicles").over(upto), total, 100), 4).alias("cumulative_pct_of_fleet"),
    )


def vehicle_report_summary(vehicles: DataFrame) -> DataFrame:
    n = F.col("total_records")
    return vehicles.agg(
        _n().alias("fleet_size"), C.rnd(F.median(n)).alias("median_records"),
        C.rnd(F.avg(n), 1).alias("mean_records"),
        F.count_if(n < 10).alias("under_10_records"), F.count_if(n >= 300).alias("at_least_300_records"),
    )


def coverage_histogram(coverage: DataFrame) -> DataFrame:
    """Routes per number of active hours, with the share of the network."""
    rows = coverage.groupBy("active_hours").agg(_n().alias("routes"))
    whole = Window.partitionBy()
    top = F.max("active_hours").over(whole)
    return rows.select(
        "active_hours", "routes",
        C.rnd(C.ratio("routes", F.sum("routes").over(whole)), 4).alias("share_of_routes"),
        (F.col("active_hours") == top).alias("is_full_coverage"),
        (F.col("active_hours") <= 2).alias("is_brief"),
    )


def brief_routes(coverage: DataFrame, hours: int = 2) -> DataFrame:
    return coverage.where(F.col("active_hours") <= hours)


def small_fleet_outliers(counts: DataFrame, vehicles: int = 2, records: int = 100) -> DataFrame:
    """Every route with few vehicles and many records."""
    return counts.where((F.col("unique_vehicles") <= vehicles) & (F.col("total_records") >= records))


def high_intensity_routes(counts: DataFrame) -> DataFrame:
    """Routes above the 95th percentile of records per vehicle, with the two network marks."""
    marks = counts.agg(
        F.median("records_per_vehicle").alias("network_median"),
        F.percentile("records_per_vehicle", 0.95).alias("network_p95"),
    )
    return with_scalars(counts, marks).where(F.col("records_per_vehicle") > F.col("network_p95")).select(
        "route_id", "total_records", "unique_vehicles", "records_per_vehicle",
        C.rnd("network_median").alias("network_median"), C.rnd("network_p95").alias("network_p95"),
    )


def top_lists(counts: DataFrame, n: int = 15, min_fleet: int = 5) -> DataFrame:
    """Three top-n lists: by records, by vehicles, and by density among fleets of min_fleet."""
    fields = ["route_id", "total_records", "unique_vehicles", "records_per_vehicle"]

    def head(df, name, by):
        return df.orderBy(F.desc(by), "route_id").limit(n).select(F.lit(name).alias("listing"), *fields)

    return (
        head(counts, "records", "total_records")
        .unionByName(head(counts, "vehicles", "unique_vehicles"))
        .unionByName(head(counts.where(F.col("unique_vehicles") >= min_fleet), "density", "records_per_vehicle"))
    )


def window_span(coverage: DataFrame, speeds: DataFrame) -> DataFrame:
    """First and last ping of the window, its length in hours, routes with any non-zero speed."""
    span = coverage.agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    moving = F.col("mean_speed_mps") + F.col("median_speed_mps") + F.col("max_speed_mps") > 0
    speed = speeds.agg(
        F.count_if(moving).alias("routes_with_speed"), _n().alias("routes_with_samples"),
        F.max("max_speed_mps").alias("max_speed_mps"),
    )
    hours = (C.epoch_seconds("last_seen") - C.epoch_seconds("first_seen")) / F.lit(3600.0)
    return with_scalars(span.withColumn("span_hours", C.rnd(hours)), speed)
