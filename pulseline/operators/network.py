"""Network intelligence on route, day and vehicle aggregates.

Inputs here are one row per route, day, subtype-hour or vehicle. Ordered windows without a
partition key appear only over route, day and subtype rows, whose number the schedule bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulseline.config import LOCAL_OFFSET_HOURS
from pulseline.functions import columns as C
from pulseline.functions.joins import with_scalars


def _n():
    return F.count(F.lit(1))


def _whole():
    return Window.partitionBy()


def route_dimension(routes: DataFrame, telemetry_routes: DataFrame) -> DataFrame:
    """Routes with mode, subtype and whether any ping named them.

    Rail and ferry routes carry their mode as subtype. The telemetry side is reduced to distinct
    ids, so at most one row per route crosses the shuffle.
    """
    seen = telemetry_routes.where(F.col("route_id").isNotNull()).select("route_id").distinct()
    mode = C.mode_of("route_type")
    return routes.withColumns({
        "mode": mode,
        "bus_subtype": F.when(mode == "Bus", C.bus_subtype("route_short_name", "route_long_name")).otherwise(mode),
    }).join(seen.withColumn("seen", F.lit(True)), "route_id", "left").withColumn(
        "is_in_telemetry", F.col("seen").isNotNull()
    ).drop("seen")


def enrich_activity(activity: DataFrame, dim: DataFrame) -> DataFrame:
    names = dim.select("route_id", "route_short_name", "route_long_name", "route_type", "mode", "bus_subtype")
    return activity.join(names, "route_id", "left")


def telemetry_blind_spots(routes: DataFrame, pings: DataFrame) -> DataFrame:
    """Routes never seen in telemetry, with their mode."""
    seen = pings.where(F.col("route_id").isNotNull()).select("route_id").distinct()
    return routes.join(seen, "route_id", "left_anti").select(
        "route_id", "route_short_name", "route_long_name", C.mode_of("route_type").alias("mode")
    )


def _share(value: str):
    return C.rnd(C.ratio(value, F.sum(value).over(_whole())) * 100.0)


def modal_activity_share(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("mode").agg(
        F.count_distinct("route_id").alias("routes_in_telemetry"),
        F.sum("total_records").alias("total_records"),
        F.sum("unique_vehicles").alias("unique_vehicles"),
    ).withColumn("pct_of_records", _share("total_records"))


def modal_coverage(dim: DataFrame) -> DataFrame:
    return dim.groupBy("mode").agg(
        F.count("route_id").alias("routes_in_static"),
        F.count_if("is_in_telemetry").alias("routes_in_telemetry"),
    ).withColumn("coverage_pct", C.rnd(C.ratio("routes_in_telemetry", "routes_in_static") * 100.0, 1))


def bus_subtype_share(enriched: DataFrame) -> DataFrame:
    return enriched.where(F.col("mode") == "Bus").groupBy("bus_subtype").agg(
        F.count_distinct("route_id").alias("routes"),
        F.sum("total_records").alias("total_records"),
        F.sum("unique_vehicles").alias("unique_vehicles"),
    ).withColumn("pct_of_bus_records", _share("total_records"))


def top_corridors(enriched: DataFrame, n: int = 20) -> DataFrame:
    return enriched.orderBy(F.desc("total_records"), "route_id").limit(n).select(
        "route_id", "route_short_name", "route_long_name", "mode", "bus_subtype",
        "total_records", "unique_vehicles", "days_active",
    )


def pareto_concentration(enriched: DataFrame) -> DataFrame:
    """Routes by load with rank, cumulative records and both as percent."""
    order = Window.orderBy(F.desc("total_records"), "route_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = enriched.withColumns({
        "route_rank": F.row_number().over(order).cast("bigint"),
        "cumulative_records": F.sum("total_records").over(upto),
        "whole": F.sum("total_records").over(_whole()),
        "n": _n().over(_whole()),
    })
    return ranked.select(
        "route_rank", C.rnd(C.ratio("route_rank", "n") * 100.0, 4).alias("route_rank_pct"),
        "route_id", "route_short_name", "route_long_name", "mode", "bus_subtype",
        "total_records", "cumulative_records",
        C.rnd(C.ratio("cumulative_records", "whole") * 100.0, 4).alias("cumulative_pct"),
    )


def pareto_threshold(pareto: DataFrame, share: float = 80.0) -> DataFrame:
    """The first rank percent whose cumulative share reaches the given share."""
    return pareto.agg(
        F.min(F.when(F.col("cumulative_pct") >= share, F.col("route_rank_pct"))).alias("route_rank_pct")
    )


def network_centralization(activity: DataFrame, stability: DataFrame) -> DataFrame:
    """Metric rows: top-share under both published definitions, Gini, routes, persistent routes.

    `index` share reads the cumulative curve at position int(p*n), one route more than p; `ranked`
    share is the largest cumulative share among routes with rank percent <= p.
    """
    up = Window.orderBy("total_records", "route_id")
    down = Window.orderBy(F.desc("total_records"), "route_id")
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = activity.select(
        "total_records",
        F.row_number().over(up).alias("i"), F.row_number().over(down).alias("rank"),
        F.sum("total_records").over(upto).alias("cum"),
        F.sum("total_records").over(_whole()).alias("total"), _n().over(_whole()).alias("n"),
    )
    cum_pct = C.ratio("cum", "total") * 100.0

    def at_index(p: float):
        spot = F.least(F.floor(F.lit(p) * F.col("n")) + 1, F.col("n"))
        return C.rnd(F.max(F.when(F.col("rank") == spot, cum_pct)))

    def at_rank(p: float):
        return C.rnd(F.max(F.when(C.ratio("rank", "n") * 100.0 <= p * 100.0, cum_pct)))

    n, x, ix = F.max("n").cast("double"), F.sum("total_records").cast("double"), F.sum(
        F.col("i").cast("double") * F.col("total_records"))
    gini = F.coalesce((F.lit(2.0) * ix - (n + 1.0) * x) / F.nullif(n * x, F.lit(0.0)), F.lit(0.0))
    wide = r.agg(
        at_index(0.10).alias("top10_index"), at_index(0.20).alias("top20_index"),
        at_rank(0.10).alias("top10_ranked"), at_rank(0.20).alias("top20_ranked"),
        C.rnd(gini, 4).alias("gini"), _n().cast("double").alias("routes"),
    )
    keep = stability.agg(F.count_if("is_persistent").cast("double").alias("persistent"))
    return with_scalars(wide, keep).select(F.expr(
        "stack(7, 'Top 10% share (index)', top10_index, 'Top 20% share (index)', top20_index, "
        "'Top 10% share (ranked)', top10_ranked, 'Top 20% share (ranked)', top20_ranked, "
        "'Gini coefficient', gini, 'Routes with telemetry', routes, 'Persistent routes', persistent) "
        "AS (metric, value)"
    ))


# --- time of day -------------------------------------------------------------------------------

def subtype_hourly_profile(heatmap: DataFrame, dim: DataFrame, offset: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    """Records per subtype and local hour, from the (route, hour) table."""
    kinds = dim.select("route_id", "mode", "bus_subtype")
    return (
        heatmap.join(kinds, "route_id", "left").where(F.col("bus_subtype").isNotNull())
        .groupBy("bus_subtype", C.local_hour("hour", offset).alias("local_hour"))
        .agg(F.sum("records").alias("records"))
    )


def dense_profile(profile: DataFrame, key: str = "bus_subtype") -> DataFrame:
    """Every key with all 24 hours, zero where nothing was seen."""
    grid = profile.select(key).distinct().withColumn(
        "local_hour", F.explode(F.sequence(F.lit(0), F.lit(23)))
    )
    return grid.join(profile, [key, "local_hour"], "left").fillna(0, ["records"])


def subtype_profile_normalized(profile: DataFrame) -> DataFrame:
    """Wide profile: one column per hour, each the percent of the subtype's records."""
    share = C.ratio("records", F.sum("records").over(Window.partitionBy("bus_subtype"))) * 100.0
    wide = (
        profile.withColumn("share", C.rnd(share, 4)).groupBy("bus_subtype")
        .pivot("local_hour", list(range(24))).agg(F.max("share")).fillna(0.0)
    )
    return wide.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})


def subtype_correlation(profile: DataFrame) -> DataFrame:
    """Pearson correlation between subtypes over the 24 hours, in long form.

    The grid has 24 rows per subtype; the self-join is keyed by hour over that fixed grid.
    """
    d = dense_profile(profile)
    a = d.select("local_hour", F.col("bus_subtype").alias("subtype_a"), F.col("records").alias("x"))
    b = d.select("local_hour", F.col("bus_subtype").alias("subtype_b"), F.col("records").alias("y"))
    return a.join(b, "local_hour").groupBy("subtype_a", "subtype_b").agg(
        C.rnd(F.corr("x", "y"), 3).alias("correlation")
    )


def peak_windows(profile: DataFrame) -> DataFrame:
    """The busiest three consecutive hours of each subtype; wraps midnight, earliest start wins."""
    d = dense_profile(profile)
    # each hour feeds the three windows that contain it
    fed = d.select(
        "bus_subtype", "records",
        F.explode(F.array(*[F.pmod(F.col("local_hour") - k, F.lit(24)) for k in range(3)])).alias("start"),
    )
    sums = fed.groupBy("bus_subtype", "start").agg(F.sum("records").alias("s"))
    best = sums.groupBy("bus_subtype").agg(
        F.min(F.struct((-F.col("s")).alias("neg"), "start")).alias("b"), F.sum("s").alias("triple")
    )
    two = "%02d:00–%02d:00"
    return best.select(
        "bus_subtype",
        F.format_string(two, F.col("b.start"), F.pmod(F.col("b.start") + 3, F.lit(24))).alias("peak_window_local"),
        (-F.col("b.neg")).alias("peak_window_records"),
        C.rnd(C.ratio(-F.col("b.neg"), F.col("triple") / 3) * 100.0).alias("share_of_subtype_records_in_peak"),
    )


def weekday_weekend(daily: DataFrame) -> DataFrame:
    off = F.col("day_of_week").isin("Saturday", "Sunday")
    out = daily.agg(
        F.avg(F.when(~off, F.col("total_records"))).alias("w"),
        F.avg(F.when(off, F.col("total_records"))).alias("e"),
    )
    return out.select(
        C.rnd("w").alias("weekday_avg_records"), C.rnd("e").alias("weekend_avg_records"),
        C.rnd(C.ratio("e", "w") * 100.0, 1).alias("weekend_pct_of_weekday"),
    )


def night_share(profile: DataFrame, subtype: str = "NightBus") -> DataFrame:
    late = (F.col("local_hour") >= 22) | (F.col("local_hour") <= 4)
    return profile.where(F.col("bus_subtype") == subtype).groupBy("bus_subtype").agg(
        C.rnd(C.ratio(F.sum(F.when(late, F.col("records")).otherwise(0)), F.sum("records")) * 100.0, 1)
        .alias("night_share_pct")
    )


def peak_quiet_hour(hourly: DataFrame, offset: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    """Busiest and quietest local hour of a typical day and the swing between them."""
    h = hourly.withColumn("local_hour", C.local_hour("hour", offset))
    top = F.min(F.struct((-F.col("avg_records")).alias("neg"), "hour", "local_hour"))
    low = F.min(F.struct("avg_records", "hour", "local_hour"))
    return h.agg(top.alias("t"), low.alias("l")).select(
        F.col("t.local_hour").alias("peak_hour"), (-F.col("t.neg")).alias("peak_avg_records"),
        F.col("l.local_hour").alias("quiet_hour"), F.col("l.avg_records").alias("quiet_avg_records"),
        C.rnd(C.ratio(-F.col("t.neg"), F.col("l.avg_records")), 1).alias("swing"),
    )


# --- feeders and fleet ---------------------------------------------------------------------------

def feeder_routes(dim: DataFrame, activity: DataFrame) -> DataFrame:
    """Bus routes that reach a rail station, with their activity and share of all records."""
    total = activity.agg(F.sum("total_records").alias("whole"))
    pool = dim.where((F.col("mode") == "Bus") & C.feeder_flag("route_long_name"))
    joined = pool.join(activity.select("route_id", "total_records", "unique_vehicles", "days_active"), "route_id")
    return with_scalars(joined, total).select(
        "route_id", "route_short_name", "route_long_name", "bus_subtype",
        "total_records", "unique_vehicles", "days_active",
        C.rnd(C.ratio("total_records", "whole") * 100.0).alias("pct_of_all_records"),
    )


def feeder_hourly(heatmap: DataFrame, dim: DataFrame, offset: int = LOCAL_OFFSET_HOURS) -> DataFrame:
    kinds = dim.where(F.col("mode") == "Bus").select(
        "route_id", C.feeder_flag("route_long_name").alias("serves_rail")
    )
    return heatmap.join(kinds, "route_id").groupBy(
        "serves_rail", C.local_hour("hour", offset).alias("local_hour")
    ).agg(F.sum("records").alias("records"))


def feeder_peak_hours(feeder_profile: DataFrame) -> DataFrame:
    """Busiest local hour of feeders and of the other bus routes."""
    best = F.min(F.struct((-F.col("records")).alias("neg"), "local_hour"))
    return feeder_profile.groupBy("serves_rail").agg(best.alias("b")).select(
        "serves_rail", F.col("b.local_hour").alias("peak_hour"), (-F.col("b.neg")).alias("peak_records")
    )


def fleet_flexibility(vehicles: DataFrame) -> DataFrame:
    """Fleet by number of routes served; all four buckets appear, also empty ones."""
    n = F.col("routes_served")
    counts = vehicles.agg(
        F.count_if(n == 1).alias("a"), F.count_if(n == 2).alias("b"),
        F.count_if(n.between(3, 5)).alias("c"), F.count_if(n >= 6).alias("d"),
    )
    rows = counts.select(F.expr(
        "stack(4, 'Single-route workhorse (1 route)', a, 'Light cross-route (2 routes)', b, "
        "'Connector (3-5 routes)', c, 'High-flexibility (6+ routes)', d) AS (category, vehicle_count)"
    ))
    return rows.withColumn("pct_of_fleet", _share("vehicle_count"))


def top_connectors(vehicles: DataFrame, n: int = 20) -> DataFrame:
    return vehicles.orderBy(F.desc("routes_served"), F.desc("total_records"), "vehicle_id").limit(n).select(
        "vehicle_id", "total_records", "days_active", "routes_served", "primary_route", "records_per_active_day"
    )


# --- stability and resilience ----------------------------------------------------------------------

def stability_score(stability: DataFrame, dim: DataFrame) -> DataFrame:
    """0-100: 60 % steadiness (CV capped at its 95th percentile), 40 % days active."""
    names = dim.select("route_id", "route_short_name", "route_long_name", "mode", "bus_subtype")
    s = stability.where(F.col("cv_daily_records").isNotNull()).join(names, "route_id", "left")
    marks = s.agg(F.percentile("cv_daily_records", 0.95).alias("cap"), F.max("days_active").alias("most"))
    steady = F.lit(1.0) - C.ratio(F.least("cv_daily_records", "cap"), "cap")
    score = (F.lit(0.6) * steady + F.lit(0.4) * C.ratio("days_active", "most")) * 100.0
    return with_scalars(s, marks).select(
        "route_id", "route_short_name", "route_long_name", "mode", "bus_subtype", "days_active",
        "mean_daily_records", "cv_daily_records", "is_persistent", C.rnd(score).alias("stability_score"),
    )


def most_least_stable(scores: DataFrame, n: int = 15) -> DataFrame:
    keep = scores.where("is_persistent")
    best = keep.orderBy(F.desc("stability_score"), "route_id").limit(n)
    worst = keep.orderBy(F.desc("cv_daily_records"), "route_id").limit(n)
    fields = ["route_id", "bus_subtype", "cv_daily_records", "stability_score"]
    return best.select(F.lit("most_stable").alias("listing"), *fields).unionByName(
        worst.select(F.lit("least_stable").alias("listing"), *fields)
    )


def subtype_variability(stability: DataFrame, dim: DataFrame) -> DataFrame:
    s = stability.join(dim.select("route_id", "bus_subtype"), "route_id").where(F.col("bus_subtype").isNotNull())
    return s.groupBy("bus_subtype").agg(
        F.count("route_id").alias("routes"),
        C.rnd(C.grid_avg("cv_daily_records", 4), 3).alias("mean_cv"),
        C.rnd(F.median("cv_daily_records"), 3).alias("median_cv"),
        C.rnd(F.avg("days_active"), 3).alias("mean_days_active"),
    )


def daily_volume_anomalies(daily: DataFrame, limit: float = 1.5) -> DataFrame:
    """z-score of daily volume with population deviation; zero when all days are equal."""
    w = _whole()
    z = C.ratio(F.col("total_records") - F.avg("total_records").over(w), F.stddev_pop("total_records").over(w))
    return daily.select(
        "date", "day_of_week", "total_records", C.rnd(F.coalesce(z, F.lit(0.0)), 3).alias("volume_z")
    ).withColumn("is_anomaly", F.abs("volume_z") > limit)


def fragile_critical_routes(stability: DataFrame, dim: DataFrame) -> DataFrame:
    """Persistent routes in the top quarter of both load and variation."""
    keep = stability.where("is_persistent")
    marks = keep.agg(
        F.percentile("mean_daily_records", 0.75).alias("load_q"), F.percentile("cv_daily_records", 0.75).alias("cv_q")
    )
    hot = with_scalars(keep, marks).where(
        (F.col("mean_daily_records") >= F.col("load_q")) & (F.col("cv_daily_records") >= F.col("cv_q"))
    )
    names = dim.select("route_id", "route_short_name", "route_long_name", "bus_subtype")
    return hot.join(names, "route_id", "left").select(
        "route_id", "route_short_name", "route_long_name", "bus_subtype",
        "mean_daily_records", "cv_daily_records", "days_active",
    )
