"""Reliability foundation, eligibility, scores and intervention priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulseline.config import ELIGIBILITY, SCORE, SPACING, EligibilityRules, ScoreRules, SpacingRules
from pulseline.functions import columns as C
from pulseline.functions import rollups as roll
from pulseline.functions.joins import with_scalars

def _n():
    return F.count(F.lit(1))


def route_hourly_summary(silver: DataFrame) -> DataFrame:
    keys = ["service_date", "route_id", "hour_of_day"]
    return roll.cells(silver, [*keys, "vehicle_id", "trip_id"]).groupBy(*keys).agg(
        roll.rows().alias("total_observations"),
        F.count_distinct("vehicle_id").alias("unique_vehicles"),
        F.count_distinct("trip_id").alias("unique_trips"), *roll.seen(),
    )


def route_daily_summary(silver: DataFrame) -> DataFrame:
    keys = ["service_date", "route_id"]
    known = silver.where(F.col("route_id").isNotNull())
    return roll.cells(known, [*keys, "hour_of_day", "vehicle_id", "trip_id"]).groupBy(*keys).agg(
        roll.rows().alias("total_observations"),
        F.count_distinct("vehicle_id").alias("unique_vehicles"),
        F.count_distinct("trip_id").alias("unique_trips"),
        F.count_distinct("hour_of_day").alias("observed_service_hours"), *roll.seen(),
    )


def route_quality_summary(positions: DataFrame) -> DataFrame:
    """Completeness per date and route; NULL routes form a group of their own."""
    no_place = F.col("latitude").isNull() | F.col("longitude").isNull()
    whole = ~no_place & F.col("vehicle_id").isNotNull() & F.col("route_id").isNotNull()
    flags = {
        "missing_location_rows": no_place, "missing_vehicle_rows": F.col("vehicle_id").isNull(),
        "missing_route_rows": F.col("route_id").isNull(), "__whole": whole,
    }
    keys = ["service_date", "route_id"]
    return roll.cells(positions, [*keys, "vehicle_id", "trip_id"], flags).groupBy(*keys).agg(
        roll.rows().alias("total_observations"),
        F.count_distinct("vehicle_id").alias("unique_vehicles"),
        F.count_distinct("trip_id").alias("unique_trips"),
        *[F.sum(name).alias(name) for name in flags if name != "__whole"],
        C.rnd(C.ratio(F.sum("__whole"), roll.rows(), 100)).alias("valid_row_percentage"),
    )


def route_hourly_stability(silver: DataFrame) -> DataFrame:
    """Variation of hourly volume inside a route-day; hours without service are not zeros."""
    keys = ["service_date", "route_id", "hour_of_day"]
    known = silver.where(F.col("route_id").isNotNull())
    hourly = roll.cells(known, [*keys, "vehicle_id", "trip_id"]).groupBy(*keys).agg(
        roll.rows().alias("n"), F.count_distinct("vehicle_id").alias("v"), F.count_distinct("trip_id").alias("t")
    )
    per_day = hourly.groupBy("service_date", "route_id").agg(
        _n().alias("observed_service_hours"),
        F.sum("n").alias("total_observations"),
        F.avg("n").alias("mean_n"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd_n"),
        F.avg("v").alias("mean_v"), F.avg("t").alias("mean_t"),
    )
    cv = C.ratio("sd_n", "mean_n")
    return per_day.select(
        "service_date", "route_id", "observed_service_hours", "total_observations",
        C.rnd("mean_n").alias("avg_hourly_observations"),
        C.rnd("sd_n").alias("stddev_hourly_observations"),
        C.rnd("mean_v").alias("avg_hourly_vehicles"),
        C.rnd("mean_t").alias("avg_hourly_trips"),
        C.rnd(cv, 4).alias("observation_cv"),
        C.coverage_band("observed_service_hours").alias("coverage_band"),
        C.stability_band(cv).alias("stability_band"),
    )


def route_eligibility(
    stability: DataFrame, quality: DataFrame, rules: EligibilityRules = ELIGIBILITY
) -> DataFrame:
    valid = quality.select("service_date", "route_id", "valid_row_percentage")
    return stability.join(valid, ["service_date", "route_id"], "left").select(
        "service_date", "route_id", "observed_service_hours", "total_observations", "observation_cv",
        "coverage_band", "stability_band", "valid_row_percentage",
        C.eligibility("observed_service_hours", "total_observations", "valid_row_percentage", rules)
        .alias("eligibility_status"),
    )


def eligibility_rollups(eligibility: DataFrame, quality: DataFrame) -> DataFrame:
    """Route-days by status, coverage and stability band, plus the validity range, in long form.

    Every row is exploded to its three labels so the rollups share one scan and one shuffle.
    """
    labels = F.explode(F.array(
        F.struct(F.lit("eligibility_status").alias("rollup"), F.col("eligibility_status").alias("label")),
        F.struct(F.lit("coverage_band").alias("rollup"), F.col("coverage_band").alias("label")),
        F.struct(F.lit("stability_band").alias("rollup"), F.col("stability_band").alias("label")),
    ))
    bands = eligibility.select(labels.alias("x")).groupBy("x.rollup", "x.label").agg(
        _n().cast("double").alias("value")
    )
    q = F.col("valid_row_percentage")
    spread = quality.agg(F.min(q).alias("a"), C.grid_avg(q, 2).alias("b"), F.max(q).alias("c")).select(
        F.expr("stack(3, 'min', a, 'avg', b, 'max', c) AS (label, value)")
    ).select(F.lit("valid_row_percentage").alias("rollup"), "label", C.rnd("value").alias("value"))
    return bands.unionByName(spread)


def eligible_days(eligibility: DataFrame, status: str = "Eligible") -> DataFrame:
    """Days with a status for every route that has one."""
    return eligibility.where(F.col("eligibility_status") == status).groupBy("route_id").agg(_n().alias("route_days"))


def latest_eligible_date(silver: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Pings of each route's newest eligible day.

    One join against one row per route; adaptive execution broadcasts it if its measured bytes allow.
    """
    newest = eligibility.where(F.col("eligibility_status") == "Eligible").groupBy("route_id").agg(
        F.max("service_date").alias("service_date")
    )
    return silver.join(newest, ["route_id", "service_date"], "inner")


def reliability_scores(
    headways: DataFrame, grain: Sequence[str] = ("service_date", "route_id"), tz: str = "UTC",
    spacing: SpacingRules = SPACING, rules: ScoreRules = SCORE,
) -> DataFrame:
    """Bunching rates and the 0-100 score with its band per grain.

    Bunching events are headways under the moderate limit, so spacing rows and events are counted
    in one conditional aggregate instead of joining two. Rates are rounded before they enter the
    score; the band looks at the score before rounding.
    """
    gap = F.col("distance_to_next_bus_km")
    close = gap <= spacing.moderate_km
    peak = C.peak_period(F.hour(C.in_zone("collection_timestamp", tz))) != "Off Peak"
    rates = headways.groupBy(*grain).agg(
        _n().alias("total_spacing_rows"),
        F.count_if(close).alias("total_bunching_events"),
        F.count_if(gap <= spacing.severe_km).alias("severe_events"),
        F.count_if(close & peak).alias("peak_events"),
    ).withColumns({
        "bunching_rate_pct": C.rnd(C.ratio("total_bunching_events", "total_spacing_rows", 100)),
        "severe_bunching_rate_pct": C.rnd(C.ratio("severe_events", "total_spacing_rows", 100)),
        "peak_bunching_share_pct": C.rnd(C.ratio("peak_events", "total_bunching_events", 100)),
    })
    raw = (
        F.lit(100.0) - F.col("bunching_rate_pct") * rules.rate_weight
        - F.col("severe_bunching_rate_pct") * rules.severe_weight
        - F.coalesce("peak_bunching_share_pct", F.lit(0.0)) * rules.peak_weight
    )
    return rates.withColumn("raw", raw).withColumns({
        "reliability_score": F.greatest(F.lit(0.0), C.rnd("raw")),
        "reliability_band": C.reliability_band(F.greatest(F.lit(0.0), F.col("raw"))),
    }).drop("raw")


def route_type_summary(scores: DataFrame) -> DataFrame:
    def mean(c):
        return C.rnd(C.grid_avg(c, 2))

    return scores.groupBy("route_type").agg(
        _n().alias("route_count"),
        mean("reliability_score").alias("avg_reliability_score"),
        C.rnd(F.min("reliability_score")).alias("worst_reliability_score"),
        C.rnd(F.max("reliability_score")).alias("best_reliability_score"),
        mean("bunching_rate_pct").alias("avg_bunching_rate_pct"),
        mean("severe_bunching_rate_pct").alias("avg_severe_bunching_rate_pct"),
        mean("peak_bunching_share_pct").alias("avg_peak_bunching_share_pct"),
        F.sum("total_bunching_events").alias("total_bunching_events"),
        F.sum("severe_events").alias("total_severe_events"),
    )


def corridor_priority(scores: DataFrame, hotspots: DataFrame, rules: ScoreRules = SCORE) -> DataFrame:
    """Scores plus hotspot pressure. Hotspots are reduced to one row per route before the join.

    `hotspot_segments` counts hotspot rows (direction x shape x segment); `distinct_segments`
    counts different segment marks.
    """
    per_route = hotspots.groupBy("route_id").agg(
        F.count("route_segment_km").alias("h_rows"),
        F.count_distinct("route_segment_km").alias("h_marks"),
        F.max("bunching_events").alias("h_events"),
        F.max("severe_events").alias("h_severe"),
    )
    zero = F.lit(0)
    out = scores.join(per_route, "route_id", "left").withColumns({
        "hotspot_segments": F.coalesce("h_rows", zero),
        "distinct_segments": F.coalesce("h_marks", zero),
        "worst_segment_events": F.coalesce("h_events", zero),
        "worst_segment_severe_events": F.coalesce("h_severe", zero),
    }).drop("h_rows", "h_marks", "h_events", "h_severe")
    score = (
        (F.lit(100.0) - F.col("reliability_score"))
        + F.col("bunching_rate_pct") * rules.priority_rate_weight
        + F.col("severe_bunching_rate_pct") * rules.priority_severe_weight
        + F.col("worst_segment_events") * rules.priority_segment_weight
    )
    return out.withColumn("intervention_priority_score", C.rnd(score))


def fragile_routes(priority: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Routes scoring below the median of the monitored network, optionally of some classes."""
    middle = priority.agg(F.median("reliability_score").alias("threshold"))
    out = with_scalars(priority, middle).where(F.col("reliability_score") < F.col("threshold")).drop("threshold")
    return out if classes is None else out.where(F.col("route_type").isin(*classes))


def network_kpis(priority: DataFrame) -> DataFrame:
    """One row of headline numbers; ties go to the smaller short name."""
    worst = F.min(F.struct("reliability_score", "route_short_name"))
    gain = F.min(F.struct((-F.col("intervention_priority_score")).alias("neg"), "route_short_name"))
    return priority.agg(
        _n().alias("routes_monitored"), C.rnd(C.grid_avg("reliability_score", 2), 1).alias("avg_reliability"),
        F.sum("total_bunching_events").alias("total_bunching"), worst.alias("w"), gain.alias("g"),
    ).select(
        "routes_monitored", "avg_reliability", "total_bunching",
        F.col("w.route_short_name").alias("worst_corridor"),
        C.rnd("w.reliability_score", 1).alias("worst_corridor_score"),
        F.col("g.route_short_name").alias("biggest_win"),
        C.rnd(-F.col("g.neg"), 1).alias("biggest_win_score"),
    )


def volatile_and_stable_days(stability: DataFrame, n: int = 20) -> DataFrame:
    """The n most volatile route-days, and the n steadiest among those with high coverage."""
    fields = ["service_date", "route_id", "observed_service_hours", "total_observations",
              "observation_cv", "coverage_band", "stability_band"]
    wild = stability.orderBy(F.desc("observation_cv"), "service_date", "route_id").limit(n)
    calm = (
        stability.where(F.col("coverage_band") == "High Coverage")
        .orderBy("observation_cv", "service_date", "route_id").limit(n)
    )
    return wild.select(F.lit("most_volatile").alias("listing"), *fields).unionByName(
        calm.select(F.lit("best_high_coverage").alias("listing"), *fields)
    )
