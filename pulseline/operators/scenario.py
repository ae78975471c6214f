"""Event-day stress scenarios on the one-row-per-route priority table.

Everything here works on route rows. Scenario sets are literal arrays that are exploded, so no
table is crossed with another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseline.config import SCENARIO, ScenarioRules
from pulseline.functions import columns as C
from pulseline.functions.joins import with_scalars

FLAGS = tuple(name for name, _, _ in SCENARIO.exposures)


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def exposure_tags(priority: DataFrame, rules: ScenarioRules = SCENARIO) -> DataFrame:
    """Route-list flags, station transfers, and two flags relative to the network median."""
    short = F.col("route_short_name")
    middle = priority.agg(
        F.median("peak_bunching_share_pct").alias("peak_mid"), F.median("reliability_score").alias("score_mid")
    )
    return with_scalars(priority, middle).withColumns({
        "bc_place_exposure": _flag(short.isin(*rules.bc_place)),
        "downtown_exposure": _flag(short.isin(*rules.downtown)),
        "fan_festival_exposure": _flag(short.isin(*rules.festival)),
        "skytrain_connector_exposure": _flag(F.col("route_long_name").contains("Station")),
        "pm_peak_vulnerability": _flag(F.col("peak_bunching_share_pct") >= F.col("peak_mid")),
        "existing_reliability_weakness": _flag(F.col("reliability_score") < F.col("score_mid")),
        "has_extra_service": _flag(short.isin(*rules.extra_service)),
    }).drop("peak_mid", "score_mid")


def stress_base(priority: DataFrame, rules: ScenarioRules = SCENARIO) -> DataFrame:
    """Tags, capped multiplier and pre-event fragility of every route."""
    uplift = reduce(lambda a, b: a + b, [F.lit(w) * F.col(n) for n, _, w in rules.exposures])
    fragility = (
        (F.lit(100.0) - F.col("reliability_score")) + F.col("bunching_rate_pct")
        + F.lit(2.0) * F.col("severe_bunching_rate_pct")
    )
    return exposure_tags(priority, rules).withColumn("exposure_uplift", C.rnd(uplift, 4)).withColumns({
        "stress_multiplier": F.least(F.lit(1.0) + F.col("exposure_uplift"), F.lit(rules.cap)),
        "base_fragility": C.rnd(fragility, 4),
    })


def _raw(pressure: Column, rules: ScenarioRules) -> Column:
    relief = F.when(F.col("has_extra_service") == 1, F.lit(1.0 - rules.relief)).otherwise(F.lit(1.0))
    return F.col("base_fragility") * F.col("stress_multiplier") * (F.lit(1.0) + pressure) * relief


def _min_max(value: Column, window) -> Column:
    lo, hi = F.min(value).over(window), F.max(value).over(window)
    return F.when(hi == lo, F.lit(50.0)).otherwise((value - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(100.0))


def reliability_anatomy(base: DataFrame) -> DataFrame:
    """The three parts of a route's fragility, in long form."""
    return base.select("route_short_name", F.expr(
        "stack(3, 'Reliability gap (100 - score)', 100D - reliability_score, 'Bunching rate', bunching_rate_pct, "
        "'Severe bunching (weighted ×2)', 2D * severe_bunching_rate_pct) AS (component, contribution)"
    )).withColumn("contribution", C.rnd("contribution"))


def stress_scores_minmax(base: DataFrame, scenario: str | None = None, rules: ScenarioRules = SCENARIO) -> DataFrame:
    """Stress of one scenario scaled to 0-100 within the run, its band and the raw value."""
    pressure = F.lit(rules.pressure(scenario or rules.primary))
    return base.withColumn("raw_stress", C.rnd(_raw(pressure, rules), 4)).withColumn(
        "fifa_stress_score", C.rnd(_min_max(F.col("raw_stress"), Window.partitionBy()))
    ).withColumn("fifa_risk_band", C.risk_band("fifa_stress_score"))


def scenario_long(base: DataFrame, rules: ScenarioRules = SCENARIO) -> DataFrame:
    """Route x scenario rows with raw stress, from a literal scenario array."""
    options = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("pressure")) for n, p in rules.pressures])
    return base.withColumn("s", F.explode(options)).withColumn("raw", _raw(F.col("s.pressure"), rules)).select(
        "route_short_name", "route_type", F.col("s.scenario").alias("scenario"), "raw"
    )


def _wide(long: DataFrame, rules: ScenarioRules) -> DataFrame:
    names = [n for n, _ in rules.pressures]
    return long.groupBy("route_short_name", "route_type").pivot("scenario", names).agg(F.max("score"))


def scenario_matrix(base: DataFrame, rules: ScenarioRules = SCENARIO) -> DataFrame:
    """Scores against one fixed reference: the worst route under the strongest pressure."""
    top = max(p for _, p in rules.pressures)
    reference = base.agg(F.max(_raw(F.lit(top), rules)).alias("ref"))
    scored = with_scalars(scenario_long(base, rules), reference)
    ref = F.coalesce(F.nullif(F.col("ref"), F.lit(0.0)), F.lit(1.0))
    return _wide(scored.withColumn("score", C.rnd(F.col("raw") / ref * F.lit(100.0))), rules)


def scenario_matrix_minmax(base: DataFrame, rules: ScenarioRules = SCENARIO) -> DataFrame:
    """Scores scaled within each scenario; by construction every scenario ranks alike."""
    scaled = scenario_long(base, rules).withColumn("raw", C.rnd("raw", 4)).withColumn(
        "score", C.rnd(_min_max(F.col("raw"), Window.partitionBy("scenario")))
    )
    return _wide(scaled, rules)


def scenario_scores(matrix: DataFrame, scenario: str) -> DataFrame:
    return matrix.select(
        "route_short_name", "route_type", F.col(scenario).alias("fifa_stress_score"),
        C.risk_band(scenario).alias("fifa_risk_band"),
    )


def adjusted_reliability(stress: DataFrame, scores: DataFrame, rules: ScenarioRules = SCENARIO) -> DataFrame:
    """Reliability after the stress penalty, kept in 0-100, and the drop."""
    base = stress.drop("reliability_score").join(
        scores.select("route_short_name", "reliability_score"), "route_short_name", "left"
    )
    out = base.withColumn("fifa_penalty", F.col("fifa_stress_score") / F.lit(100.0) * F.lit(rules.max_penalty))
    after = F.least(F.greatest(F.col("reliability_score") - F.col("fifa_penalty"), F.lit(0.0)), F.lit(100.0))
    return out.withColumn("fifa_adjusted_reliability", C.rnd(after)).withColumns({
        "fifa_penalty": C.rnd("fifa_penalty", 4),
        "reliability_drop": C.rnd(F.col("reliability_score") - F.col("fifa_adjusted_reliability")),
    })


def scenario_delta(matrix: DataFrame, scenario: str) -> DataFrame:
    return matrix.select(
        "route_short_name", "route_type", F.col("normal_day").alias("stress_normal"),
        F.col(scenario).alias("stress_scenario"),
        C.rnd(F.col(scenario) - F.col("normal_day")).alias("stress_delta"),
        C.risk_band("normal_day").alias("band_normal"), C.risk_band(scenario).alias("band_scenario"),
    )


def scenario_band_counts(stress: DataFrame) -> DataFrame:
    """Routes per risk band; all four bands appear."""
    band = F.col("fifa_risk_band")
    one = stress.agg(*[F.count_if(band == b).alias(b) for b in ("Low", "Medium", "High", "Critical")])
    return one.select(F.expr(
        "stack(4, 'Low', Low, 'Medium', Medium, 'High', High, 'Critical', Critical) AS (fifa_risk_band, routes)"
    ))


def stress_ranking(adjusted: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.desc("fifa_stress_score"), "route_short_name")).cast("bigint")
    return adjusted.withColumn("fifa_priority_rank", rank)


def stress_by_type(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("route_type").agg(
        F.count("route_short_name").alias("routes"),
        C.rnd(C.grid_avg("reliability_score", 2)).alias("avg_baseline_rel"),
        C.rnd(C.grid_avg("fifa_adjusted_reliability", 2)).alias("avg_fifa_adj_rel"),
        C.rnd(C.grid_avg("fifa_stress_score", 2)).alias("avg_stress"),
        C.rnd(C.grid_avg("reliability_drop", 2)).alias("avg_drop"),
    )


def stress_decomposition(base: DataFrame, scenario: str, rules: ScenarioRules = SCENARIO) -> DataFrame:
    """Contribution shares per route: fragility, each active exposure, scenario pressure."""
    b = F.col("base_fragility")

    def part(label: str, weight: float, active: Column | None = None) -> Column:
        s = F.struct(F.lit(label).alias("component"), (b * F.lit(weight)).alias("raw_weight"))
        return s if active is None else F.when(active == 1, s)

    parts = F.array_compact(F.array(
        part("Baseline reliability weakness", 0.5),
        *[part(label, w, F.col(n)) for n, label, w in rules.exposures],
        part("FIFA scenario pressure", rules.pressure(scenario)),
    ))
    rows = base.select("route_short_name", F.explode(parts).alias("p")).select("route_short_name", "p.*")
    total = F.sum("raw_weight").over(Window.partitionBy("route_short_name"))
    share = F.col("raw_weight") / F.when(total == 0, F.lit(1.0)).otherwise(total) * F.lit(100.0)
    return rows.select("route_short_name", "component", C.rnd("raw_weight", 4).alias("raw_weight"),
                       C.rnd(share, 1).alias("share_pct"))


# metric, label, higher means worse
PAIR_METRICS = (
    ("reliability_score", "Reliability", False),
    ("bunching_rate_pct", "Bunching rate", True),
    ("severe_bunching_rate_pct", "Severe rate", True),
    ("intervention_priority_score", "Priority", True),
    ("fifa_stress_score", "FIFA stress", True),
)


def pair_normalized(routes: DataFrame, a: str, b: str) -> DataFrame:
    """Two routes scaled against each other per metric so that outward means more risk."""
    pair = routes.where(F.col("route_short_name").isin(a, b))
    items = F.array(*[
        F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(worse).alias("worse_high"))
        for c, label, worse in PAIR_METRICS
    ])
    long = pair.select("route_short_name", F.explode(items).alias("m")).select("route_short_name", "m.*")
    w = Window.partitionBy("metric")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    norm = F.when(hi == lo, F.lit(0.5)).otherwise((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return long.select("route_short_name", "metric", "value",
                       C.rnd(F.when(F.col("worse_high"), norm).otherwise(F.lit(1.0) - norm), 4).alias("risk"))


def pair_verdict(routes: DataFrame, a: str, b: str) -> DataFrame:
    """The route of a pair under more stress; a wins ties."""
    first = F.when(F.col("route_short_name") == a, 0).otherwise(1)
    worst = F.min(F.struct((-F.col("fifa_stress_score")).alias("neg"), first.alias("f"), "route_short_name"))
    return routes.where(F.col("route_short_name").isin(a, b)).agg(worst.alias("w")).where(
        F.col("w").isNotNull()
    ).select(
        F.col("w.route_short_name").alias("worse_route"), (-F.col("w.neg")).alias("stress")
    )


def route_comparison(priority: DataFrame, adjusted: DataFrame, hotspots: DataFrame, a: str, b: str) -> DataFrame:
    per_route = hotspots.groupBy("route_short_name").agg(
        F.count(F.lit(1)).alias("hotspot_count"), F.sum("severe_events").alias("severe_total")
    )
    stress = adjusted.select("route_short_name", "fifa_stress_score", "fifa_risk_band",
                             "fifa_adjusted_reliability", "reliability_drop")
    return (
        priority.where(F.col("route_short_name").isin(a, b))
        .join(stress, "route_short_name", "left").join(per_route, "route_short_name", "left")
    )


def route_record(route: str, priority: DataFrame, scores: DataFrame, stress: DataFrame) -> DataFrame:
    """Everything known about one route, in one row."""
    p = priority.where(F.col("route_short_name") == route).select(
        "route_short_name", "route_long_name", "intervention_priority_score", "hotspot_segments")
    r = scores.select("route_short_name", "reliability_score", "reliability_band", "bunching_rate_pct")
    f = stress.select("route_short_name", "stress_multiplier", "fifa_stress_score", "fifa_risk_band")
    return p.join(r, "route_short_name", "left").join(f, "route_short_name", "left")


def hotspot_risk_overlay(hotspots: DataFrame, ranked: DataFrame, n: int = 15) -> DataFrame:
    """Hotspots weighted by their route's stress; the n riskiest."""
    risk = ranked.select("route_short_name", "fifa_stress_score", "fifa_risk_band", "fifa_priority_rank")
    score = (F.col("bunching_events") + 3 * F.col("severe_events")) * (F.col("fifa_stress_score") / F.lit(100.0))
    return (
        hotspots.join(risk, "route_short_name", "left").withColumn("hotspot_risk_score", C.rnd(score))
        .orderBy(F.desc_nulls_last("hotspot_risk_score"), "route_short_name", "direction_id", "shape_id", "route_segment_km")
        .limit(n)
    )


def executive_callouts(ranked: DataFrame, hotspots: DataFrame, priority: DataFrame) -> DataFrame:
    """Four headline cards, each the top route by one measure (ties to the smaller name)."""
    def top(df: DataFrame, title: str, by: str) -> DataFrame:
        best = F.min(F.struct((-F.col(by)).cast("double").alias("neg"), "route_short_name")).alias("b")
        return df.agg(best).where(F.col("b").isNotNull()).select(F.lit(title).alias("title"), F.col("b.route_short_name").alias("route"),
                                   C.rnd(-F.col("b.neg")).alias("value"))

    severe = hotspots.groupBy("route_short_name").agg(F.sum("severe_events").alias("severe_events"))
    return (
        top(ranked, "Most vulnerable route", "fifa_stress_score")
        .unionByName(top(ranked, "Largest FIFA reliability drop", "reliability_drop"))
        .unionByName(top(severe, "Most severe hotspot corridor", "severe_events"))
        .unionByName(top(priority, "Highest intervention priority", "intervention_priority_score"))
    )


def extra_service_gap(priority: DataFrame, rules: ScenarioRules = SCENARIO) -> DataFrame:
    """Announced extra-service routes, monitored or not."""
    monitored = priority.select("route_short_name").distinct()
    spark = priority.sparkSession
    announced = spark.createDataFrame([(r,) for r in rules.extra_service], "route_short_name string")
    both = announced.intersect(monitored).withColumn("status", F.lit("monitored"))
    gap = announced.exceptAll(monitored).withColumn("status", F.lit("gap"))
    return both.unionByName(gap)


def frame_quality_gate(table: DataFrame, key: str = "route_id") -> DataFrame:
    """One row of violation counts: duplicate keys, NULLs, range breaks."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in table.columns])
    return table.agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"),
        nulls.alias("null_cells"),
        F.count_if(~F.col("reliability_score").between(0, 100)).alias("score_out_of_range"),
        F.count_if(F.col("bunching_rate_pct") < 0).alias("negative_rates"),
    )


def stress_headline(ranked: DataFrame) -> DataFrame:
    """High or critical routes, already weak routes, the top three and the festival corridor."""
    by_rank = F.struct("fifa_priority_rank", "route_short_name")
    names = lambda arr: F.array_join(F.transform(F.array_sort(arr), lambda x: x["route_short_name"]), ", ")
    return ranked.agg(
        F.count_if(F.col("fifa_risk_band").isin("High", "Critical")).alias("high_or_critical"),
        F.count_if(F.col("existing_reliability_weakness") == 1).alias("already_weak"),
        names(F.collect_list(F.when(F.col("fifa_priority_rank") <= 3, by_rank))).alias("top_three"),
        names(F.collect_list(F.when(F.col("fan_festival_exposure") == 1, by_rank))).alias("festival_routes"),
    )


# Narrative phrases in the order they are considered, and the sentence formats.
REASONS = (
    ("existing_reliability_weakness", "already-elevated bunching"),
    ("downtown_or_venue", "a downtown / BC Place corridor"),
    ("fan_festival_exposure", "Fan Festival access to Hastings Park"),
    ("pm_peak_vulnerability", "strong peak-period concentration"),
    ("skytrain_connector_exposure", "a SkyTrain transfer point"),
)
INTENSITIES = (
    "one of the most severe reliability issues in the monitored network",
    "a recurring reliability pressure point",
    "a localized issue",
)
RELIEF_NOTE = " Announced extra service partly offsets this."
STRONG = "Route %s (%s) is %s-risk under %s%s Projected reliability falls about %s points, from %s.%s"
STRONG_WHY = " because it combines %s."
MIDDLE = "Route %s (%s) sees moderate degradation under %s%s Reliability eases ~%s points but stays workable.%s"
MIDDLE_WHY = " — driven by %s."
CALM = "Route %s (%s) stays low-risk under %s, benefiting from a strong baseline (%s) and limited venue exposure.%s"
HOTSPOT = "Between %s and %s, route %s recorded %s bunching events%s%s. This represents %s."
HOTSPOT_SEVERE = " including %s severe events"
HOTSPOT_GAP = " with a median spacing gap of about %s m"
VERDICT = ("%s of %s corridors are fragile (below-median reliability). %s go FIFA-critical under %s. "
           "Top concern: route %s (%s).")


def _whole(c) -> Column:
    return C.rnd(c, 0).cast("bigint").cast("string")


def route_narratives(adjusted: DataFrame, label: str) -> DataFrame:
    """One sentence per route, worded by its risk band, naming at most three (or two) reasons."""
    active = {n: F.col(n) == 1 for n in FLAGS} | {
        "downtown_or_venue": (F.col("bc_place_exposure") == 1) | (F.col("downtown_exposure") == 1)
    }
    t = adjusted.withColumn("reasons", F.array_compact(F.array(*[F.when(active[n], F.lit(x)) for n, x in REASONS])))

    def why(text: str, most: int) -> Column:
        named = F.format_string(text, F.array_join(F.slice("reasons", 1, most), ", "))
        return F.when(F.size("reasons") > 0, named).otherwise(".")

    short, long, scenario = F.col("route_short_name"), F.col("route_long_name"), F.lit(label)
    relief = F.when(F.col("has_extra_service") == 1, RELIEF_NOTE).otherwise("")
    drop, score, band = _whole("reliability_drop"), _whole("reliability_score"), F.col("fifa_risk_band")
    return t.select(
        "route_short_name",
        F.when(band.isin("High", "Critical"),
               F.format_string(STRONG, short, long, F.lower(band), scenario, why(STRONG_WHY, 3), drop, score, relief))
        .when(band == "Medium", F.format_string(MIDDLE, short, long, scenario, why(MIDDLE_WHY, 2), drop, relief))
        .otherwise(F.format_string(CALM, short, long, scenario, score, relief)).alias("narrative"),
    )


def hotspot_narratives(hot_stops: DataFrame) -> DataFrame:
    """One sentence per hotspot with its intensity."""
    severe, events, gap = F.col("severe_events"), F.col("bunching_events"), F.col("median_gap_km")
    intensity = (
        F.when((severe >= 5) | (events >= 80), INTENSITIES[0]).when(events >= 30, INTENSITIES[1]).otherwise(INTENSITIES[2])
    )
    return hot_stops.select(
        "route_short_name", "direction_id", "shape_id", "route_segment_km",
        F.format_string(
            HOTSPOT, F.coalesce("stop_before_name", F.lit("None")), F.coalesce("stop_after_name", F.lit("None")),
            F.col("route_short_name"), events.cast("string"),
            F.when(severe > 0, F.format_string(HOTSPOT_SEVERE, severe.cast("string"))).otherwise(""),
            F.when(gap.isNotNull(), F.format_string(HOTSPOT_GAP, _whole(gap * 1000))).otherwise(""), intensity,
        ).alias("narrative"),
    )


def verdict_sentence(priority: DataFrame, ranked: DataFrame, label: str) -> DataFrame:
    """The network's one-line verdict."""
    middle = priority.agg(F.median("reliability_score").alias("mid"))
    counts = with_scalars(priority, middle).agg(
        F.count_if(F.col("reliability_score") < F.col("mid")).alias("weak"), F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct("fifa_priority_rank", "route_short_name", "route_long_name"))
    stress = ranked.agg(F.count_if(F.col("fifa_risk_band").isin("High", "Critical")).alias("crit"), top.alias("t"))
    return with_scalars(counts, stress).select(F.format_string(
        VERDICT, F.col("weak").cast("string"), F.col("n").cast("string"), F.col("crit").cast("string"), F.lit(label),
        F.col("t.route_short_name"), F.col("t.route_long_name"),
    ).alias("verdict"))


def display_top_n(delta: DataFrame, adjusted: DataFrame, ranked: DataFrame) -> DataFrame:
    """The display lists: 12 largest deltas, 12 lowest adjusted scores, 10 highest stress scores."""
    def head(df, name, by, n, descending=True):
        order = F.desc(by) if descending else F.asc(by)
        return df.orderBy(order, "route_short_name").limit(n).select(
            F.lit(name).alias("listing"), "route_short_name", F.col(by).alias("value"))

    return (
        head(delta, "scenario_delta", "stress_delta", 12)
        .unionByName(head(adjusted, "adjusted_reliability", "fifa_adjusted_reliability", 12, False))
        .unionByName(head(ranked, "stress", "fifa_stress_score", 10))
    )
