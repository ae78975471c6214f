"""The end-to-end jobs on the bound test tables."""

from pyspark.sql import functions as F

from pulseline.config import EligibilityRules
from pulseline.plans import jobs
from pulseline.plans.domain import Domain
from pulseline.sources import sinks

FOLDER = "/root/testdata/sf0.01"


def _line(spark):
    """One straight 20 km shape; ten vehicles seen hourly on two days, two of them 200 m apart."""
    n = F.col("id")
    shapes = spark.range(101).select(
        F.lit("s").alias("shape_id"), (F.lit(49.2) + n * 0.0018).alias("shape_pt_lat"), F.lit(-123.0).alias("shape_pt_lon"),
        n.cast("int").alias("shape_pt_sequence"), (n * 0.2).alias("shape_dist_traveled"))
    hour, vehicle = F.floor(n / 10), n % 10
    at = F.when(vehicle == 1, 11).otherwise(10 + vehicle * 8) + F.pmod(hour, F.lit(5))
    pings = spark.range(2 * 14 * 10).select(
        F.timestamp_seconds(F.lit(1767225600) + F.floor(hour / 14) * 86400 + F.pmod(hour, F.lit(14)) * 3600).alias("collection_timestamp"),
        F.timestamp_seconds(F.lit(1767225600) + n).alias("api_vehicle_timestamp"), n.cast("string").alias("entity_id"),
        F.concat(F.lit("V"), vehicle.cast("string")).alias("vehicle_id"), F.lit("1").alias("route_id"), F.lit("t").alias("trip_id"),
        (F.lit(49.2) + at * 0.0018).alias("latitude"), F.lit(-123.0).alias("longitude"), F.lit(0.0).alias("bearing"), F.lit(0.0).alias("speed"))
    schedule = {
        "routes": spark.createDataFrame([("1", "R4", "41st Avenue", 3), ("2", "099", "Broadway", 3)],
                                        "route_id string, route_short_name string, route_long_name string, route_type int"),
        "trips": spark.createDataFrame([("t", "1", "x", "s", 0)],
                                       "trip_id string, route_id string, service_id string, shape_id string, direction_id int"),
        "stops": spark.createDataFrame([("a", "First", 49.2, -123.0), ("b", "Last", 49.3, -123.0)],
                                       "stop_id string, stop_name string, stop_lat double, stop_lon double"),
        "stop_times": spark.createDataFrame([("t", "a", 1, 0.0), ("t", "b", 2, 20.0)],
                                            "trip_id string, stop_id string, stop_sequence int, shape_dist_traveled double"),
        "shapes": shapes,
    }
    return pings, schedule


def test_reliability_job_produces_every_gold_table(spark, tmp_path):
    pings, schedule = _line(spark)
    out = jobs.network_reliability(pings, schedule, eligibility_rules=EligibilityRules(min_observations=100))
    rows = sinks.gold_publish(out, str(tmp_path))
    score = out["route_reliability_scores"].first()
    # newest eligible day only: 14 snapshots, one gap of 0.2 km and eight of more than 0.5 km in each
    assert str(score.service_date) == "2026-01-02" and rows["route_reliability_scores"] == 1
    assert (score.total_spacing_rows, score.total_bunching_events, score.severe_events) == (14 * 9, 14, 0)
    assert score.route_type == "RapidBus" and score.bunching_rate_pct == 11.11
    spots = out["bunching_hotspots_with_stops"].collect()
    assert {(s.stop_before_name, s.stop_after_name) for s in spots} == {("First", "Last")}
    assert sum(s.bunching_events for s in spots) == 14
    assert out["corridor_priority_ranking"].first().worst_segment_events == max(s.bunching_events for s in spots)
    none = jobs.network_reliability(pings, schedule, ["099"], eligibility_rules=EligibilityRules(min_observations=100))
    assert none["route_reliability_scores"].count() == 0
    strict = jobs.network_reliability(pings, schedule)
    assert strict["route_reliability_scores"].count() == 0


def test_activity_and_intelligence_jobs(spark):
    d = Domain(spark, FOLDER)
    metrics = jobs.activity_metrics(d.raw_pings)
    layers = jobs.network_intelligence(metrics, d.routes)
    assert metrics["daily_summary"].count() == 30
    assert layers["pareto_concentration"].count() == 25
    assert layers["network_centralization"].count() == 7
    assert layers["telemetry_blind_spots"].count() == 5
