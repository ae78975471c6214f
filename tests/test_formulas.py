"""Published results of the formulas, copied as numbers."""

import pytest
from pyspark.sql import functions as F

from pulseline.functions import columns as C
from pulseline.operators import network as net
from pulseline.operators import scenario as sc
from pulseline.operators import scoring as sco


def test_score_of_a_published_route(spark):
    # 13579 spacing rows, 1000 events, 110 severe, 534 in peak hours
    n = F.col("id")
    rows = spark.range(13579).select(
        F.lit("6641").alias("route_id"), F.lit("2026-05-23").alias("service_date"),
        F.when(n < 110, 0.05).when(n < 1000, 0.3).otherwise(1.5).alias("distance_to_next_bus_km"),
        F.when(n < 534, F.lit("2026-05-23 16:00:00")).otherwise("2026-05-23 12:00:00").cast("timestamp").alias("collection_timestamp"),
    )
    out = sco.reliability_scores(rows).first()
    assert (out.total_spacing_rows, out.total_bunching_events, out.severe_events, out.peak_events) == (13579, 1000, 110, 534)
    assert (out.bunching_rate_pct, out.severe_bunching_rate_pct, out.peak_bunching_share_pct) == (7.36, 0.81, 53.4)
    assert (out.reliability_score, out.reliability_band) == (84.21, "Watch")


def test_no_events_gives_full_score_and_null_share(spark):
    rows = spark.createDataFrame(
        [("a", "d", 2.0, "2026-01-01 08:00:00")], "route_id string, service_date string, distance_to_next_bus_km double, t string"
    ).withColumn("collection_timestamp", F.col("t").cast("timestamp"))
    out = sco.reliability_scores(rows).first()
    assert out.reliability_score == 100.0 and out.peak_bunching_share_pct is None and out.reliability_band == "Reliable"


def test_priority_of_a_published_route(spark):
    scores = spark.createDataFrame([("37810", 77.6, 12.03, 2.14)],
                                   "route_id string, reliability_score double, bunching_rate_pct double, severe_bunching_rate_pct double")
    hot = spark.createDataFrame([("37810", 3.5, 111, 17), ("37810", 3.5, 4, 20)],
                                "route_id string, route_segment_km double, bunching_events bigint, severe_events bigint")
    out = sco.corridor_priority(scores, hot).first()
    assert out.intervention_priority_score == 52.42
    # rows counted, and the two maxima taken on their own
    assert (out.hotspot_segments, out.distinct_segments, out.worst_segment_events, out.worst_segment_severe_events) == (2, 1, 111, 20)


def test_stress_of_a_published_route(spark):
    base = spark.createDataFrame([("R4", 38.71, 1.5, 0, 77.6), ("x", 0.0, 1.0, 0, 99.0)],
                                 "route_short_name string, base_fragility double, stress_multiplier double, has_extra_service int, "
                                 "reliability_score double")
    stress = sc.stress_scores_minmax(base)
    top = stress.where("route_short_name = 'R4'").first()
    assert top.raw_stress == pytest.approx(90.0008, abs=1e-4)
    assert (top.fifa_stress_score, top.fifa_risk_band) == (100.0, "Critical")
    adj = sc.adjusted_reliability(stress, base).where("route_short_name = 'R4'").first()
    assert (adj.fifa_penalty, adj.fifa_adjusted_reliability, adj.reliability_drop) == (25.0, 52.6, 25.0)


def test_flat_stress_is_fifty(spark):
    base = spark.createDataFrame([("a", 1.0, 1.0, 0), ("b", 1.0, 1.0, 0)],
                                 "route_short_name string, base_fragility double, stress_multiplier double, has_extra_service int")
    assert {r.fifa_stress_score for r in sc.stress_scores_minmax(base).collect()} == {50.0}


def test_hotspot_risk_of_a_published_segment(spark):
    hot = spark.createDataFrame([("R4", 0, "s", 1.0, 111, 17)],
                                "route_short_name string, direction_id int, shape_id string, route_segment_km double, "
                                "bunching_events bigint, severe_events bigint")
    ranked = spark.createDataFrame([("R4", 100.0, "Critical", 1)],
                                   "route_short_name string, fifa_stress_score double, fifa_risk_band string, fifa_priority_rank int")
    assert sc.hotspot_risk_overlay(hot, ranked).first().hotspot_risk_score == 162.0


def test_band_edges(spark):
    df = spark.createDataFrame([(0.10,), (0.25,), (0.50,), (0.51,)], "g double")
    assert [r[0] for r in df.select(C.severity("g")).collect()] == ["Severe", "High", "Moderate", "Normal"]
    df = spark.createDataFrame([(0.0,), (25.0,), (45.0,), (65.0,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(C.risk_band("s")).collect()] == ["Low", "Medium", "High", "Critical", "Unknown"]


def test_gini_and_both_top_shares(spark):
    activity = spark.createDataFrame([(str(i), v) for i, v in enumerate([10, 20, 30, 40, 0, 0, 0, 0, 0, 0])],
                                     "route_id string, total_records bigint")
    stability = spark.createDataFrame([(True,), (False,)], "is_persistent boolean")
    got = {r.metric: r.value for r in net.network_centralization(activity, stability).collect()}
    x = sorted([10, 20, 30, 40] + [0] * 6)
    gini = (2 * sum((i + 1) * v for i, v in enumerate(x)) - 11 * sum(x)) / (10 * sum(x))
    assert got["Gini coefficient"] == pytest.approx(gini, abs=1e-4)
    assert got["Top 10% share (index)"] == 70.0 and got["Top 10% share (ranked)"] == 40.0
    assert got["Persistent routes"] == 1.0


def test_equal_days_have_zero_z(spark):
    d = spark.createDataFrame([("a", "Monday", 5), ("b", "Tuesday", 5)], "date string, day_of_week string, total_records bigint")
    assert {(r.volume_z, r.is_anomaly) for r in net.daily_volume_anomalies(d).collect()} == {(0.0, False)}


def test_peak_window_wraps_midnight_and_first_wins(spark):
    rows = [("n", 23, 5), ("n", 0, 5), ("n", 1, 5), ("flat", 3, 1), ("flat", 9, 1)]
    p = spark.createDataFrame(rows, "bus_subtype string, local_hour int, records bigint")
    got = {r.bus_subtype: r for r in net.peak_windows(p).collect()}
    assert got["n"].peak_window_local == "23:00–02:00" and got["n"].peak_window_records == 15
    assert got["flat"].peak_window_local == "01:00–04:00"
