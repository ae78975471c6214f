"""The skew-safe building blocks against brute force, on fixtures where one key holds most rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseline.functions.joins import heavy_keys, lookup_join, spread_join, with_scalars
from pulseline.functions.ordered import in_ranges, previous_in_series, ranked_neighbours
from pulseline.functions.quantiles import exact_percentiles
from pulseline.operators import geometry as geo
from pulseline.operators import spacing as spc


def _snapshot_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rnd.random() < 0.6
        rows.append((i, "hot" if hot else f"r{rnd.randrange(4)}", "t0" if hot else f"t{rnd.randrange(3)}", 0, "s1",
                     f"v{rnd.randrange(6)}", rnd.choice([1.0, 1.0, 1.25, 2.0, 2.5, 7.0, 7.1])))
    rnd.shuffle(rows)
    return rows


SNAP = "event_id bigint, route_id string, collection_timestamp string, direction_id int, shape_id string, vehicle_id string, " \
       "approx_shape_dist_traveled double"


@pytest.mark.parametrize("tasks", [1, 3, 20])
def test_ranked_neighbours_equals_a_plain_window(spark, tasks):
    rows = _snapshot_rows(300, 1)
    df = spark.createDataFrame(rows, SNAP)
    got = {r.event_id: (r.rank, r.next_vehicle_id, r.next_approx_shape_dist_traveled) for r in ranked_neighbours(
        df, spc.SNAPSHOT_KEYS, spc.DIST, "event_id", ["vehicle_id"], tasks=tasks).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1:5], []).append(r)
    want = {}
    for g in groups.values():
        g.sort(key=lambda r: (r[6], r[0]))
        for i, r in enumerate(g):
            nxt = g[i + 1] if i + 1 < len(g) else None
            want[r[0]] = (i + 1, nxt and nxt[5], nxt and nxt[6])
    assert got == want


def test_headways_equal_lead_with_filters_after_it(spark):
    rows = [(*r, "trip", "2024-01-01", 49.0, -123.0) for r in _snapshot_rows(400, 2)]
    df = spark.createDataFrame(rows, SNAP + ", trip_id string, api_vehicle_timestamp string, latitude double, longitude double")
    got = {(r.event_id, r.bus_rank, r.next_vehicle_id, r.distance_to_next_bus_km) for r in spc.observed_headways(df).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1:5], []).append(r)
    want = set()
    for g in groups.values():
        g.sort(key=lambda r: (r[6], r[0]))
        for i in range(len(g) - 1):
            a, b = g[i], g[i + 1]
            if b[5] != a[5] and b[6] > a[6]:
                want.add((a[0], i + 1, b[5], math.floor((b[6] - a[6]) * 1e4 + 0.5) / 1e4))
    assert got == want and want


def test_same_vehicle_ahead_hides_the_next_one(spark):
    rows = [(1, "r", "t", 0, "s", "A", 1.0), (2, "r", "t", 0, "s", "A", 2.0), (3, "r", "t", 0, "s", "B", 3.0)]
    df = spark.createDataFrame([(*r, "x", "y", 0.0, 0.0) for r in rows],
                               SNAP + ", trip_id string, api_vehicle_timestamp string, latitude double, longitude double")
    assert [(r.event_id, r.next_vehicle_id) for r in spc.observed_headways(df).collect()] == [(2, "B")]


def test_empty_input_gives_empty_headways(spark):
    df = spark.createDataFrame([], SNAP + ", trip_id string, api_vehicle_timestamp string, latitude double, longitude double")
    assert spc.observed_headways(df).count() == 0


def test_unknown_length_passes_the_terminal_test(spark):
    df = spark.createDataFrame([(0.75, 20.0), (0.76, 20.0), (19.25, 20.0), (19.24, 20.0), (50.0, None)],
                               "approx_shape_dist_traveled double, shape_length_km double")
    assert sorted(r[0] for r in spc.terminal_buffer(df).collect()) == [0.76, 19.24, 50.0]


def test_previous_in_series_crosses_empty_hours(spark):
    rnd = random.Random(3)
    rows = sorted({("hot" if rnd.random() < 0.7 else "cold", rnd.randrange(0, 40 * 3600)) for _ in range(400)})
    df = spark.createDataFrame(rows, "k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.k, r.s): r.previous_s for r in previous_in_series(df, "k", "ts", ["s"]).collect()}
    want = {}
    for key in ("hot", "cold"):
        seq = [s for k, s in rows if k == key]
        want |= {(key, s): (seq[i - 1] if i else None) for i, s in enumerate(seq)}
    assert got == want


def test_exact_percentiles_match_numpy(spark):
    rnd = random.Random(4)
    rows = [("hot", rnd.gauss(0, 5)) for _ in range(800)] + [("hot", 0.0)] * 50 + [("one", 3.5)] + [("hot", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.95, "z": 0.0}).collect()}
    hot = [v for k, v in rows if k == "hot" and v is not None]
    assert got["hot"].m == pytest.approx(np.percentile(hot, 50)) and got["hot"].p == pytest.approx(np.percentile(hot, 95))
    assert got["hot"].z == min(hot) and got["one"].p == 3.5 and None not in got
    whole = exact_percentiles(df, [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.percentile([v for _, v in rows if v is not None], 50))


def test_projection_matches_brute_force_near_and_far(spark):
    rnd = random.Random(5)
    shapes = [(f"s{k}", i, 49.2 + rnd.random() / 10, -123.1 + rnd.random() / 10, i * 0.1) for k in range(3) for i in range(40)]
    shapes += [("s0", 90, shapes[0][2], shapes[0][3], 9.0)]  # coincident vertex: the smaller sequence wins
    points = [(i, f"s{rnd.randrange(4)}", 49.2 + rnd.random() / 10, -123.1 + rnd.random() / 10) for i in range(150)]
    points += [(i, "s1", 48.1 + rnd.random(), -124 + 3 * rnd.random()) for i in range(150, 260)]  # mostly far away
    points += [(260, "s0", shapes[0][2], shapes[0][3]), (261, "s0", None, 1.0), (262, None, 49.2, -123.0)]
    pdf = spark.createDataFrame(points, "event_id bigint, shape_id string, latitude double, longitude double")
    sdf = spark.createDataFrame(shapes, "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, "
                                        "shape_dist_traveled double")
    got = {r.event_id: (r.nearest_shape_sequence, r.projection_error_m, r.approx_shape_dist_traveled)
           for r in geo.project_to_shape(pdf, sdf).collect()}

    def metres(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        t = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, t)))

    own = {}
    for s in shapes:
        own.setdefault(s[0], []).append(s)
    want = {}
    for eid, sid, lat, lon in points:
        if lat is not None and sid in own:
            best = min(own[sid], key=lambda s: (metres(lat, lon, s[2], s[3]), s[1]))
            want[eid] = (best[1], metres(lat, lon, best[2], best[3]), best[4])
    assert got.keys() == want.keys()
    for k, (seq, err, dist) in want.items():
        assert got[k][0] == seq and got[k][1] == pytest.approx(err, abs=1e-4) and got[k][2] == dist
    assert got[260][0] == 0 and got[260][1] == pytest.approx(0.0, abs=1e-6)


def test_segment_stops_touching_missing_and_ties(spark):
    hot = spark.createDataFrame([("r", 0, "s", 1.0, 7), ("r", 0, "s", 9.0, 8), ("q", 1, "s", 1.0, 9)],
                                "route_id string, direction_id int, shape_id string, route_segment_km double, n int")
    stops = spark.createDataFrame(
        [("r", 0, "s", "b", "B", 1.0), ("r", 0, "s", "a", "A", 1.0), ("r", 0, "s", "c", "C", 1.5), ("r", 0, "s", "d", "D", 3.0)],
        "route_id string, direction_id int, shape_id string, stop_id string, stop_name string, stop_dist_km double")
    got = {r.n: (r.stop_before_id, r.stop_after_id, r.segment_end_km) for r in geo.hotspots_with_stops(hot, stops).collect()}
    assert got == {7: ("a", "c", 1.5), 8: ("d", None, 9.5), 9: (None, None, 1.5)}


def test_lookup_join_keeps_null_keys_unmatched(spark):
    facts = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "event_id bigint, trip_id string")
    dim = spark.createDataFrame([("a", 1), (None, 2)], "trip_id string, x int")
    out = lookup_join(facts, dim, "trip_id", "event_id").collect()
    assert len(out) == 20 and {r.x for r in out if r.trip_id == "a"} == {1} and {r.x for r in out if r.trip_id is None} == {None}


def test_with_scalars_is_no_join(spark):
    df = spark.range(5)
    out = with_scalars(df, df.agg(F.max("id").alias("top"), F.min("id").alias("low")))
    assert {(r.top, r.low) for r in out.collect()} == {(4, 0)}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_a_hot_group_are_bounded_in_size_and_number(spark):
    """Free-running distances and hashed ids: neither makes a piece of its own."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("route_id"),
        (F.rand(4) * 30).alias("km"), F.xxhash64("id").alias("event_id"),
    )
    tied = df.withColumn("km", F.lit(1.0))
    for frame in (df, tied):
        sizes = [r["count"] for r in in_ranges(frame, ["route_id", "km", "event_id"], 16).groupBy("route_id", "__piece").count().collect()]
        assert len(sizes) <= 51 + 16 and max(sizes) <= 3 * 20_000 / 16


def test_heavy_keys_are_few_and_spread_evenly(spark):
    """A third of the rows in one key: its rows are dealt into parts, its right rows repeated."""
    left = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(5000)))).alias("k"))
    right = left.select("k").distinct().withColumn("v", F.upper("k"))
    heavy = heavy_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"])
    assert [(r.k, r["__salts"]) for r in heavy.collect()] == [("hot", 86)]
    joined = spread_join(left, right, ["k"], heavy, ["id"])
    rows = joined.collect()
    assert len(rows) == 30_000 and all(r.v == r.k.upper() for r in rows)
    seen = left.filter("k = 'hot'").groupBy(F.pmod(F.xxhash64("id"), F.lit(86))).count().collect()
    assert max(r["count"] for r in seen) <= 3 * 30_000 / 256
    assert heavy_keys(left.groupBy("id").agg(F.count(F.lit(1)).alias("n")), ["id"]) is None


def test_projection_with_a_hot_cell_and_a_third_far_away(spark):
    rnd = random.Random(8)
    shapes = [(f"s{k}", i, 49.2 + k / 50 + i / 4000, -123.1 + i / 3000, i * 0.1) for k in range(4) for i in range(60)]
    points = [(i, "s0", 49.2 + rnd.random() / 2000, -123.1 + rnd.random() / 2000) for i in range(500)]
    points += [(500 + i, f"s{i % 4}", 47.0 + rnd.random(), -124.5 + rnd.random()) for i in range(500)]
    points += [(1000 + i, "s2", 49.25, -123.09) for i in range(500)]  # parked
    pdf = spark.createDataFrame(points, "event_id bigint, shape_id string, latitude double, longitude double")
    sdf = spark.createDataFrame(shapes, "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, shape_dist_traveled double")
    got = {r.event_id: r.nearest_shape_sequence for r in geo.project_to_shape(pdf, sdf).collect()}

    def term(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2

    assert got == {i: min((s for s in shapes if s[0] == sid), key=lambda s: (term(lat, lon, s[2], s[3]), s[1]))[1] for i, sid, lat, lon in points}
