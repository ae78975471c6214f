"""Question tagging, scope rules, grading and anchors."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pulseline.operators import phrases as ph
from pulseline.operators import questions as qs


def _one(spark, text, fn):
    return fn(spark.createDataFrame([(1, text)], "question_id int, text string")).first()


ENTITIES = [
    ("What was the reliability score of R4?", ["R4"], []),
    ("What reliability band is the 99 B-Line in?", ["099"], []),
    ("How does the Broadway B-Line perform?", ["099"], []),
    ("Tell me about route 49", ["049"], []),
    ("How is Broadway 9 doing?", ["009"], []),
    ("Compare Route 099 and R4.", ["099", "R4"], []),
    ("How is route 999 doing?", [], ["999"]),
    ("What about the R9?", [], ["R9"]),
    ("How is route 250 doing?", ["250"], []),
    ("king george blvd or KING EDWARD", ["025", "321"], []),
    ("rapidbus 4 please", ["R4"], []),
    ("In 2026 there were 12 of them", [], []),
    ("", [], []),
]


@pytest.mark.parametrize("text,routes,unresolved", ENTITIES)
def test_entities(spark, text, routes, unresolved):
    r = _one(spark, text, qs.tag_entities)
    assert (r.routes, r.unresolved) == (routes, unresolved)


TIMES = [
    ("Which routes perform worst during PM Peak?", "PM Peak", "exact"),
    ("how bad is bunching in the morning rush", "AM Peak", "high"),
    ("evening rush hour bunching", "PM Peak", "high"),
    ("what about off peak bunching", "Off Peak", "exact"),
    ("what happens at rush hour", "PM Peak", "low"),
    ("morning rush hour delays", "AM Peak", "high"),
    ("Which routes are least reliable?", None, "none"),
    (None, None, "none"),
]


@pytest.mark.parametrize("text,window,confidence", TIMES)
def test_time_windows(spark, text, window, confidence):
    r = _one(spark, text, qs.tag_time_window)
    assert (r.time_window, r.time_confidence) == (window, confidence)


METRICS = [
    ("Which routes have the worst reliability?", "reliability_score", "ASC"),
    ("Which routes are least reliable?", "reliability_score", "ASC"),
    ("Which routes are most reliable?", "reliability_score", "DESC"),
    ("Which route has the best reliability?", "reliability_score", "DESC"),
    ("Which routes have the most bunching?", "bunching_rate_pct", "DESC"),
    ("Which routes have the least bunching?", "bunching_rate_pct", "ASC"),
    ("Which routes have the worst bunching?", "bunching_rate_pct", "DESC"),
    ("Which routes have the highest bunching rate?", "bunching_rate_pct", "DESC"),
    ("Show me the priority corridor", "intervention_priority_score", None),
    ("Which corridors should operations prioritize?", "intervention_priority_score", None),
    ("Show me severe bunching", "severe_bunching_rate_pct", None),
    ("What's the weather like today?", None, None),
    ("Which routes perform worst during PM Peak?", "bunching_events_hourly", "DESC"),
]


@pytest.mark.parametrize("text,metric,order", METRICS)
def test_metrics(spark, text, metric, order):
    r = _one(spark, text, qs.tag_metric)
    assert (r.metric, r.metric_sort) == (metric, order)


STATUS = [
    ("How many passengers ride each day?", "ridership", "refused"),
    ("Which SkyTrain line is most delayed?", "skytrain_or_nonbus", "refused"),
    ("Is the Canada Line bunching?", "skytrain_or_nonbus", "refused"),
    ("What's the 099's on-time performance against schedule?", "on_time_performance", "refused"),
    ("How punctual is R4 versus the timetable?", "on_time_performance", "refused"),
    ("Is the delayed schedule causing bunching?", None, "ok"),
    ("How has R4's reliability changed over the past 6 months?", "multi_day_trend", "refused"),
    ("What is the data quality of route R4?", "unsupported_metric", "refused"),
    ("How is route 999 doing?", "non_top20_route", "refused"),
    ("Which routes have the most bunching?", None, "ok"),
    ("Compare Route 099 and R4.", None, "ok"),
    ("Worst severe bunching at rush hour?", None, "ambiguous_time"),
    ("What's the weather like?", None, "low_confidence"),
    ("   ", None, "low_confidence"),
]


@pytest.mark.parametrize("text,refusal,status", STATUS)
def test_gate(spark, text, refusal, status):
    r = _one(spark, text, qs.route_question)
    assert (r.refusal, r.status) == (refusal, status)


def test_grading(spark):
    rows = [
        (1, "refusal", "refused", "x", None), (2, "refusal", "success", "x", "y"),
        (3, "refusal_or_answer", "low_confidence", "x", None),
        (4, "single_value", "success", "R4 scored 77.6 on 41st Avenue", "The score is 77.6"),
        (5, "single_value", "success", "R4 scored 77.6", "Route R4 is fine"),
        (6, "single_value", "success", "There were 9,656 events", "There were 9656 events."),
        (7, "single_value", "success", "R4 scored 77.6", "nothing"), (8, "single_value", "empty_result", "1", ""),
        (9, "single_value", "success", "no anchors at all", "anything"),
    ]
    df = spark.createDataFrame(rows, "id int, shape string, status string, expected_answer string, answer_text string")
    got = {r.id: (r.passed, r.failure_reason) for r in qs.grade_answers(df).collect()}
    assert got[1] == (True, "") and got[2] == (False, "expected refusal, got success")
    assert got[3] == (False, "expected refusal-or-answer, got low_confidence")
    # one kind of anchor wholly missing fails; part of a kind missing does not
    assert got[4] == (False, "missing route tokens ['R4']")
    assert got[5] == (False, "missing numeric anchors ['77.6']")
    assert got[6] == (True, "") and got[9] == (True, "")
    assert got[7][1] == "missing route tokens ['R4']; missing numeric anchors ['77.6']"
    assert got[8] == (False, "answerable question returned no rows")


def test_missing_anchors_are_appended(spark):
    rows = [(1, "R4 scored 77.6", ["R4", "77.6"]), (2, "R4 did well", ["R4", "77.6", "77.6"]), (3, "", ["R4"]),
            (4, "Done!", ["9"]), (5, "ok", [])]
    df = spark.createDataFrame(rows, "id int, answer_text string, required array<string>")
    got = {r.id: r.final_text for r in qs.append_missing_anchors(df).collect()}
    assert got == {1: "R4 scored 77.6", 2: "R4 did well. Result values: 77.6.", 3: "Result values: R4.",
                   4: "Done! Result values: 9.", 5: "ok"}


def test_marks_in_the_text_name_no_route(spark):
    rows = spark.createDataFrame([("x " + qs._MARK + " y",)], "text string")
    assert qs.tag_entities(rows).first().routes == []


def _brute_matches(text, catalog):
    """All (start, end, phrase) of phrases between characters that are neither letter nor digit."""
    low = text.lower()
    out = []
    for phrase in catalog:
        pattern = rf"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])"
        out += [(m.start(), m.end(), phrase) for m in re.finditer(f"(?={pattern})", low) for m in [re.compile(pattern).match(low, m.start())]]
    return sorted(out)


def _brute_cover(found):
    taken = []
    for start, end, phrase in sorted(found, key=lambda m: (-len(m[2]), m[2], m[0])):
        if all(end <= a or b <= start for a, b, _ in taken):
            taken.append((start, end, phrase))
    return sorted(taken)


def test_matches_and_cover_match_brute_force(spark):
    rng = random.Random(4)
    words = ["a", "b", "a1", "1", "a-b", "b/a", "ab", "c."]
    catalog = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)} | {"a b", "b/a", "(a)", "%"})
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", ",", "", "\n", " (", ") "]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    texts += ["", "A B a b A-B", "(a) 5% %", texts[0]]
    book = ph.catalog_of(spark, [("k", p, p.upper(), 0, False, True) for p in catalog])
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string")
    got = ph.with_matches(df, book).withColumn("taken", ph.cover("found", "k")).withColumn("cut", ph.parts(F.col("text"))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        at = [0]
        for part in r.cut or []:
            at.append(at[-1] + len(part))
        spans = lambda ms: sorted((at[m.start - 1], at[m.start + m.size - 1], m.phrase) for m in ms)  # noqa: E731, B023
        want = _brute_matches(r.text, catalog) if r.text else []
        assert spans(r.found) == want
        assert spans(r.taken) == _brute_cover(want)


def test_letters_only_and_loose_white_space(spark):
    book = ph.catalog_of(spark, [("m", "peak share", "x", 0, True, False), ("g", "peak share", "y", 0, True, True), ("r", "peak", "z", 0, False, True)])
    df = spark.createDataFrame([("the 2peak  share4",), ("peaks share",), ("PEAK SHARE",)], "text string")
    got = {r.text: [m.kind for m in r.found] for r in ph.with_matches(df, book).collect()}
    assert got == {"the 2peak  share4": ["m"], "peaks share": [], "PEAK SHARE": ["r", "g", "m"]}


def _plan_lines(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_plan_does_not_grow_with_the_catalog(spark):
    """A catalog of 100,000 phrases from a route table, and a third of all texts equal."""
    routes = spark.range(50_000).select(F.col("id").cast("string").alias("route_short_name"), F.concat(F.lit("Line "), F.hex("id"), F.lit(" Road")).alias("route_long_name"))
    texts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("from LINE 1F ROAD to the 77")).otherwise(
        F.concat(F.lit("route "), F.col("id").cast("string"), F.lit(" on line 10 road"))).alias("text"))
    large = qs.tag_entities(texts, catalog=qs.catalog_of_routes(routes))
    small = qs.tag_entities(texts, catalog=qs.catalog_of_routes(routes.limit(10)))
    assert qs.catalog_of_routes(routes).count() > 150_000
    assert _plan_lines(large) <= _plan_lines(small) + 1
    rows = large.collect()
    assert len(rows) == 3000
    for r in rows:
        assert r.routes == (["31", "77"] if "LINE" in r.text else sorted({"16", r.text.split()[1]}))
