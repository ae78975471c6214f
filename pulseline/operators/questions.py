"""Tagging, gating and grading of a table of analyst questions.

Phrases of all dictionaries come from one catalog table and are found by one look-up (`phrases`);
everything else is a projection. A step that follows another reuses its look-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseline.functions import vocabulary as V
from pulseline.functions.columns import rnd
from pulseline.operators import phrases as ph

#: Kinds of catalog rows: route phrases, route codes as they may be written, time windows, metrics
#: and metric phrases that are out of scope.
ROUTE, CODE, TIME, METRIC, GATED = "route", "code", "time", "metric", "gated"
FOUND = "_found"
#: Stands for a route phrase in what remains of a text.
_MARK = "\ue000"


def _code_forms(code: str) -> list[str]:
    """How a question may write a code: digits with or without leading zeros, up to three."""
    if not code.isdigit():
        return [code.lower()]
    bare = code.lstrip("0") or "0"
    return [bare.zfill(n) for n in range(len(bare), 4)]


def route_rows(routes) -> list[tuple]:
    """Catalog rows of (code, long name, aliases) routes."""
    names = {long.lower(): code for code, long, _ in routes}
    for code, _, aliases in routes:
        for a in aliases:
            names.setdefault(a, code)
    rows = [(ROUTE, p, c, 0, False, True) for p, c in names.items()]
    return rows + [(CODE, f, code, 0, False, True) for code, _, _ in routes for f in _code_forms(code)]


def vocabulary_rows() -> list[tuple]:
    """Catalog rows of time windows, metrics and gated phrases, preferred longest first."""
    rows = [(TIME, a, w, i, True, False) for i, (a, w) in enumerate(V.time_aliases())]
    rows += [(METRIC, p, m, i, True, False) for i, (p, m) in enumerate(V.metric_phrases())]
    return rows + [(GATED, p, p, 0, True, True) for p in V.gated_phrases()]


def default_catalog(spark: SparkSession) -> DataFrame:
    """The published vocabulary as a catalog table."""
    return ph.catalog_of(spark, route_rows(V.ROUTES) + vocabulary_rows())


def catalog_of_routes(routes: DataFrame, code: str = "route_short_name", name: str = "route_long_name") -> DataFrame:
    """Catalog rows from a route table of any size: the long name, 'route' or 'the' with the code as
    it is spoken, and the code as it may be written. A phrase that names two routes means the
    smaller code."""
    c = F.col(code)
    bare = F.when(c.rlike("^[0-9]{1,3}$"), F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(F.lower(c))
    forms = F.expr("transform(sequence(char_length(_bare), greatest(3, char_length(_bare))), n -> lpad(_bare, n, '0'))")
    own = routes.filter(c.isNotNull()).select(c.alias("_code"), F.lower(F.trim(F.col(name))).alias("_name"), bare.alias("_bare")).distinct()
    spoken = F.array(F.col("_name"), F.concat(F.lit("route "), "_bare"), F.concat(F.lit("the "), "_bare"))
    written = F.when(F.col("_bare").rlike("^[0-9]{1,3}$"), forms).otherwise(F.array("_bare"))
    both = own.select("_code", F.explode(F.array(
        F.struct(F.lit(ROUTE).alias("kind"), spoken.alias("p")), F.struct(F.lit(CODE).alias("kind"), written.alias("p"))
    )).alias("k")).select("_code", "k.kind", F.explode("k.p").alias("phrase"))
    return both.filter("phrase != ''").groupBy("kind", "phrase").agg(F.min("_code").alias("key")).select(
        "kind", "phrase", "key", F.lit(0).alias("rank"), F.lit(False).alias("letters_only"), F.lit(True).alias("exact"))


def looked_up(questions: DataFrame, text: str = "text", catalog: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The questions with all matches of the catalog (of some kinds), unless they have them already."""
    if FOUND in questions.columns:
        return questions
    book = default_catalog(questions.sparkSession) if catalog is None else catalog
    return ph.with_matches(questions, book.filter(F.col("kind").isin(*kinds)) if kinds else book, text, FOUND)


def _tidy(tagged: DataFrame, questions: DataFrame, *names: str) -> DataFrame:
    return tagged.drop(*names, *([] if FOUND in questions.columns else [FOUND]))


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def tag_entities(questions: DataFrame, text: str = "text", catalog: DataFrame | None = None) -> DataFrame:
    """Add `routes` (catalog codes named in the text) and `unresolved` (route-shaped, unknown).

    The longest phrase takes its place first, so a shorter phrase cannot match inside it. What
    remains is searched for codes; a bare number is a route only if the catalog has it, but after
    'route', 'bus', 'line' or 'the' it is unresolved.
    """
    t = looked_up(questions, text, catalog, (ROUTE, CODE))
    source = F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, "")
    known = F.expr(f"map_from_entries(array_distinct(transform(filter({FOUND}, m -> m.kind = '{CODE}'), m -> struct(m.phrase, m.key))))")
    t = t.withColumn("__taken", ph.cover(FOUND, ROUTE)).withColumn("__cut", ph.parts(F.coalesce(F.col(text), F.lit(""))))
    t = t.withColumn("__rest", F.when(F.size("__taken") > 0, ph.without("__cut", "__taken", _MARK)).otherwise(source))
    t = t.withColumns({
        "__known": known,
        "__codes": F.regexp_extract_all("__rest", F.lit(V.ROUTE_CODE), 1),
        "__cued": F.regexp_extract_all(source, F.lit(V.ROUTE_CUE), 1),
    })
    key_of = lambda c: F.try_element_at("__known", F.lower(c))
    lost = F.concat(
        F.filter("__codes", lambda c: key_of(c).isNull() & c.rlike("(?i)^[a-z]")),
        F.filter("__cued", lambda c: key_of(c).isNull()),
    )
    named = F.transform("__taken", lambda m: m["key"])
    t = t.withColumns({
        "routes": F.array_sort(F.array_distinct(F.concat(named, F.array_compact(F.transform("__codes", key_of))))),
        "unresolved": F.array_sort(F.array_distinct(lost)),
    })
    return _tidy(t, questions, "__taken", "__cut", "__rest", "__known", "__codes", "__cued")


def tag_time_window(questions: DataFrame, text: str = "text", catalog: DataFrame | None = None) -> DataFrame:
    """Add `time_alias`, `time_window`, `time_confidence`; a bare 'rush hour' is PM at low confidence."""
    q = F.col("__q")
    t = looked_up(questions, text, catalog, (TIME,)).withColumn("__q", _normal(F.col(text))).withColumn("__w", ph.first_of(FOUND, TIME))
    alias, mapped = F.col("__w.phrase"), F.col("__w.key")
    rush = alias == "rush hour"
    am, pm = q.rlike(r"\b(morning|am)\b"), q.rlike(r"\b(evening|afternoon|pm)\b")
    t = t.withColumns({
        "time_alias": alias,
        "time_window": F.when(rush & am, "AM Peak").otherwise(mapped),
        "time_confidence": F.when(alias.isNull(), "none").when(rush & (am | pm), "high").when(rush, "low")
        .when(alias == F.lower(mapped), "exact").otherwise("high"),
    })
    return _tidy(t, questions, "__q", "__w")


def superlative(q: Column) -> Column:
    words = sorted(V.QUALITY_GOOD + V.QUALITY_BAD + V.MAGNITUDE_HIGH + V.MAGNITUDE_LOW)
    return F.nullif(F.regexp_extract(q, r"\b(" + "|".join(words) + r")\b", 1), F.lit(""))


def superlative_sort(word: Column, direction: Column) -> Column:
    """Sort order: magnitude words are literal, quality words follow the metric's polarity."""
    bad = word.isin(*V.QUALITY_BAD)
    return (
        F.when(word.isNull(), F.lit(None).cast("string"))
        .when(word.isin(*V.MAGNITUDE_HIGH), "DESC").when(word.isin(*V.MAGNITUDE_LOW), "ASC")
        .when(direction == "higher_is_better", F.when(bad, "ASC").otherwise("DESC"))
        .when(direction == "lower_is_better", F.when(bad, "DESC").otherwise("ASC"))
        .otherwise("DESC")
    )


def tag_metric(questions: DataFrame, text: str = "text", catalog: DataFrame | None = None) -> DataFrame:
    """Add metric name, phrase, direction, scope, sort and confidence; the longest phrase wins."""
    q = F.col("__q")
    t = looked_up(questions, text, catalog, (METRIC,)).withColumn("__q", _normal(F.col(text))).withColumn("__m", ph.first_of(FOUND, METRIC))
    t = t.withColumn("metric_phrase", F.col("__m.phrase"))
    phrase = F.col("metric_phrase")
    implied = phrase.isNull() & q.rlike(V.PERFORMANCE_CUE) & q.rlike(V.PEAK_CUE)
    t = t.withColumn("metric", F.when(implied, "bunching_events_hourly").otherwise(F.col("__m.key")))
    metric = F.col("metric")

    def field(i: int) -> Column:
        return F.create_map(*[x for m in V.METRICS for x in (F.lit(m[0]), F.lit(m[i]))])[metric]

    t = t.withColumns({"metric_table": field(2), "metric_column": field(3), "metric_direction": field(4),
                       "metric_in_scope": field(5)})
    order = superlative_sort(superlative(q), F.col("metric_direction"))
    t = t.withColumns({
        "metric_sort": F.when(metric.isNull(), F.lit(None)).when(implied, F.coalesce(order, F.lit("DESC"))).otherwise(order),
        "metric_confidence": F.when(metric.isNull(), "none").when(implied, "high")
        .when(phrase.contains(" ") | (F.length(phrase) >= 10), "exact").otherwise("high"),
        "metric_phrase": F.when(implied, "implicit:performance+peak").otherwise(phrase),
    })
    return _tidy(t, questions, "__q", "__m")


def classify_out_of_scope(questions: DataFrame, text: str = "text", catalog: DataFrame | None = None) -> DataFrame:
    """Add `refusal`: the first rule that fires, NULL for questions that may proceed.

    Expects `unresolved` from `tag_entities`.
    """
    tagged = looked_up(questions, text, catalog, (GATED,))
    q = F.lower(F.trim(F.col(text)))
    on_time = q.rlike(V.ON_TIME)
    gated = F.expr(f"exists({FOUND}, m -> m.kind = '{GATED}')")
    tagged = tagged.withColumn(
        "refusal",
        F.when(q.rlike(V.RIDERSHIP), "ridership").when(q.rlike(V.NON_BUS), "skytrain_or_nonbus")
        .when(q.rlike(V.SCHEDULE_CUE) & on_time, "on_time_performance").when(q.rlike(V.TREND), "multi_day_trend")
        .when(gated, "unsupported_metric").when(F.size("unresolved") > 0, "non_top20_route"),
    )
    return _tidy(tagged, questions)


def route_question(questions: DataFrame, text: str = "text", catalog: DataFrame | None = None) -> DataFrame:
    """All tags plus `status`: refused, low_confidence, ambiguous_time or ok (fails closed). All
    steps share one look-up."""
    t = looked_up(questions, text, catalog)
    for step in (tag_entities, tag_time_window, tag_metric, classify_out_of_scope):
        t = step(t, text)
    no_metric = F.col("metric").isNull()
    t = t.drop(FOUND)
    return t.withColumn(
        "status",
        F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "low_confidence")
        .when(F.col("refusal").isNotNull(), "refused")
        .when((F.size("routes") == 0) & no_metric, "low_confidence")
        .when(~F.coalesce("metric_in_scope", F.lit(True)), "refused")
        .when(F.col("time_confidence") == "low", "ambiguous_time")
        .otherwise("ok"),
    )


def _clean_number(c: Column) -> Column:
    return F.rtrim(F.replace(c, F.lit(","), F.lit("")), F.lit("."))


def expected_anchors(text: Column) -> tuple[Column, Column]:
    """Numbers (two characters or a decimal, no ordinals) and route tokens of an expected answer."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(V.NUMBER_ANCHOR), 1), _clean_number)
    numbers = F.filter(numbers, lambda n: (F.length(n) >= 2) | n.contains("."))
    tokens = F.regexp_extract_all(text, F.lit(V.ROUTE_ANCHOR), 1)
    return F.array_sort(F.array_distinct(numbers)), F.array_sort(F.array_distinct(tokens))


def grade_answers(runs: DataFrame) -> DataFrame:
    """Add `passed` and `failure_reason` to (shape, status, expected_answer, answer_text) rows.

    An answer fails on anchors only when all numbers, or all route tokens, are missing.
    """
    answered = F.col("status").isin("success", "empty_result")
    refused = F.col("status") == "refused"
    answer = F.coalesce("answer_text", F.lit(""))
    numbers, tokens = expected_anchors(F.coalesce("expected_answer", F.lit("")))
    t = runs.withColumns({"__n": numbers, "__t": tokens, "__hay": _clean_number(answer)})
    no_number = (F.size("__n") > 0) & ~F.exists("__n", lambda n: F.col("__hay").contains(n))
    no_token = (F.size("__t") > 0) & ~F.exists("__t", lambda x: answer.contains(x))

    def listed(c: str) -> Column:
        return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))

    anchors = F.concat_ws(
        "; ",
        F.when(no_token, F.concat(F.lit("missing route tokens "), listed("__t"))),
        F.when(no_number, F.concat(F.lit("missing numeric anchors "), listed("__n"))),
    )
    shape = F.col("shape")
    reason = (
        F.when(shape == "refusal", F.when(refused, "").otherwise(F.concat(F.lit("expected refusal, got "), "status")))
        .when(shape == "refusal_or_answer",
              F.when(refused | answered, "").otherwise(F.concat(F.lit("expected refusal-or-answer, got "), "status")))
        .when(~answered, F.concat(F.lit("expected answer, got "), "status"))
        .when(F.col("status") == "empty_result", "answerable question returned no rows")
        .otherwise(anchors)
    )
    return t.withColumn("failure_reason", reason).withColumn("passed", F.col("failure_reason") == "").drop("__n", "__t", "__hay")


def append_missing_anchors(answers: DataFrame, text: str = "answer_text", required: str = "required") -> DataFrame:
    """Append the required values that the text does not contain, as one closing sentence."""
    body = F.coalesce(F.col(text), F.lit(""))
    missing = F.filter(F.array_distinct(required), lambda x: ~body.contains(x))
    suffix = F.concat(F.lit("Result values: "), F.array_join(missing, ", "), F.lit("."))
    trimmed = F.rtrim(body)
    closed = F.when(trimmed.rlike(r"[.!?]$"), body).otherwise(F.concat(trimmed, F.lit(".")))
    out = F.when(F.size(missing) == 0, body).when(body == "", suffix).otherwise(F.trim(F.concat(closed, F.lit(" "), suffix)))
    return answers.withColumn("final_text", out)


def eval_summary(runs: DataFrame) -> DataFrame:
    """Accuracy, latency and retries, overall and by category, as one grouped pass.

    Latency statistics ignore rows without a positive latency.
    """
    ms = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    total, good = F.sum("n"), F.sum("good")
    per = runs.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("good"),
        F.sum(F.round(ms * 100).cast("bigint")).alias("ms"), F.count(ms).alias("ms_n"), F.max(ms).alias("ms_max"),
        F.sum("retry_count").alias("retries"),
    )
    both = per.withColumn("scope", F.explode(F.array(F.col("category"), F.lit("ALL"))))
    return both.groupBy("scope").agg(
        total.alias("total"), good.alias("passed"), (total - good).alias("failed"),
        rnd(F.lit(100.0) * good.cast("double") / total.cast("double"), 1).alias("accuracy"),
        rnd(F.sum("ms").cast("double") / (F.lit(100.0) * F.nullif(F.sum("ms_n"), F.lit(0)).cast("double")), 1).alias("avg_latency_ms"),
        rnd(F.max("ms_max"), 0).alias("max_latency_ms"),
        F.sum("retries").alias("retries"),
    )


def failures_by_reason(graded: DataFrame) -> DataFrame:
    reason = F.when(F.col("failure_reason") == "", "(unspecified)").otherwise(F.col("failure_reason"))
    return graded.where(~F.col("passed")).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("failures"))
