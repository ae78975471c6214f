"""Question tagging, gating, grading and evaluation queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pulseline.functions import vocabulary as V
from pulseline.operators import phrases as ph
from pulseline.operators import questions as qs
from pulseline.plans.domain import Domain
from pulseline.plans.registry import cte, query, r


def _has(q: str, phrase: str, word: str = "a-z") -> str:
    """SQL test for a bounded phrase in an engine without look-around."""
    pattern = f"(^|[^{word}]){re.escape(phrase)}($|[^{word}])".replace("'", "''")
    return f"regexp_matches({q}, '{pattern}')"


def _lit(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


def _map(col: str, pairs) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in pairs) + " END"


def _m(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern}')"


_CODES = "(" + ", ".join(_lit(c) for c, _, _ in V.ROUTES) + ")"
_CANON = "CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 3, '0') ELSE upper(x) END"

cte("c_q", r"SELECT *, lower(trim(text)) AS l, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS q FROM c_questions")
# Every character other than a letter or digit is doubled, so that neighbouring phrases do not share
# one; then phrases are replaced, longest first, by one letter for each route.
_LETTER = {code: chr(0xE000 + i) for i, (code, _, _) in enumerate(V.ROUTES)}


def _marked(text: str) -> str:
    out = f"regexp_replace({text}, '([^A-Za-z0-9])', '\\1\\1', 'g')"
    for phrase, code in V.route_phrases():
        twice = "".join(c if c.isalnum() else 2 * re.escape(c) for c in phrase)
        out = f"regexp_replace({out}, '(?i)(^|[^a-z0-9]){twice}($|[^a-z0-9])', '\\1{_LETTER[code]}\\2', 'g')"
    return out


_NAMED = f"list_transform(regexp_extract_all(marked, '[{chr(0xE000)}-{chr(0xE0FF)}]'), lambda x: [{', '.join(_lit(c) for c in _LETTER)}][unicode(x) - 57343])"
cte("c_q_routes", rf"""
SELECT question_id, text,
  list_sort(list_distinct(list_filter(list_concat(list_transform(codes, lambda x: {_CANON}), {_NAMED}), lambda y: y IN {_CODES}))) AS routes,
  list_sort(list_distinct(list_concat(
    list_filter(codes, lambda x: ({_CANON}) NOT IN {_CODES} AND regexp_matches(x, '^[A-Za-z]')),
    list_filter(cued, lambda x: ({_CANON}) NOT IN {_CODES})))) AS unresolved
FROM (SELECT *, regexp_extract_all(marked, '(?i)\b([a-z]?\d{{1,3}})\b', 1) AS codes,
        regexp_extract_all(text, '(?i)\b(?:route|bus|line|the)\s+([a-z]?\d{{1,3}}[a-z]?)\b', 1) AS cued
      FROM (SELECT question_id, text, {_marked("text")} AS marked FROM c_questions))""")

_TIME_CASE = "CASE " + " ".join(f"WHEN {_has('q', a)} THEN {_lit(a)}" for a, _ in V.time_aliases()) + " END"
_WINDOW = _map("time_alias", V.time_aliases())
_AM, _PM = _m("q", r"\b(morning|am)\b"), _m("q", r"\b(evening|afternoon|pm)\b")
cte("c_q_time", f"""
SELECT question_id, time_alias,
  CASE WHEN time_alias = 'rush hour' AND {_AM} THEN 'AM Peak' ELSE {_WINDOW} END AS time_window,
  CASE WHEN time_alias IS NULL THEN 'none' WHEN time_alias = 'rush hour' AND ({_AM} OR {_PM}) THEN 'high'
       WHEN time_alias = 'rush hour' THEN 'low' WHEN time_alias = lower({_WINDOW}) THEN 'exact' ELSE 'high' END AS time_confidence
FROM (SELECT question_id, q, {_TIME_CASE} AS time_alias FROM c_q)""")

_PHRASE_CASE = "CASE " + " ".join(f"WHEN {_has('q', p)} THEN {_lit(p)}" for p, _ in V.metric_phrases()) + " END"
_WORDS = "|".join(sorted(V.QUALITY_GOOD + V.QUALITY_BAD + V.MAGNITUDE_HIGH + V.MAGNITUDE_LOW))


def _tuple(words) -> str:
    return "(" + ", ".join(_lit(w) for w in words) + ")"


_SORT = f"""CASE WHEN w = '' THEN NULL WHEN w IN {_tuple(V.MAGNITUDE_HIGH)} THEN 'DESC' WHEN w IN {_tuple(V.MAGNITUDE_LOW)} THEN 'ASC'
  WHEN metric_direction = 'higher_is_better' THEN CASE WHEN w IN {_tuple(V.QUALITY_BAD)} THEN 'ASC' ELSE 'DESC' END
  WHEN metric_direction = 'lower_is_better' THEN CASE WHEN w IN {_tuple(V.QUALITY_BAD)} THEN 'DESC' ELSE 'ASC' END ELSE 'DESC' END"""
cte("c_q_metric", rf"""
SELECT question_id, metric, CASE WHEN implied THEN 'implicit:performance+peak' ELSE p END AS metric_phrase,
  metric_table, metric_column, metric_direction, metric_in_scope,
  CASE WHEN metric IS NULL THEN NULL WHEN implied THEN coalesce({_SORT}, 'DESC') ELSE {_SORT} END AS metric_sort,
  CASE WHEN metric IS NULL THEN 'none' WHEN implied THEN 'high' WHEN contains(p, ' ') OR length(p) >= 10 THEN 'exact' ELSE 'high' END
    AS metric_confidence
FROM (SELECT *, {_map('metric', [(m[0], m[2]) for m in V.METRICS])} AS metric_table,
        {_map('metric', [(m[0], m[3]) for m in V.METRICS])} AS metric_column,
        {_map('metric', [(m[0], m[4]) for m in V.METRICS])} AS metric_direction,
        {_map('metric', [(m[0], m[5]) for m in V.METRICS])} AS metric_in_scope
      FROM (SELECT *, CASE WHEN implied THEN 'bunching_events_hourly' ELSE {_map('p', V.metric_phrases())} END AS metric
        FROM (SELECT *, p IS NULL AND {_m('q', V.PERFORMANCE_CUE)} AND {_m('q', V.PEAK_CUE)} AS implied,
                regexp_extract(q, '\b({_WORDS})\b', 1) AS w
              FROM (SELECT question_id, q, {_PHRASE_CASE} AS p FROM c_q))))""")

# the published pattern in two parts, for an engine without look-ahead
_ON_TIME, _DELAY = V.ON_TIME.replace(r"|delay(ed|s)?\b(?!.*bunch)", ""), r"\bdelay(ed|s)?\b"
assert "bunch" not in _ON_TIME

_GATED = " OR ".join(_has("q.l", p) for p in V.gated_phrases())
cte("c_q_refusal", rf"""
SELECT q.question_id, CASE WHEN {_m('q.l', V.RIDERSHIP)} THEN 'ridership' WHEN {_m('q.l', V.NON_BUS)} THEN 'skytrain_or_nonbus'
  WHEN {_m('q.l', V.SCHEDULE_CUE)} AND ({_m('q.l', _ON_TIME)} OR ({_m('q.l', _DELAY)}
    AND NOT contains(regexp_replace(q.l, '^.*{_DELAY}', ''), 'bunch'))) THEN 'on_time_performance'
  WHEN {_m('q.l', V.TREND)} THEN 'multi_day_trend' WHEN {_GATED} THEN 'unsupported_metric'
  WHEN len(e.unresolved) > 0 THEN 'non_top20_route' END AS refusal
FROM c_q q JOIN c_q_routes e ON q.question_id = e.question_id""")

_METRIC_COLS = ["metric", "metric_phrase", "metric_table", "metric_column", "metric_direction", "metric_in_scope",
                "metric_sort", "metric_confidence"]


@query("tag_entities", "SELECT question_id, array_to_string(routes, '|') AS routes, array_to_string(unresolved, '|') AS unresolved FROM c_q_routes")
def _(d: Domain):
    return qs.tag_entities(d.questions).select(
        "question_id", F.array_join("routes", "|").alias("routes"), F.array_join("unresolved", "|").alias("unresolved"))


@query("phrase_matches", r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, row_number() OVER () AS r, lower(text) AS l FROM conversations
), book AS (
  SELECT DISTINCT p AS phrase FROM (SELECT regexp_extract(l, '^([a-z]+ [a-z]+)[ ,.]', 1) AS p FROM t) WHERE p <> ''
), pieces AS (
  SELECT r, regexp_extract_all(l, '[a-z]+|[0-9]+|\s+|[^a-z0-9\s]') AS p FROM t
), grams AS (
  SELECT r, i, p[i] || ' ' || p[i + 2] AS gram FROM (SELECT r, p, unnest(range(1, len(p) - 1)) AS i FROM pieces)
  WHERE regexp_matches(p[i], '^[a-z]') AND regexp_matches(p[i + 1], '^\s') AND regexp_matches(p[i + 2], '^[a-z]')
    AND NOT coalesce(regexp_matches(p[i - 1], '^[0-9]') AND i > 1, false) AND NOT coalesce(regexp_matches(p[i + 3], '^[0-9]'), false)
), hits AS (
  SELECT r, count(*) AS n, list_sort(list_distinct(list(gram))) AS found FROM grams JOIN book ON gram = phrase GROUP BY r
)
SELECT conv_id, turn, coalesce(n, 0) AS matches, coalesce(array_to_string(found, '|'), '') AS phrases FROM t LEFT JOIN hits USING (r)""")
def _(d: Domain):
    turns = d.tables.base("conversations")
    low = F.translate("text", ph.UPPER, ph.LOWER)
    book = turns.select(F.regexp_extract(low, "^([a-z]+ [a-z]+)[ ,.]", 1).alias("phrase")).filter("phrase != ''").distinct().selectExpr(
        "'opening' AS kind", "phrase", "phrase AS key", "0 AS rank", "false AS letters_only", "false AS exact")
    found = ph.with_matches(turns.select("conv_id", "turn", "text"), book)
    return found.select(
        "conv_id", "turn", F.size("found").cast("long").alias("matches"),
        F.expr("array_join(array_sort(array_distinct(transform(found, m -> m.phrase))), '|')").alias("phrases"))


@query("tag_time_window", "SELECT * FROM c_q_time")
def _(d: Domain):
    return qs.tag_time_window(d.questions).drop("text")


@query("tag_metric", "SELECT * FROM c_q_metric")
def _(d: Domain):
    return qs.tag_metric(d.questions).select("question_id", *_METRIC_COLS)


@query("superlative_sort", "SELECT question_id, metric_sort FROM c_q_metric")
def _(d: Domain):
    return qs.tag_metric(d.questions).select("question_id", "metric_sort")


@query("classify_out_of_scope", "SELECT * FROM c_q_refusal")
def _(d: Domain):
    return qs.classify_out_of_scope(qs.tag_entities(d.questions)).select("question_id", "refusal")


@query("route_question", """
SELECT q.question_id, CASE WHEN q.l = '' THEN 'low_confidence' WHEN f.refusal IS NOT NULL THEN 'refused'
  WHEN len(e.routes) = 0 AND m.metric IS NULL THEN 'low_confidence' WHEN NOT coalesce(m.metric_in_scope, true) THEN 'refused'
  WHEN t.time_confidence = 'low' THEN 'ambiguous_time' ELSE 'ok' END AS status
FROM c_q q JOIN c_q_routes e USING (question_id) JOIN c_q_time t USING (question_id) JOIN c_q_metric m USING (question_id)
JOIN c_q_refusal f USING (question_id)""")
def _(d: Domain):
    return qs.route_question(d.questions).select("question_id", "status")


# --- grading on answers derived from the order table ---------------------------------------------------

cte("c_runs", """
SELECT o_orderkey AS run_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'refusal' WHEN 1 THEN 'refusal_or_answer' ELSE 'single_value' END AS shape,
  CASE o_custkey % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'empty_result' WHEN 2 THEN 'low_confidence' ELSE 'success' END AS status,
  concat('R', o_custkey % 30, ' scored ', o_custkey % 100, '.', o_orderkey % 10, ' on 41st Avenue with 1,', 100 + o_orderkey % 900, ' events.') AS expected_answer,
  CASE o_orderkey % 4 WHEN 0 THEN concat('R', o_custkey % 30, ' scored ', o_custkey % 100, '.', o_orderkey % 10, ' that day')
    WHEN 1 THEN concat('Route R', o_custkey % 30, ' did well.') WHEN 2 THEN 'No value was found.'
    ELSE concat('There were 1,', 100 + o_orderkey % 900, ' events!') END AS answer_text
FROM orders""")
cte("c_anchored", r"""
SELECT *, list_sort(list_distinct(list_filter(list_transform(
    list_filter(regexp_extract_all(expected_answer, '\d[\d,.]*[A-Za-z]?'), lambda x: NOT regexp_matches(x, '[A-Za-z]$')),
    lambda x: rtrim(replace(regexp_extract(x, '^\d[\d,]*\.?\d*'), ',', ''), '.')), lambda x: length(x) >= 2 OR contains(x, '.')))) AS nums,
  list_sort(list_distinct(regexp_extract_all(expected_answer, '\b(R\d+|0\d{2}|\d{3})\b', 1))) AS toks,
  rtrim(replace(coalesce(answer_text, ''), ',', ''), '.') AS hay
FROM c_runs""")
cte("c_graded", """
SELECT run_id, shape, status, expected_answer, answer_text, failure_reason, failure_reason = '' AS passed FROM (
  SELECT *, CASE WHEN shape = 'refusal' THEN CASE WHEN status = 'refused' THEN '' ELSE 'expected refusal, got ' || status END
    WHEN shape = 'refusal_or_answer' THEN CASE WHEN status IN ('refused', 'success', 'empty_result') THEN ''
      ELSE 'expected refusal-or-answer, got ' || status END
    WHEN status NOT IN ('success', 'empty_result') THEN 'expected answer, got ' || status
    WHEN status = 'empty_result' THEN 'answerable question returned no rows'
    ELSE concat_ws('; ',
      CASE WHEN len(toks) > 0 AND len(list_filter(toks, lambda x: contains(answer_text, x))) = 0
        THEN 'missing route tokens [''' || array_to_string(toks, ''', ''') || ''']' END,
      CASE WHEN len(nums) > 0 AND len(list_filter(nums, lambda x: contains(hay, x))) = 0
        THEN 'missing numeric anchors [''' || array_to_string(nums, ''', ''') || ''']' END) END AS failure_reason FROM c_anchored)""")


def _runs(d: Domain):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    score, events = text(c % 100, ".", k % 10), text("1,", 100 + k % 900)
    return d.tables.base("orders").select(
        k.alias("run_id"),
        F.when(k % 7 == 0, "refusal").when(k % 7 == 1, "refusal_or_answer").otherwise("single_value").alias("shape"),
        F.when(c % 5 == 0, "refused").when(c % 5 == 1, "empty_result").when(c % 5 == 2, "low_confidence")
        .otherwise("success").alias("status"),
        text("R", c % 30, " scored ", score, " on 41st Avenue with ", events, " events.").alias("expected_answer"),
        F.when(k % 4 == 0, text("R", c % 30, " scored ", score, " that day"))
        .when(k % 4 == 1, text("Route R", c % 30, " did well.")).when(k % 4 == 2, "No value was found.")
        .otherwise(text("There were ", events, " events!")).alias("answer_text"),
    )


@query("grade_answers", "SELECT * FROM c_graded")
def _(d: Domain):
    return qs.grade_answers(_runs(d))


@query("failures_by_reason", "SELECT failure_reason AS reason, count(*) AS failures FROM c_graded WHERE NOT passed GROUP BY failure_reason")
def _(d: Domain):
    return qs.failures_by_reason(qs.grade_answers(_runs(d)))


@query("append_missing_anchors", """
SELECT run_id, CASE WHEN len(miss) = 0 THEN answer_text ELSE
  CASE WHEN regexp_matches(answer_text, '[.!?]$') THEN answer_text ELSE answer_text || '.' END
  || ' Result values: ' || array_to_string(miss, ', ') || '.' END AS final_text
FROM (SELECT run_id, answer_text, list_filter([('R' || (o_custkey % 30)), ((o_custkey % 100) || '.' || (o_orderkey % 10))],
        lambda x: NOT contains(answer_text, x)) AS miss FROM c_runs JOIN orders ON run_id = o_orderkey)""")
def _(d: Domain):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    need = d.tables.base("orders").select(k.alias("run_id"), F.array(
        F.concat(F.lit("R"), (c % 30).cast("string")),
        F.concat((c % 100).cast("string"), F.lit("."), (k % 10).cast("string"))).alias("required"))
    return qs.append_missing_anchors(_runs(d).join(need, "run_id")).select("run_id", "final_text")


@query("eval_summary", f"""
SELECT scope, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
  {r('1e2 * CAST(count(*) FILTER (passed) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 1)} AS accuracy,
  {r("CAST(sum(CAST(round(latency_ms * 100) AS BIGINT)) FILTER (latency_ms > 0) AS DOUBLE) / (1e2 * CAST(count(*) FILTER (latency_ms > 0) AS DOUBLE))", 1)} AS avg_latency_ms,
  {r('max(latency_ms) FILTER (latency_ms > 0)', 0)} AS max_latency_ms, CAST(sum(retry_count) AS BIGINT) AS retries
FROM (SELECT unnest([event_type, 'ALL']) AS scope, value < 100 AS passed, value * 10 AS latency_ms, user_id % 3 AS retry_count FROM events)
GROUP BY scope""")
def _(d: Domain):
    runs = d.tables.base("events").select(
        F.col("event_type").alias("category"), (F.col("value") < 100).alias("passed"),
        (F.col("value") * 10).alias("latency_ms"), (F.col("user_id") % 3).alias("retry_count"))
    return qs.eval_summary(runs)
