"""Quality rules as a bitmask ledger, with DataFrame functions alone.

Every rule is evaluated once per document; the ledger stores its measurements and one failure bit
per rule. A policy is a versioned set of bits: applying another version, or asking what a rule
alone rejects, is integer arithmetic on the ledger and never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pulseline.llm.common import WORD, making_room

#: Words in a window whose repetition counts.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # a condition on measurements


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


#: All comparisons are between integers, so every engine decides alike.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "shouting", "100 * n_shouted > 25 * n_words"),
    Rule(4, "long_words", "word_chars > 25 * n_words"),
    Rule(5, "repeated_lines", "n_dup_lines > 3 AND 100 * n_dup_lines > 60 * n_lines"),
)
POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeated_windows")),
        Policy("v1", ("few_words", "repeated_windows", "symbols", "shouting")),
        Policy("v2", ("few_words", "repeated_windows", "symbols", "shouting", "long_words", "repeated_lines")),
    )
}
DEFAULT_POLICY = "v2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted")

#: Words in windows that occur twice or more: sort the windows' hashes with their places, keep the
#: places with an equal neighbour, and add up how far each kept window reaches before the next one.
#: A text whose window hashes are all different needs no sort.
REPEATS = f"""
CASE WHEN size(array_distinct(_hashes)) = size(_hashes) THEN 0L ELSE
  transform(array(sort_array(transform(_hashes, (h, i) -> struct(h AS h, i AS i)))), s ->
    transform(array(sort_array(transform(
      filter(s, (e, k) -> e.h <=> get(s, k - 1).h OR e.h <=> get(s, k + 1).h), e -> e.i))), p ->
        aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0L,
          (a, x) -> a + x))[0])[0]
END"""


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of each whole text (null or empty: all 0) as long columns.

    Columns of the input that are already called like a measurement, or like one of the
    intermediate columns (`_text`, `_words`, `_lines`, `_hashes`), are replaced. Rows are
    independent, so repeated rows give repeated rows.
    """
    given = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    docs = making_room(docs, *MEASURES, "_text", "_words", "_lines", "_hashes")
    word = WORD.replace("\\", "\\\\")
    cut = (
        making_room(given, *MEASURES, "_words", "_lines", "_hashes")
        .withColumn("_words", F.expr(f"regexp_extract_all(_text, '{word}', 0)"))
        .withColumn("_lines", F.expr(f"filter(split(_text, '\\n'), x -> x RLIKE '{word}')"))
    )
    hashed = cut.withColumn("_hashes", F.expr(
        f"transform(slice(_words, 1, greatest(size(_words) - {WINDOW - 1}, 0)),"
        f" (w, i) -> xxhash64(slice(_words, i + 1, {WINDOW})))"
    ))
    taken = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.expr("CAST(char_length(concat_ws('', _words)) AS BIGINT)").alias("word_chars"),
        F.expr("CAST(regexp_count(_text, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr(REPEATS).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.expr("CAST((char_length(_text) - char_length(replace(_text, '!!', ''))) DIV 2 AS BIGINT)").alias("n_shouted"),
    )
    # One row each, but through a generator: a later filter on a measurement is then never pushed
    # below it, where each mention would split the text again.
    return hashed.select(*(f"`{c}`" for c in docs.columns), F.explode(F.array(taken)).alias("_taken")).select(
        *(f"`{c}`" for c in docs.columns), "_taken.*"
    )


def mask(policy: str | Policy) -> int:
    chosen = POLICIES[policy] if isinstance(policy, str) else policy
    by_name = {rule.name: rule.bit for rule in RULES}
    return sum(1 << by_name[name] for name in chosen.rules)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with its measurements and `failed_bits`, one bit for each failed rule."""
    measured = making_room(measure(docs, text), "failed_bits")
    bits = " | ".join(f"(CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END)" for r in RULES)
    return measured.withColumn("failed_bits", F.expr(bits).cast("int"))


def passes(policy: str | Policy = DEFAULT_POLICY) -> Column:
    """Whether a row of a ledger fails no rule of a policy."""
    return F.col("failed_bits").bitwiseAND(mask(policy)) == 0


def ablation(book: DataFrame, policy: str | Policy = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy
    keeps with the rule taken out. One aggregate over at most one row per distinct bit pattern."""
    chosen = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(chosen)
    patterns = book.groupBy("failed_bits").agg(F.count("*").alias("docs"))
    by_name = {rule.name: rule.bit for rule in RULES}
    rules = F.explode(F.array(*(
        F.struct(F.lit(n).alias("rule"), F.lit(1 << by_name[n]).alias("bit")) for n in chosen.rules
    )))
    each = patterns.select("failed_bits", "docs", rules.alias("r")).select("failed_bits", "docs", "r.*")
    failed = F.col("failed_bits").bitwiseAND(whole)
    total = lambda condition: F.sum(F.when(condition, F.col("docs")).otherwise(0))
    return each.groupBy("rule").agg(
        total(failed.bitwiseAND(F.col("bit")) != 0).alias("failing"),
        total(failed == F.col("bit")).alias("failing_alone"),
        total(failed.bitwiseAND(F.lit(whole) - F.col("bit")) == 0).alias("kept_without"),
    )
