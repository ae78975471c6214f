"""How filters interact: which documents each one removes, in every order of application.

Rules that look at one text are bits computed in one scan. The rule "a smaller id has the same text"
is an existential self-join: a left-semi join on the text's hash, the exact text and a smaller id.
The ids it marks are united with those that fail other rules, and the bits of each row are combined.
Every figure for every order then follows from one count for each pattern of bits.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from pulseline.llm.common import stored

#: What fails a filter, over `n` words of which `d` are distinct and over the text `t`.
TEXT_RULES = {
    "A": "n < 200",
    "B": "100 * d < 50 * n",
    "C": "100 * regexp_count(t, '[A-Z]') > 3 * char_length(t)",
    "D": "t RLIKE '[#$%&*|]'",
}
COPY_RULE = "E"
FILTERS = (*TEXT_RULES, COPY_RULE)

_BLANKS = r"[ \t\n\u000B\u000C\r]+"
#: The word list is bound once by the outer lambda, so that a text is split once.
_BITS = f"""
transform(array(array_remove(split(_text, '{_BLANKS}'), '')), w ->
  transform(array(struct(size(w) AS n, size(array_distinct(w)) AS d, _text AS t)), x -> %s)[0])[0]"""


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_bits() -> Column:
    """The failed text rules of the column `_text`, one bit each."""
    names = {"n": "x.n", "d": "x.d", "t": "x.t"}
    cases = []
    for name, rule in TEXT_RULES.items():
        bound = " ".join(names.get(word, word) for word in rule.replace("(t,", "( t ,").replace("(t)", "( t )").split())
        cases.append(f"(CASE WHEN {bound} THEN {_bit(name)} ELSE 0 END)")
    return F.expr(_BITS % " | ".join(cases))


def _rows(docs: DataFrame, text: str, key: str, part: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.xxhash64(whole).alias("hash"), whole.alias("_text"),
    )


def later_copies(docs: DataFrame, facts: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """id, part and hash of each row whose whole text a row with a smaller id also has.

    Only texts whose hash belongs to two ids stay after the first join. The smallest id of each text
    then stands for all smaller ones, so a row meets one partner however large its group is, and
    adaptive execution may split the rows of a hot text. Rows without an id are neither marked nor
    partners.
    """
    named = facts.filter("id IS NOT NULL")
    shared = named.groupBy("hash").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    rows = _rows(docs, text, key, part).filter("id IS NOT NULL")
    rows = stored(rows.join(stored(shared.select("hash"), "audit-shared"), "hash", "left_semi"), "audit-copies")
    first = stored(rows.groupBy("hash", "_text").agg(F.min("id").alias("first")), "audit-first")
    first = first.select(F.col("hash").alias("h"), F.col("_text").alias("t"), "first")
    later = rows.join(first, F.expr("hash = h AND _text = t AND first < id"), "left_semi")
    return later.select("id", "part", "hash")


def patterns(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang",
    good: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """part, failed (bits in the order of FILTERS), and how many documents, good and toxic ones have
    exactly these failures: at most 32 rows for each part.

    A null text is empty, a null part the empty string. Every row counts, repeated ones too; rows
    that agree in id, part and the text's hash share their bits. Several labels of one id: any 1
    decides. Rows without an id or without labels are neither good nor toxic. Other columns of both
    inputs are ignored.
    """
    rows = _rows(docs, text, key, part)
    facts = stored(rows.select("id", "part", "hash", text_bits().alias("bits")), "audit-facts")
    copies = later_copies(docs, facts, text, key, part)
    marked = facts.withColumn("docs", F.lit(1)).unionByName(
        copies.select("id", "part", "hash", F.lit(_bit(COPY_RULE)).alias("bits"), F.lit(0).alias("docs"))
    )
    failed = marked.groupBy("id", "part", "hash").agg(F.bit_or("bits").alias("failed"), F.sum("docs").alias("docs"))
    # rows without an id get their hash as a stand-in, so that they spread and match no label
    keyed = failed.select(
        "part", "failed", "docs", F.col("id").isNull().alias("_bare"),
        F.coalesce(F.col("id").cast("string"), F.col("hash").cast("string")).alias("_key"),
    )
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_key"), F.lit(False).alias("_bare")).agg(
        F.max((F.coalesce(F.col(good), F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce(F.col(toxic), F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    joined = keyed.join(known, ["_key", "_bare"], "left")
    return joined.groupBy("part", "failed").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.col("docs") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("docs") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def steps(filters: tuple[str, ...] = FILTERS) -> list[tuple[str, int, int, int]]:
    """Every order and step: the order's name, the step, the filter's bit and the bits before it."""
    return [
        ("".join(order), k + 1, 1 << filters.index(name), sum(1 << filters.index(x) for x in order[:k]))
        for order in permutations(filters) for k, name in enumerate(order)
    ]


def audit(found: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: documents kept after it, removed by it, failing
    it but removed earlier, failing it alone, good and toxic ones removed by it, and its removals
    summed over all orders. Zeros are rows too. Work grows with the patterns, not the documents.
    """
    book = steps(filters)
    orders = len(book) // len(filters)
    names = ("filter_order", "step", "bit", "before")
    text = json.dumps([dict(zip(names, row, strict=True)) for row in book])
    each = F.explode(F.from_json(F.lit(text), "array<struct<filter_order: string, step: int, bit: int, before: int>>"))
    rows = found.select("*", each.alias("s")).select("part", "failed", "docs", "good", "toxic", "s.*")
    failed, bit, before = F.col("failed"), F.col("bit"), F.col("before")
    fails, reached = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(before) == 0

    def total(condition: Column, of: str | Column = "docs") -> Column:
        return F.sum(F.when(condition, of if isinstance(of, Column) else F.col(of)).otherwise(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(failed == bit).alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
        # of the filters that a document fails, each comes first in the same share of all orders
        total(fails, F.expr(f"docs * {orders} DIV greatest(bit_count(failed), 1)")).alias("shapley"),
    )
