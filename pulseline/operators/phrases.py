"""Dictionary matching by data: phrases of a catalog table found in texts, and a longest-first cover.

A text is cut into letter runs, digit runs, runs of white space and single other characters. Every
slice of as many parts as some phrase has is looked up in the catalog by one equality join, so the
plan is the same for ten phrases and for a hundred thousand. Equal texts are looked up once.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: kind, phrase (lower case), key, rank (smaller is preferred), whether only letters next to it
#: forbid a match (else digits do too), whether white space must be as in the phrase.
CATALOG = "kind string, phrase string, key string, rank int, letters_only boolean, exact boolean"
PARTS = r"[a-z]+|[0-9]+|\s+|[^a-z0-9\s]"
#: White space of the patterns above.
_BLANK = r"^[ \t\n\u000B\f\r]"
FOUND = "array<struct<start: int, size: int, chars: int, kind: string, phrase: string, key: string, rank: int>>"


def catalog_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small catalog from literal rows, as a table whose size the optimiser knows."""
    names = [c.split()[0] for c in CATALOG.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.sql("SELECT inline(from_json(:rows, :kind))", args={"rows": text, "kind": f"array<struct<{CATALOG.replace(' ', ': ').replace(',:', ',')}>>"})


UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?i)({PARTS})"), 1)


def _flat(items: str) -> str:
    """SQL for a list of parts with every run of white space as one space."""
    return f"transform({items}, x -> IF(x RLIKE '{_BLANK}', ' ', x))".replace("\\", "\\\\")


def matches(texts: DataFrame, catalog: DataFrame, text: str = "text") -> DataFrame:
    """_digest (md5 of the text) and found (all places of all phrases) of each distinct text that
    holds a phrase. A match starts and ends where no letter (or digit) continues it. Only the letters
    A to Z are folded.

    Catalog rows without a phrase match nothing; a null text holds nothing. Texts with the same
    md5 are taken as equal.
    """
    book = catalog.filter("phrase IS NOT NULL AND phrase != ''").withColumn("_parts", parts(F.col("phrase")))
    book = book.withColumn("_size", F.size("_parts"))
    sizes = book.agg(F.array_sort(F.collect_set("_size")).alias("sizes")).scalar()
    own = texts.filter(F.col(text).isNotNull()).select(F.md5(F.col(text)).alias("_digest"), F.col(text).alias("_text"))
    cut = own.groupBy("_digest").agg(F.min("_text").alias("_text")).select("_digest", parts(F.translate("_text", UPPER, LOWER)).alias("_raw")).filter("size(_raw) > 0")
    cut = cut.withColumn("_flat", F.expr(_flat("_raw"))).withColumn("_sizes", sizes)
    places = cut.select("_digest", F.explode(F.expr("""
        flatten(transform(sequence(1, size(_raw)), i -> transform(filter(_sizes, n -> i + n - 1 <= size(_raw)), n -> struct(
          i AS start, n AS size, array_join(slice(_flat, i, n), '') AS gram, slice(_flat, i, n) != slice(_raw, i, n) AS changed,
          get(_raw, i - 2) AS before, get(_raw, i + n - 1) AS after))))""")).alias("g")).select("_digest", "g.*")
    hits = places.join(book, (F.col("gram") == F.col("phrase")) & (F.col("size") == F.col("_size")))
    edge = "(NOT coalesce({0} RLIKE '^[a-z]', false) AND (letters_only OR NOT coalesce({0} RLIKE '^[0-9]', false)))"
    hits = hits.filter(F.expr(f"{edge.format('before')} AND {edge.format('after')} AND NOT (exact AND changed)"))
    one = F.struct("start", "size", F.char_length("phrase").alias("chars"), "kind", "phrase", "key", "rank")
    return hits.groupBy("_digest").agg(F.array_sort(F.collect_list(one)).alias("found"))


def with_matches(texts: DataFrame, catalog: DataFrame, text: str = "text", into: str = "found") -> DataFrame:
    """Add all matches of each text, in the order of places; an empty list without any."""
    table = matches(texts, catalog, text).withColumnRenamed("found", into)
    # texts without a match keep their row; null texts are spread by a stand-in that matches none
    key = F.coalesce(F.md5(F.col(text)), F.concat(F.lit("null "), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string")))
    keyed = texts.drop(into).withColumn("_digest", key)
    return keyed.join(table, "_digest", "left").withColumn(into, F.coalesce(into, F.expr(f"CAST(array() AS {FOUND})"))).drop("_digest")


def cover(found: str, kind: str) -> Column:
    """The matches of a kind that stand when the longest phrase takes its place first (ties: the
    alphabet, then the leftmost) and no place is taken twice; sorted by place."""
    order = f"""transform(array_sort(transform(filter({found}, m -> m.kind = '{kind}'),
        m -> struct(-m.chars AS n, m.phrase AS phrase, m.start AS start, m AS m))), s -> s.m)"""
    return F.expr(f"""array_sort(aggregate({order}, CAST(array() AS {FOUND}), (taken, m) ->
        IF(exists(taken, t -> t.start < m.start + m.size AND m.start < t.start + t.size), taken, array_append(taken, m))))""")


def without(pieces: str, taken: str, mark: str) -> Column:
    """The text, given as its parts, with every taken place replaced by a mark."""
    return F.expr(f"""array_join(transform({pieces}, (x, i) -> CASE
        WHEN exists({taken}, t -> t.start = i + 1) THEN '{mark}'
        WHEN exists({taken}, t -> t.start <= i AND i + 1 < t.start + t.size) THEN '' ELSE x END), '')""")


def first_of(found: str, kind: str) -> Column:
    """phrase and key of the match of a kind with the smallest rank; null without one."""
    return F.expr(f"array_min(transform(filter({found}, m -> m.kind = '{kind}'), m -> struct(m.rank AS rank, m.phrase AS phrase, m.key AS key)))")
