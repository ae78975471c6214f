"""Pre-aggregation of pings, so that several distinct counts never multiply raw rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

ROWS, FIRST, LAST = "__n", "__first", "__last"
#: The grain from which all activity tables can be computed.
ACTIVITY_GRAIN = ("date", "hour", "route_id", "vehicle_id", "trip_id")


def cells(df: DataFrame, by: Sequence[str], flags: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per combination of `by`: rows, first and last collection time, rows per flag.

    Spark turns several distinct counts into one copy of each input row per count. Counting over
    cells copies cells instead, and the cells are combined map-side. `df` holds raw pings, or the
    cells of a finer grain (whose flags have the same names).
    """
    fine = ROWS in df.columns
    rows = F.sum(ROWS) if fine else F.count(F.lit(1))
    seen = (FIRST, LAST) if fine else ("collection_timestamp", "collection_timestamp")
    flagged = [(F.sum(name) if fine else F.count_if(when)).alias(name) for name, when in (flags or {}).items()]
    return df.groupBy(*by).agg(rows.alias(ROWS), F.min(seen[0]).alias(FIRST), F.max(seen[1]).alias(LAST), *flagged)


def rows() -> Column:
    return F.sum(ROWS)


def rows_with(column: str) -> Column:
    """Rows whose `column` (part of the cells' grain) is not NULL, like a count of that column."""
    return F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.col(ROWS))), F.lit(0))


def seen() -> tuple[Column, Column]:
    return F.min(FIRST).alias("first_seen"), F.max(LAST).alias("last_seen")
