"""Ordered-neighbour operations whose window partitions stay bounded under any skew.

A plain `lead(...).over(partitionBy(group).orderBy(...))` sorts each group in one task, so a
group holding a third of all rows becomes a third of all work in one task. These helpers cut
a group into ordered pieces by a pure function of the row, solve each piece on its own, and
stitch the pieces with a summary that has one row per piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseline.functions.joins import null_safe_join
from pulseline.session import stored


def in_ranges(df: DataFrame, columns: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by the columns, with `__piece`, the number of their range.

    Spark draws the bounds from a sample of whole (key, order, tie) tuples, so a group with a third
    of all rows gets a third of the ranges, whatever its order values and ids look like. There are
    `tasks` ranges. The result is stored: a row's range is drawn once.
    """
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    return stored(placed.withColumn("__piece", F.spark_partition_id()), "ranges")


def ranked_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    carry: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Add `rank` and `next_<c>` (also `next_<order>`) within keys, ordered by (order, tie).

    Pieces are (keys, range): a window partition over rows is no larger than one range, and the
    summary that stitches a group has at most one row per range.
    """
    piece = "__piece"
    cut = in_ranges(df, [*keys, order, tie], tasks)
    payload = F.struct(F.col(order).alias(order), F.col(tie).alias("__tie"), *[F.col(c) for c in carry])
    pieces = cut.groupBy(*keys, piece).agg(F.count(F.lit(1)).alias("__n"), F.min(payload).alias("__first"))
    along = Window.partitionBy(*keys).orderBy(piece)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *keys, piece,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.lead("__first").over(along).alias("__following"),
    )
    within = Window.partitionBy(*keys, piece).orderBy(order, tie)
    local = cut.withColumn("__rn", F.row_number().over(within)).withColumn(
        "__lead", F.lead(payload).over(within)
    )
    out = null_safe_join(local, pieces, [*keys, piece], "inner")
    nxt = F.coalesce(F.col("__lead"), F.col("__following"))
    return out.select(
        *df.columns,
        (F.col("__offset") + F.col("__rn")).alias("rank"),
        *[nxt[c].alias(f"next_{c}") for c in [order, *carry]],
    )


def previous_in_series(
    df: DataFrame, key: str, ts: str, carry: Sequence[str] = (), width: str = "hour"
) -> DataFrame:
    """For rows unique on (key, ts): add `previous_<ts>` and `previous_<c>` of the row before.

    Rows are cut by (key, calendar hour). Only the last row of each hour travels to the next
    non-empty hour, so a series of any length is solved in parallel.
    """
    slot = "__slot"
    cut = df.withColumn(slot, F.date_trunc(width, F.col(ts)))
    state = F.struct(F.col(ts).alias(ts), *[F.col(c) for c in carry])
    slots = cut.groupBy(key, slot).agg(F.max(state).alias("__last"))
    slots = slots.select(
        key, slot, F.lag("__last").over(Window.partitionBy(key).orderBy(slot)).alias("__carried")
    )
    within = Window.partitionBy(key, slot).orderBy(ts)
    local = cut.withColumn("__lag", F.lag(state).over(within))
    out = local.join(slots, [key, slot], "inner")
    prev = F.coalesce(F.col("__lag"), F.col("__carried"))
    return out.select(*df.columns, *[prev[c].alias(f"previous_{c}") for c in [ts, *carry]])


def running_total(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Cumulative sum over an already aggregated table (one row per route or per day)."""
    frame = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(frame))
