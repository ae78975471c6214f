"""Exact percentiles of unbounded value sets without holding a group's values in one task.

Spark's own `percentile` keeps every distinct value of a group in one aggregation buffer. That
is right for values on a bounded grid (counts, gaps rounded to 0.1 m); for free-running doubles
of a hot group this module counts values first, finds which magnitude bin holds each wanted
rank, and sorts only those bins. Results are the same linear interpolation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

_STEPS_PER_OCTAVE = 64
_ORIGIN = 1_000_000


def magnitude_bin(value: Column) -> Column:
    """An order-preserving integer bin, about 1 % wide, computed from the value alone."""
    size = F.floor(F.log2(F.abs(value)) * F.lit(_STEPS_PER_OCTAVE)).cast("long") + F.lit(_ORIGIN)
    signed = F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)
    # never NULL, so that joins on the bin add no filter and both uses share one exchange
    return F.coalesce(signed, F.lit(0))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]
) -> DataFrame:
    """One row per key with a column per wanted probability. NULL values and keys are kept out."""
    keys = list(keys)
    v, n, b = "__v", "__n", "__bin"
    known = df.where(F.col(value).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    freq = (
        known
        .groupBy(*keys, F.col(value).cast("double").alias(v))
        .agg(F.count(F.lit(1)).alias(n))
        .withColumn(b, magnitude_bin(F.col(v)))
    )
    along = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = freq.groupBy(*keys, b).agg(F.sum(n).alias("__bn"))
    bins = bins.select(
        *keys, b,
        (F.sum("__bn").over(along) - F.col("__bn")).alias("__start"),
        F.sum("__bn").over(along).alias("__end"),
        F.sum("__bn").over(Window.partitionBy(*keys)).alias("__total"),
    )

    def edges(p: float) -> tuple[Column, Column, Column]:
        at = F.lit(float(p)) * (F.col("__total") - F.lit(1)).cast("double")
        return at, F.floor(at), F.ceil(at)

    ranks = [r for p in wanted.values() for r in edges(p)[1:]]
    holds = reduce(
        lambda x, y: x | y, [(r >= F.col("__start")) & (r < F.col("__end")) for r in ranks]
    )
    hit = freq.join(bins.where(holds), [*keys, b], "inner")
    inside = (
        Window.partitionBy(*keys, b).orderBy(v).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hit = hit.withColumn("__hi", F.col("__start") + F.sum(n).over(inside)).withColumn(
        "__lo", F.col("__hi") - F.col(n)
    )

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__lo")) & (rank < F.col("__hi")), F.col(v)))

    aggs = [F.max("__total").alias("__total")]
    for name, p in wanted.items():
        _, lo, hi = edges(p)
        aggs += [at_rank(lo).alias(f"__l_{name}"), at_rank(hi).alias(f"__h_{name}")]
    out = hit.groupBy(*keys).agg(*aggs)
    cols = []
    for name, p in wanted.items():
        at, lo, _ = edges(p)
        low, high = F.col(f"__l_{name}"), F.col(f"__h_{name}")
        cols.append((low + (high - low) * (at - lo.cast("double"))).alias(name))
    return out.select(*keys, *cols)
