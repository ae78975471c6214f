"""Join helpers that stay correct and balanced when one key dominates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate to every row, as a scalar subquery.

    A global aggregate has exactly one row whatever the input size. Spark runs it once and puts
    the values into the expression; there is no join and nothing to broadcast.
    """
    value = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s")).scalar()
    return df.withColumn("__s", value).select(*df.columns, *[F.col(f"__s.{c}").alias(c) for c in one_row.columns])


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality on every key with NULL equal to NULL (still a hash or merge join)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL; the right copy of the keys is dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join of a large table to a dimension, with NULL keys spread over all partitions.

    NULL keys can match nothing but would all hash to one shuffle partition. They get a
    stand-in key taken from `spread_by` under a prefix that no real key carries. A hot real
    key is left to adaptive skew splitting, which cuts the fact side of a merge join by map output.
    """
    stand_in = F.concat(F.lit("\u0000null:"), F.pmod(F.xxhash64(spread_by), F.lit(4096)).cast("string"))
    keyed = facts.withColumn("__key", F.coalesce(F.col(key), stand_in))
    right = dim.withColumnRenamed(key, "__key")
    return keyed.join(right, "__key", "left").drop("__key")


#: A key with more than this share of all rows is spread; so there are fewer such keys than that.
HEAVY_SHARE = 256


def heavy_keys(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame | None:
    """The keys that hold more than 1 / HEAVY_SHARE of all rows, with `__salts`, the number of equal
    parts that makes each no larger than that; None if there are none. One small job; the driver gets
    at most HEAVY_SHARE rows, whatever the input, and they go into plans as literals."""
    per = counts.groupBy(*keys).agg(F.sum(n).alias("__n"))
    total = with_scalars(per, per.agg(F.sum("__n").alias("__all")))
    salts = F.ceil(F.col("__n") * HEAVY_SHARE / F.col("__all")).cast("int")
    few = total.filter(F.col("__n") * HEAVY_SHARE > F.col("__all")).select(*keys, salts.alias("__salts"))
    rows = few.collect()
    return counts.sparkSession.createDataFrame(rows, few.schema) if rows else None


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], heavy: DataFrame | None, spread_by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on `keys`, with the rows of heavy keys dealt over as many tasks as they have salts.

    `heavy` comes from `heavy_keys` and may hold some of the keys only; its size bound allows the
    broadcast. The left rows of a heavy key get one of its salts by a hash of `spread_by`, its right
    rows are repeated for each salt.
    """
    if heavy is None:
        return left.join(right, list(keys), how)
    on = [c for c in heavy.columns if c != "__salts"]
    few = F.broadcast(heavy)
    one = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("__salts").cast("long")), F.lit(0)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    a = left.join(few, on, "left").withColumn("__salt", one).drop("__salts")
    b = right.join(few, on, "left").withColumn("__salt", every).drop("__salts")
    return a.join(b, [*keys, "__salt"], how).drop("__salt")
