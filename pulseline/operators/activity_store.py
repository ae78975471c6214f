"""Activity cells of a growing archive, kept by day, with mergeable distinct-count sketches.

A store holds two tables, partitioned by date: `cells` (the grain of all exact activity tables) and
`sketches` (one row per day and route). A refresh reads the given days of the archive and replaces
these days; all other days are neither read nor written. The exact tables come from the cells by the
same functions as from raw pings. The sketched tables are the opt-in for windows whose cells are too
many to count: their distinct counts are estimates, everything else in them is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulseline.functions import columns as C
from pulseline.functions import rollups as roll
from pulseline.sources.files import scan_partitions

#: Binary logarithm of a sketch's registers.
SKETCH_BITS = 12
#: Relative standard error of a merged sketch; counts of some hundreds are nearly exact.
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)

CELL_SCHEMA = T.StructType(
    [T.StructField("hour", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("route_id", "vehicle_id", "trip_id")]
    + [T.StructField(roll.ROWS, T.LongType())]
    + [T.StructField(c, T.TimestampType()) for c in (roll.FIRST, roll.LAST)] + [T.StructField("date", T.StringType())]
)
SKETCH_SCHEMA = T.StructType(
    [T.StructField("route_id", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("records", "rows", "hours")]
    + [T.StructField(c, T.TimestampType()) for c in (roll.FIRST, roll.LAST)]
    + [T.StructField(c, T.BinaryType()) for c in ("vehicles", "trips")] + [T.StructField("date", T.StringType())]
)


def _replace_days(df: DataFrame, path: str) -> None:
    """Replace the days that `df` holds, in one commit; the hint keeps files even."""
    df.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def _days(df: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first is not None:
        df = df.where(F.col("date") >= first)
    return df if last is None else df.where(F.col("date") <= last)


def read_cells(spark: SparkSession, store: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Cells between two dates (inclusive), for the functions of `operators.activity`."""
    return _days(spark.read.schema(CELL_SCHEMA).parquet(f"{store}/cells"), first, last)


def read_sketches(spark: SparkSession, store: str, first: str | None = None, last: str | None = None) -> DataFrame:
    return _days(spark.read.schema(SKETCH_SCHEMA).parquet(f"{store}/sketches"), first, last)


def day_sketches(cells: DataFrame) -> DataFrame:
    """One row per day and route (pings without a route have a row too): records with a vehicle, rows,
    hours as a bit set, first and last time, and sketches of vehicles and trips."""
    hour_bit = F.expr("shiftleft(1L, hour)")
    return cells.groupBy("date", "route_id").agg(
        roll.rows_with("vehicle_id").alias("records"), roll.rows().alias("rows"), F.bit_or(hour_bit).alias("hours"),
        F.min(roll.FIRST).alias(roll.FIRST), F.max(roll.LAST).alias(roll.LAST),
        F.hll_sketch_agg("vehicle_id", SKETCH_BITS).alias("vehicles"), F.hll_sketch_agg("trip_id", SKETCH_BITS).alias("trips"),
    )


def refresh(spark: SparkSession, archive: str, store: str, first: str | None = None, last: str | None = None) -> None:
    """Bring the days from `first` to `last` of a store up to date with a date-partitioned archive.

    Only these days of the archive are read; a ping belongs to the day of its folder. Late pings and repeated runs are right, because a day is
    replaced as a whole; a day that the archive lacks keeps what the store has. A run that fails
    between the two tables is mended by running it again.
    """
    timed = scan_partitions(spark, archive, first, last).withColumn("hour", F.hour("collection_timestamp"))
    _replace_days(roll.cells(timed, roll.ACTIVITY_GRAIN), f"{store}/cells")
    _replace_days(day_sketches(read_cells(spark, store, first, last)), f"{store}/sketches")


def sketched(sketches: DataFrame, *by: str) -> DataFrame:
    """Activity per `by` (of route_id and date; none: one row) from day sketches.

    `unique_vehicles` and `unique_trips` are estimates with the relative standard error
    SKETCH_ERROR; records, days, hours and times are exact. Pings without a key of `by` stay out.
    """
    for key in by:
        sketches = sketches.where(F.col(key).isNotNull())
    return sketches.groupBy(*by).agg(
        F.sum("records").alias("total_records"),
        F.hll_sketch_estimate(F.hll_union_agg("vehicles")).alias("unique_vehicles"),
        F.hll_sketch_estimate(F.hll_union_agg("trips")).alias("unique_trips"),
        *([] if "date" in by else [F.count_distinct("date").alias("days_active")]),
        F.coalesce(F.bit_count(F.bit_or("hours")), F.lit(0)).cast("long").alias("active_hours"), *roll.seen(),
    ).withColumn("records_per_vehicle", C.rnd(C.ratio("total_records", "unique_vehicles")))
