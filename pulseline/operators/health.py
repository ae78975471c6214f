"""File and pipeline health of a ping archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseline.config import FRESH_MINUTES, PING_COLUMNS
from pulseline.functions import columns as C
from pulseline.sources.files import file_audit, tolerant_load


def file_health(spark: SparkSession, path: str, expected: Sequence[str] = PING_COLUMNS) -> DataFrame:
    """One row per file: footer facts joined with content facts and an OK / WARN / FAIL status.

    Footers come from the audit (no data read); content facts come from one grouped scan under the
    contract schema that skips damaged files. Duplicates are counted as rows minus distinct (vehicle, report time),
    which spreads a hot file over all tasks by the distinct value.
    """
    facts = file_audit(spark, path)
    data = tolerant_load(spark, path)
    present = [c for c in expected if c in data.columns]
    pair = F.struct(*[c for c in ("vehicle_id", "api_vehicle_timestamp") if c in data.columns])
    nulls = [C.rnd(F.avg(F.col(c).isNull().cast("int")) * 100.0).alias(f"null_pct_{c}") for c in present]
    content = data.withColumn("path", F.col("_metadata.file_path")).groupBy("path").agg(
        (F.count(F.lit(1)) - F.count_distinct(pair)).alias("duplicate_count"),
        F.min("collection_timestamp").alias("earliest_timestamp"),
        F.max("collection_timestamp").alias("latest_timestamp"),
        F.count_distinct("route_id").alias("unique_routes"), *nulls,
    )
    # listing and scan may spell a local URI with one or three slashes
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    joined = facts.withColumn("path", plain).join(content.withColumn("path", plain), "path", "left")
    missing = F.array_except(F.array(*[F.lit(c) for c in expected]), "columns")
    fail = (F.col("size_bytes") == 0) | ~F.col("readable") | (F.col("row_count") == 0) | (F.size("missing") > 0)
    sparse = F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(f"null_pct_{c}", F.lit(0.0)) for c in present]) > 50.0
    return joined.withColumn("missing", missing).withColumns({
        "missing_columns": F.array_join("missing", ","),
        "duplicate_count": F.coalesce("duplicate_count", F.lit(0)),
        "status": F.when(fail, "FAIL").when((F.coalesce("duplicate_count", F.lit(0)) > 0) | sparse, "WARN").otherwise("OK"),
    }).drop("missing", "columns")


def pipeline_health(files: DataFrame, now: Column, expected: Sequence[str] = PING_COLUMNS) -> DataFrame:
    """One row of archive-wide health; `now` is passed in so that a run can be repeated."""
    ok = F.col("status") != "FAIL"
    valid = F.count_if(ok)
    largest = F.max(F.when(ok, F.struct("size_bytes", "file_name")))
    smallest = F.min(F.when(ok, F.struct("size_bytes", "file_name")))
    one = files.agg(
        F.count(F.lit(1)).alias("total_files"), valid.alias("valid_files"),
        F.count_if(~ok).alias("failed_files"), F.count_if(F.col("status") == "WARN").alias("warned_files"),
        F.count_if((F.col("size_bytes") == 0) | (F.col("readable") & (F.col("row_count") == 0))).alias("empty_files"),
        F.count_if(~F.col("readable") & (F.col("size_bytes") > 0)).alias("corrupted_files"),
        F.sum(F.when(ok, F.col("row_count")).otherwise(0)).alias("total_rows"),
        F.sum("duplicate_count").alias("total_duplicates"),
        F.min(F.when(ok, F.col("earliest_timestamp"))).alias("earliest_timestamp"),
        F.max(F.when(ok, F.col("latest_timestamp"))).alias("latest_timestamp"),
        F.max(F.when(ok, F.col("unique_routes"))).alias("max_routes_in_file"),
        largest.alias("big"), smallest.alias("small"),
        *[C.rnd(F.avg(F.when(ok, F.col(f"null_pct_{c}")))).alias(f"avg_null_pct_{c}")
          for c in expected if f"null_pct_{c}" in files.columns],
    )
    minutes = (C.epoch_seconds(now) - C.epoch_seconds("latest_timestamp")) / F.lit(60.0)
    return one.withColumns({
        "avg_rows_per_file": C.rnd(F.coalesce(C.ratio("total_rows", "valid_files"), F.lit(0.0)), 1),
        "largest_file": F.col("big.file_name"), "largest_file_bytes": F.col("big.size_bytes"),
        "smallest_file": F.col("small.file_name"), "smallest_file_bytes": F.col("small.size_bytes"),
        "freshness_minutes": C.rnd(minutes, 1),
        "freshness_status": F.when(F.col("latest_timestamp").isNull(), "UNKNOWN")
        .when(minutes <= FRESH_MINUTES, "FRESH").otherwise("STALE"),
    }).drop("big", "small")


def files_per_hour(files: DataFrame) -> DataFrame:
    """Valid files by the hour of their newest record."""
    known = files.where((F.col("status") != "FAIL") & F.col("latest_timestamp").isNotNull())
    return known.groupBy(F.date_format("latest_timestamp", "yyyy-MM-dd HH:00").alias("hour")).agg(
        F.count(F.lit(1)).alias("files")
    )


def all_dates_status(files: DataFrame, first: str, last: str) -> DataFrame:
    """Per date folder (at any depth) of a range: files, valid, corrupt, rows and time span; absent dates stay listed."""
    day = F.to_date(F.nullif(F.regexp_extract("path", r".*[/=](\d{4}-\d{2}-\d{2})/", 1), F.lit("")))
    per = files.withColumn("date", day).groupBy("date").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("readable").alias("valid_files"),
        F.count_if(~F.col("readable")).alias("corrupted_files"), F.sum("row_count").alias("total_rows"),
        F.min("earliest_timestamp").alias("earliest_record"), F.max("latest_timestamp").alias("latest_record"),
    )
    days = files.sparkSession.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date")
    )
    return days.join(per, "date", "left").withColumn("is_missing", F.col("total_files").isNull()).fillna(
        0, ["total_files", "valid_files", "corrupted_files", "total_rows"]
    )


def file_profile(df: DataFrame, columns: Sequence[str] = PING_COLUMNS, top: int = 10) -> DataFrame:
    """Row count, NULLs per column, and the busiest routes of a file or archive, in long form."""
    cols = [c for c in columns if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    nulls = wide.select(F.expr(f"stack({len(cols) + 1}, 'rows', rows, {pairs}) AS (item, value)"))
    routes = (
        df.where(F.col("route_id").isNotNull()).groupBy("route_id").agg(F.count(F.lit(1)).alias("value"))
        .orderBy(F.desc("value"), "route_id").limit(top)
    )
    spread = df.agg(F.count_distinct("route_id").alias("value"))
    return (
        nulls.select(F.lit("null_count").alias("section"), "item", "value")
        .unionByName(routes.select(F.lit("top_route").alias("section"), F.col("route_id").alias("item"), "value"))
        .unionByName(spread.select(F.lit("unique_routes").alias("section"), F.lit("route_id").alias("item"), "value"))
    )


def freshness(df: DataFrame, now: Column, ts: str = "collection_timestamp") -> DataFrame:
    """Minutes since the newest record and whether that is within the limit."""
    one = df.agg(F.max(ts).alias("latest_timestamp"))
    minutes = (C.epoch_seconds(now) - C.epoch_seconds("latest_timestamp")) / F.lit(60.0)
    return one.withColumns({
        "freshness_minutes": C.rnd(minutes, 1),
        "freshness_status": F.when(F.col("latest_timestamp").isNull(), "UNKNOWN")
        .when(minutes <= FRESH_MINUTES, "FRESH").otherwise("STALE"),
    })


