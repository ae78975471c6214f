"""Readers: ping archives by date, schedule CSVs, decoded feed messages, samples, file audits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from pulseline.config import PING_COLUMNS
from pulseline.functions.joins import with_scalars

PING_SCHEMA = T.StructType(
    [T.StructField("collection_timestamp", T.TimestampType()), T.StructField("api_vehicle_timestamp", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("entity_id", "vehicle_id", "route_id", "trip_id")]
    + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "bearing", "speed")]
)

_POSITION = "position struct<latitude: double, longitude: double, bearing: double, speed: double>"
FEED_SCHEMA = (
    "entity array<struct<id: string, vehicle: struct<trip: struct<route_id: string, trip_id: string>, "
    f"vehicle: struct<id: string>, {_POSITION.replace('position ', 'position: ')}, timestamp: bigint>>>"
)


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    """The whole ping archive, contract columns matched by name over drifting files.

    The schema is the contract, so no footer is read before the scan; a column that a file lacks
    is NULL there.
    """
    return (
        spark.read.schema(PING_SCHEMA).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").parquet(path)
    )


def scan_partitions(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """A date-partitioned archive between two dates (inclusive); the filter prunes folders.

    `first` later than `last` gives no rows. Folders that are not dates are ignored.
    """
    df = spark.read.schema(T.StructType([*PING_SCHEMA.fields, T.StructField("date", T.StringType())])).parquet(path)
    day = F.col("date")
    df = df.where(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull())
    if first is not None:
        df = df.where(day >= first)
    if last is not None:
        df = df.where(day <= last)
    return df


def scan_one_date(spark: SparkSession, path: str, day: str) -> DataFrame:
    """One day of the archive; a missing day is an error, not an empty result."""
    df = scan_partitions(spark, path, day, day)
    if df.isEmpty():
        raise FileNotFoundError(f"no pings for {day} under {path}")
    return df


def tolerant_load(spark: SparkSession, path: str) -> DataFrame:
    """Load what can be read, skipping damaged files; columns that a file lacks are NULL."""
    return (
        spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").schema(PING_SCHEMA).parquet(path)
    )


def load_report(spark: SparkSession, path: str, expected: Sequence[str] = PING_COLUMNS) -> DataFrame:
    """One row: files, loaded_files, skipped_files (damaged or without rows), and for each expected
    column the loaded files in which it never has a value.

    Files are listed by Spark's own file metadata, without reading them; Spark never lists a file
    of zero bytes.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        .agg(F.count("path").alias("files"))
    )
    per_file = tolerant_load(spark, path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        *[F.count(c).alias(c) for c in expected]
    )
    loaded = per_file.agg(
        F.count("file").alias("loaded_files"), *[F.count_if(F.col(c) == 0).alias(f"without_{c}") for c in expected]
    )
    return with_scalars(loaded, listed).select(
        "files", "loaded_files", (F.col("files") - F.col("loaded_files")).alias("skipped_files"), *[f"without_{c}" for c in expected]
    )


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """Files without a readable Parquet footer, and empty ones."""
    bad = ~F.col("readable") | (F.col("row_count") == 0)
    return file_audit(spark, path).where(bad).select("file_name", "size_bytes")


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_name"))


def schedule_csv(spark: SparkSession, path: str) -> DataFrame:
    """A schedule CSV with header, every column text; casts happen in the dimension step."""
    return spark.read.csv(path, header=True, inferSchema=False)


def typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A metric CSV under an explicit schema (ids as text); a header that disagrees is an error."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")


def require_inputs(spark: SparkSession, paths: Sequence[str]) -> None:
    """Fail when any of the named inputs does not exist."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    missing = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).exists(path):
            missing.append(p)
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def stop_times_scan(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Distinct (trip, stop) of the wanted trips; only two columns of the big file are read."""
    return (
        stop_times.select("trip_id", "stop_id")
        .join(trips.select("trip_id"), "trip_id", "left_semi").distinct()
    )


def flatten_feed(messages: DataFrame, body: str = "body") -> DataFrame:
    """Decoded feed messages (JSON text plus collection time) to one ping per vehicle entity.

    Entities without a vehicle are dropped, absent parts become NULL, a zero report time is NULL.
    """
    feed = F.from_json(F.col(body), FEED_SCHEMA)
    entity = messages.select("collection_timestamp", F.explode(feed["entity"]).alias("e"))
    v = F.col("e.vehicle")
    return entity.where(v.isNotNull()).select(
        "collection_timestamp",
        F.timestamp_seconds(F.nullif(v["timestamp"], F.lit(0).cast("bigint"))).alias("api_vehicle_timestamp"),
        F.col("e.id").alias("entity_id"), v["vehicle"]["id"].alias("vehicle_id"),
        v["trip"]["route_id"].alias("route_id"), v["trip"]["trip_id"].alias("trip_id"),
        v["position"]["latitude"].alias("latitude"), v["position"]["longitude"].alias("longitude"),
        v["position"]["bearing"].alias("bearing"), v["position"]["speed"].alias("speed"),
    )


def pings_to_feed(pings: DataFrame) -> DataFrame:
    """The inverse of `flatten_feed`: one JSON message per entity, for replay and tests."""
    entity = F.struct(
        F.col("entity_id").alias("id"),
        F.struct(
            F.struct("route_id", "trip_id").alias("trip"),
            F.struct(F.col("vehicle_id").alias("id")).alias("vehicle"),
            F.struct("latitude", "longitude", "bearing", "speed").alias("position"),
            F.unix_seconds("api_vehicle_timestamp").alias("timestamp"),
        ).alias("vehicle"),
    )
    return pings.select("collection_timestamp", F.to_json(F.struct(F.array(entity).alias("entity"))).alias("body"))


def _open_store(path: str):
    """File system and key of a path or URI, and the text that turns a key back into a URI."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        scheme = path.split("://", 1)[0]
        store, key = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        return store, key, f"{scheme}://"
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every visible file below a path: path (a URI) and size_bytes, from Spark's own file listing.

    No file is opened. Spark's tables leave zero-byte files out, and its listing has them: files of the
    listing without a row are those of size 0. The names are what Spark's driver holds for any scan.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = spark.createDataFrame([(p,) for p in listed.inputFiles()], "path string")
    sized = listed.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"))
    plain = F.regexp_replace("path", "^file:/+", "file:///")
    return names.withColumn("path", plain).join(sized.withColumn("path", plain), "path", "left").select(
        "path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))


def _footers(batches):
    """Read the first and last bytes of each file, never its data. What cannot be read is an error;
    bytes that are no footer make a file unreadable as Parquet."""
    import io
    import urllib.parse

    import pandas as pd
    import pyarrow as pa
    from pyarrow import parquet as pq

    def footer(path, size):
        store, key, _ = _open_store(urllib.parse.unquote(path))
        with store.open_input_file(key) as f:
            head, tail = f.read(4), b""
            if size >= 8:
                f.seek(size - 8)
                tail = f.read(8)
                length = int.from_bytes(tail[:4], "little")
                if head == tail[4:] == b"PAR1" and length <= size - 12:
                    f.seek(size - 8 - length)
                    return True, f.read(length + 8)
            return head == b"PAR1" == tail[4:], None

    for pdf in batches:
        rows = []
        for path, size in zip(pdf["path"], pdf["size_bytes"]):
            magic, raw = footer(path, size) if size else (False, None)
            n, cols, readable = 0, [], False
            if raw is not None:
                try:
                    meta = pq.read_metadata(io.BytesIO(b"PAR1" + raw))
                    n, cols, readable = meta.num_rows, meta.schema.to_arrow_schema().names, True
                except (pa.ArrowException, OSError):  # the bytes at hand are no footer
                    pass
            name = urllib.parse.unquote(path.rsplit("/", 1)[-1])
            rows.append((path, name, int(size), magic, readable, int(n), list(cols)))
        yield pd.DataFrame(rows, columns=["path", "file_name", "size_bytes", "is_parquet", "readable",
                                          "row_count", "columns"])


def file_audit(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """Every file under a path: size, Parquet magic, readable footer, rows and columns.

    Names and sizes come from Spark's listing; the files are spread evenly over tasks, which read
    magic bytes and footers. Only bytes that are no footer count as damage; a file that cannot be
    opened or read fails the audit.
    """
    schema = ("path string, file_name string, size_bytes bigint, is_parquet boolean, readable boolean, "
              "row_count bigint, columns array<string>")
    return list_files(spark, path).repartition(tasks or spark.sparkContext.defaultParallelism).mapInPandas(_footers, schema)


def file_magic_audit(spark: SparkSession, path: str) -> DataFrame:
    """Every file with its size and whether it carries the Parquet magic."""
    return file_audit(spark, path).select("file_name", "size_bytes", "is_parquet")


def _key_hash(key: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).cast("binary"))


def sample_per_file(df: DataFrame, key: Sequence[str], target: int = 5000, salts: int = 64) -> DataFrame:
    """At most max(1, target / files) rows of every file, chosen by a fixed hash of the row.

    The smallest MD5 values of the key's text win, first within salted slices of a file and then among the survivors, so
    one huge file is not ranked in a single task. Rows without a position are dropped afterwards.
    """
    # one task gives its files in several folders the same name, so a file is told by its path
    tagged = df.withColumn("__file", F.col("_metadata.file_path")) if "__file" not in df.columns else df
    n_files = max(1, tagged.select("__file").distinct().count())
    keep = max(1, math.floor(target / n_files))
    hashed = tagged.withColumn("__h", _key_hash(key)).withColumn("__s", F.pmod(F.xxhash64("__h"), F.lit(salts)))
    order = [F.col("__h"), *[F.col(k) for k in key]]
    first = F.row_number().over(Window.partitionBy("__file", "__s").orderBy(*order))
    second = F.row_number().over(Window.partitionBy("__file").orderBy(*order))
    out = (
        hashed.withColumn("__rn", first).where(F.col("__rn") <= keep)
        .withColumn("__rn", second).where(F.col("__rn") <= keep)
    )
    return out.drop("__h", "__s", "__rn", "__file").dropna(subset=["latitude", "longitude"])


def sample_cap(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """At most n rows, the ones with the smallest MD5 of the key's text (a per-task top-n, then a merge)."""
    return df.orderBy(_key_hash(key), *key).limit(n)
