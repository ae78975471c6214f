"""Structured Streaming versions of ingest, de-duplication, monitoring and bunching.

Every job runs with `availableNow`: it drains what the source holds, commits, and stops, so the
same code serves as an incremental batch on a schedule or, with another trigger, continuously.
Sinks and checkpoints live in the folder the caller names (shared storage on a cluster).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseline.operators import health
from pulseline.operators import silver as sil
from pulseline.operators import spacing as spc

LOCAL_SESSION_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def drain(stream: DataFrame, sink: str, checkpoint: str, partition_by: str | None = None) -> str:
    """Append a stream to Parquet until its source is empty (exactly once by the file sink's log)."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    (writer.partitionBy(partition_by) if partition_by else writer).start().awaitTermination()
    return sink


def drain_batches(stream: DataFrame, job: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> str:
    """Run a batch operator per micro-batch. A replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
    return sink


def stream_bronze(pings: DataFrame, sink: str, checkpoint: str) -> str:
    """Raw pings to date folders, one append per micro-batch."""
    dated = pings.withColumn("date", F.date_format("collection_timestamp", "yyyy-MM-dd"))
    return drain(dated, sink, checkpoint, "date")


def stream_dedup(pings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per (vehicle, report time); state older than the delay is forgotten."""
    return pings.withWatermark("api_vehicle_timestamp", delay).dropDuplicatesWithinWatermark(
        ["vehicle_id", "api_vehicle_timestamp"]
    )


def cycles_per_hour(pings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Collection cycles per hour, emitted when the watermark has passed the hour.

    Pings of a cycle collapse to one key before they reach the window state.
    """
    cycles = pings.select("collection_timestamp").withWatermark("collection_timestamp", delay).dropDuplicates(
        ["collection_timestamp"]
    )
    return cycles.groupBy(F.window("collection_timestamp", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("cycles")
    ).select(F.col("w.start").alias("hour_start"), "cycles")


def freshness_job(now: Column) -> Callable[[DataFrame], DataFrame]:
    """Per micro-batch: minutes since the newest record and FRESH / STALE."""
    return lambda batch: health.freshness(batch, now)


def closed_snapshots(pings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Pings whose snapshot is complete: all rows of a collection time come out in the one micro-batch
    in which the watermark passes it, however many files and micro-batches brought them.

    State holds the rows of open snapshots, spread by the whole row; repeated rows become one, and
    rows later than `delay` are dropped, as a watermark does.
    """
    waiting = pings.withWatermark("collection_timestamp", delay)
    return waiting.groupBy(*pings.columns).agg(F.count(F.lit(1)).alias("copies")).drop("copies")


def bunching_job(length_km: float, distance: str, keys=spc.SNAPSHOT_KEYS) -> Callable[[DataFrame], DataFrame]:
    """For rows that hold whole snapshots (see `upsert_slots` and `closed_snapshots`): bunching events."""

    def run(batch: DataFrame) -> DataFrame:
        placed = sil.silver_positions(batch).withColumnRenamed(distance, spc.DIST).withColumn(
            "shape_length_km", F.lit(length_km)
        )
        return spc.bunching_events(spc.observed_headways(spc.terminal_buffer(placed), keys, ("route_id",)))

    return run


#: Marks the row that says that a slot was computed, so that a slot without results is rewritten too.
_SEEN = "_slot_only"
#: A slot of a large micro-batch is written to bronze by up to so many tasks; adaptive execution joins small shares.
SHARES = 16


def by_slot(batch: DataFrame, slot: Column) -> DataFrame:
    """The batch with its slot, moved so that the tasks that write it, which sort by slot, hold a
    share of a slot each, however few files brought the batch."""
    hashed = [f"`{f.name}`" for f in batch.schema.fields if "map<" not in f.dataType.simpleString()]
    share = F.pmod(F.xxhash64(*hashed), F.lit(SHARES))
    return batch.withColumns({"slot": slot, "_share": share}).hint("rebalance", "slot", "_share").drop("_share")


def upsert_slots(
    stream: DataFrame, job: Callable[[DataFrame], DataFrame], bronze: str, sink: str, checkpoint: str,
    time: str = "collection_timestamp", slot: str = "yyyy-MM-dd-HH",
) -> str:
    """Keep the results of a batch operator right for every slot of time that a micro-batch touches.

    A micro-batch is first added to bronze, under its own number and its slots (see `by_slot`). Then the slots that
    it touched, and no others, are read whole from bronze, computed anew and written over the old
    ones. So results are there with the batch that brings the last row, a late row mends its slot,
    repeated rows stay, and a replayed batch writes the same again. A batch of live data touches a
    slot or two; the driver holds the names of the touched slots. No state is kept. Rows without a
    time share the slot `none`. A snapshot must lie within one slot. Read the sink by `slot_results`.
    """
    name = F.coalesce(F.date_format(time, slot), F.lit("none"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"{bronze}/batch={batch_id}"
        by_slot(batch, name).write.mode("overwrite").partitionBy("slot").parquet(own)
        kept = spark.read.schema(f"{batch_schema}, batch string, slot string").parquet(bronze)
        touched = [r["slot"] for r in kept.filter(F.col("batch") == str(batch_id)).select("slot").distinct().collect()]
        rows = kept.filter(F.col("slot").isin(touched)).drop("batch", "slot")
        found = job(rows).withColumns({"slot": F.coalesce(F.date_format(time, slot), F.lit("none")), _SEEN: F.lit(False)})
        seen = spark.createDataFrame([(t, True) for t in touched], f"slot string, {_SEEN} boolean")
        found.unionByName(seen, allowMissingColumns=True).hint("rebalance", "slot").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(sink)

    batch_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
    return sink


def slot_results(spark: SparkSession, sink: str) -> DataFrame:
    """The results that `upsert_slots` keeps."""
    return spark.read.parquet(sink).filter(~F.col(_SEEN)).drop("slot", _SEEN)


def newest_per_feed(pings: DataFrame, feed: Column, ts: str = "collection_timestamp") -> DataFrame:
    """The newest record of each feed, as a running aggregate: its state is one row for each feed."""
    return pings.groupBy(feed.alias("feed")).agg(F.max(ts).alias(ts))


def drain_upserts(running: DataFrame, key: str, sink: str, checkpoint: str) -> str:
    """Keep a running aggregate as a table: each micro-batch writes the keys that it changed over
    their old rows, so the table is the state, and a replayed or restarted batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(sink)

    (
        running.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
    return sink


def reporting_sessions(pings: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Runs of reports per vehicle separated by GPS silence longer than the gap."""
    pings.sparkSession.conf.set(LOCAL_SESSION_MERGE, "true")  # merge sessions before the shuffle
    known = pings.where(F.col("vehicle_id").isNotNull()).withWatermark("api_vehicle_timestamp", delay)
    return known.groupBy("vehicle_id", F.session_window("api_vehicle_timestamp", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("reports"),
        F.min("api_vehicle_timestamp").alias("first_report"), F.max("api_vehicle_timestamp").alias("last_report"),
    ).select("vehicle_id", "first_report", "last_report", "reports")


def read_pings(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the Parquet files of an archive."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
