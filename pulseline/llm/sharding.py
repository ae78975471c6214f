"""Shards through fixed virtual slots, with DataFrame functions alone.

A record hashes into one of SLOTS virtual slots and stays there for good. Bytes are added up per
slot, and a versioned map says which shard holds a slot. Rebalancing edits the map: it moves slots
between shards (version + 1) and never re-hashes a record. The map has SLOTS rows at most, whatever
the data's size, so the editing runs on the driver and the map may be broadcast.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulseline.llm.common import stored

SLOTS = 8192
#: Bytes that a record takes beside its text.
OVERHEAD = 8
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long"


def virtual_slot(*keys: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size (UTF-8 bytes of the text, 0 for null, plus OVERHEAD), text_crc32, virtual_slot.

    The slot hashes key and text, so neither one key nor one group of copies fills a slot; only
    rows equal in both share one. Null keys and texts hash like any value.
    """
    return docs.select(
        key,
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(key, text, slots=slots).alias("virtual_slot"),
    )


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes per virtual slot: at most SLOTS numbers."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("n")).collect()
    return {row["virtual_slot"]: row["n"] for row in rows}


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 0: slots dealt out in turn."""
    return {slot: slot % shards for slot in range(slots)}


def rebalanced(current: dict[int, int], weight: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited so that shard bytes are nearly equal, moving as few slots as that takes.

    Shards above the mean give up their lightest-needed slots (largest that still fit the excess),
    then the freed slots go, heaviest first, to the shard that holds least. A shard number that
    `current` does not know yet starts empty, which is how a shard is added.
    """
    held: dict[int, list[int]] = {shard: [] for shard in range(shards)}
    for slot, shard in current.items():
        held.setdefault(shard, []).append(slot)
    load = {shard: sum(weight.get(s, 0) for s in own) for shard, own in held.items()}
    mean = sum(load.values()) / shards
    freed, new = [], dict(current)
    for shard, own in held.items():
        spare = load[shard] - mean if shard < shards else load[shard] + 1
        for slot in sorted(own, key=lambda s: (-weight.get(s, 0), s)):
            n = weight.get(slot, 0)
            if shard >= shards or 0 < n <= spare:
                freed.append(slot)
                load[shard] -= n
                spare -= n
    heap = [(load[shard], shard) for shard in range(shards)]
    heapify(heap)
    for slot in sorted(freed, key=lambda s: (-weight.get(s, 0), s)):
        n, shard = heappop(heap)
        new[slot] = shard
        heappush(heap, (n + weight.get(slot, 0), shard))
    return _leveled(new, weight, shards)


def _leveled(current: dict[int, int], weight: dict[int, int], shards: int) -> dict[int, int]:
    """Move or swap single slots between the heaviest and the lightest shard while that helps."""
    new = dict(current)
    held: dict[int, set[int]] = {shard: set() for shard in range(shards)}
    for slot, shard in new.items():
        held[shard].add(slot)
    load = {shard: sum(weight.get(s, 0) for s in own) for shard, own in held.items()}
    for _ in range(20 * shards):
        high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        heavy = sorted(((weight.get(s, 0), s) for s in held[high]), reverse=True)
        light = sorted(((weight.get(s, 0), s) for s in held[low]), reverse=True)
        choice = min(
            ((abs(gap - 2 * (a - b)), x, y) for a, x in heavy[:32] for b, y in [(0, -1), *light[:32]] if 0 < a - b < gap),
            default=None,
        )
        if choice is None:
            break
        _, x, y = choice
        for slot, old, to in ((x, high, low), (y, low, high)):
            if slot >= 0:
                held[old].remove(slot)
                held[to].add(slot)
                new[slot] = to
                load[old] -= weight.get(slot, 0)
                load[to] += weight.get(slot, 0)
    return new


def map_frame(spark: SparkSession, version: int, shard_of: dict[int, int], weight: dict[int, int]) -> DataFrame:
    rows = [(version, slot, shard, weight.get(slot, 0)) for slot, shard in sorted(shard_of.items())]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def plan(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored sized records, and the map history: version 0 as dealt, version 1 rebalanced by bytes."""
    spark = docs.sparkSession
    records = stored(sized(docs, key, text), "shard-records")
    weight = slot_bytes(records)
    start = first_map(shards)
    moved = rebalanced(start, weight, shards)
    history = map_frame(spark, 0, start, weight).unionByName(map_frame(spark, 1, moved, weight))
    return records, history


def placed(records: DataFrame, history: DataFrame, version: int, key: str = "doc_id") -> DataFrame:
    """Records with their shard in a map version and a gapless slot number from 0 in the shard.

    No shard is gathered in one task: records are sorted by ranges of (virtual slot, key), written,
    and counted per range and virtual slot; these counts give each record's number. An empty table
    gives no rows; repeated rows get numbers of their own.
    """
    spark = records.sparkSession
    order = ["virtual_slot", key, "text_crc32"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = stored(
        records.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_mark", F.monotonically_increasing_id()), "shard-order",
    ).withColumn("_part", F.shiftright("_mark", 33))
    groups = marked.groupBy("_part", "virtual_slot").agg(F.count("*").alias("_n"), F.min("_mark").alias("_first"))
    shards = history.filter(F.col("version") == version).select("virtual_slot", "shard")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.join(F.broadcast(shards), "virtual_slot").withColumn(
        "_base", F.coalesce(F.sum("_n").over(before), F.lit(0))
    ).select("_part", "virtual_slot", "shard", "_base", "_first")
    return marked.join(bases, ["_part", "virtual_slot"]).select(
        key, "size", "text_crc32", "virtual_slot", "shard",
        (F.col("_base") + F.col("_mark") - F.col("_first")).alias("slot"),
    )
