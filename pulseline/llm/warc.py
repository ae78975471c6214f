"""WARC volumes and a Merkle fixity audit of their replicas.

Pages become WARC records in scan order; every task writes its records as plain .warc volumes of at
most VOLUME_RECORDS records, so serialising moves no page between machines. A manifest holds each
record's volume, position, offset range and SHA-256. Hashes of FANOUT neighbours combine to a node,
up to one root per replica; ordered positions make a node stand for a contiguous offset range.
An audit compares roots and descends, level by level, only below nodes that differ.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulseline.llm.common import stored

#: Ends every record in the format; the text writer puts it after each row.
END = "\r\n\r\n"
FIRST_LINE = rb"WARC/1\.1\r\n"
FANOUT, VOLUME_LEVELS = 16, 3
VOLUME_RECORDS = FANOUT**VOLUME_LEVELS


def record(url: Column, html: Column, date: str) -> Column:
    """A WARC resource record without its end mark. Null counts as empty; line ends in the address
    are percent-encoded; the record id is a digest of address and body."""
    body = F.coalesce(html, F.lit(""))
    address = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), address,
        F.lit("\r\nWARC-Date: " + date + "\r\nWARC-Record-ID: <urn:md5:"), F.md5(F.concat(address, F.lit("\n"), body)),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body,
    )


def numbered(pages: DataFrame, url: str = "url", html: str = "html", date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Pages with their record and its place: task, file of the task, position in the file. Places
    follow the scan order, which is the same in every run over the same files and settings."""
    row = F.col("_mark").bitwiseAND((1 << 33) - 1)
    return (
        pages.withColumn("_mark", F.monotonically_increasing_id())
        .withColumn("record", record(F.col(url), F.col(html), date))
        .withColumn("task", F.shiftright("_mark", 33))
        .withColumn("file", F.shiftright(row, 4 * VOLUME_LEVELS))
        .withColumn("position", row.bitwiseAND(VOLUME_RECORDS - 1))
        .drop("_mark")
    )


def write_volumes(records: DataFrame, path: str) -> None:
    """The records as .warc text volumes: one file per task and VOLUME_RECORDS records."""
    records.select("record").write.options(lineSep=END, maxRecordsPerFile=VOLUME_RECORDS).text(path)


def manifest(records: DataFrame, *keys: str) -> DataFrame:
    """Stored: task, file, volume (gapless from 0), position, start and length (the offset range
    with the end mark), digest, and `keys`.

    Offsets add up within one volume, which holds VOLUME_RECORDS records at most; volume numbers
    add up over one row per task.
    """
    book = stored(records.select(
        *keys, "task", "file", "position",
        (F.octet_length("record") + len(END)).cast("long").alias("length"),
        F.sha2(F.col("record").cast("binary"), 256).alias("digest"),
    ), "warc-manifest")
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = book.groupBy("task").agg((F.max("file") + 1).alias("_n")).select(
        "task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
    )
    before = Window.partitionBy("task", "file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return book.join(bases, "task").withColumn("volume", F.col("_base") + F.col("file")).drop("_base").withColumn(
        "start", F.coalesce(F.sum("length").over(before), F.lit(0))
    )


def records_in(volume: bytes) -> Iterator[tuple[int, int, str]]:
    """Start, length with the end mark, and SHA-256 of every record of a volume.

    Every place that a record's first line stands at is tried, whatever stands before it, so damage
    of one record hides no other. A page that quotes whole records gives them too; they meet no
    offset range of a manifest.
    """
    for first in re.finditer(FIRST_LINE, volume):
        start = first.start()
        head = volume.find(b"\r\n\r\n", start)
        size = head >= 0 and re.search(rb"\r\nContent-Length: (\d{1,18})(?:\r\n|$)", volume[start:head])
        if size:
            end = head + 4 + int(size[1])
            if end <= len(volume):
                yield start, end + len(END) - start, hashlib.sha256(memoryview(volume)[start:end]).hexdigest()


def cut_volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for task, file, content in zip(*(batch[name] for name in ("task", "file", "content"))):
            found = list(records_in(content.as_py()))
            starts, lengths, digests = zip(*found) if found else ((), (), ())
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(task, n), pa.repeat(file, n), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(digests, pa.string())], names=["task", "file", "start", "length", "digest"])


def read_leaves(spark: SparkSession, path: str, book: DataFrame) -> DataFrame:
    """Stored: volume, position, digest of a replica's records at a manifest's offset ranges.

    Each volume is cut where it is read, and only places and digests are shuffled. A sound range
    always shows, because its own bytes name its length; a range at which the replica has no record
    of that length (damaged, cut off, missing file) has no row, which the tree shows as a missing child.
    """
    name = r"part-(\d+)-.*-c(\d+)"
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", name, 1).cast("long").alias("task"),
        F.regexp_extract("path", name, 2).cast("long").alias("file"), "content",
    )
    found = files.mapInArrow(cut_volumes, "task long, file long, start long, length long, digest string")
    places = book.select("task", "file", "start", "length", "volume", "position")
    return stored(places.join(found, ["task", "file", "start", "length"]).select("volume", "position", "digest"), "warc-leaves")


def levels(book: DataFrame) -> int:
    """Levels above the leaves until one root is left: those of a volume and those above volumes."""
    most, n = book.agg(F.max("volume")).first()[0] or 0, VOLUME_LEVELS
    while most:
        most >>= 4
        n += 1
    return n


def tree(leaves: DataFrame, height: int) -> DataFrame:
    """Stored, all nodes: level, node (number in its level, counted over all volumes), digest.

    Level 0 holds the leaves, node = volume * VOLUME_RECORDS + position. A parent hashes its at
    most FANOUT children in order, with their numbers, so a missing child shows.
    """
    level = leaves.select((F.col("volume") * VOLUME_RECORDS + F.col("position")).alias("node"), "digest")
    nodes = level.withColumn("level", F.lit(0))
    for k in range(1, height + 1):
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")
        level = level.groupBy(F.shiftright("node", 4).alias("node")).agg(F.sha2(joined, 256).alias("digest"))
        level = stored(level, "merkle-level") if k == 1 else level
        nodes = nodes.unionByName(level.withColumn("level", F.lit(k)))
    return stored(nodes, "merkle-tree")


def damaged(mine: DataFrame, other: DataFrame, height: int) -> DataFrame:
    """Leaf numbers at which two trees differ, found from the roots down.

    Each step joins only the children of nodes that differ; a node that one side lacks differs.
    Equal roots end the search at once.
    """
    bad = None
    for k in range(height, -1, -1):
        a = mine.filter(F.col("level") == k).select("node", F.col("digest").alias("_a"))
        b = other.filter(F.col("level") == k).select("node", F.col("digest").alias("_b"))
        if bad is not None:
            parent = bad.withColumnRenamed("node", "_parent")
            a = a.join(parent, F.shiftright(a["node"], 4) == parent["_parent"], "left_semi")
            b = b.join(parent, F.shiftright(b["node"], 4) == parent["_parent"], "left_semi")
        differ = a.join(b, "node", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
        bad = stored(differ, "merkle-differences")
        if bad.isEmpty():
            break
    return bad


def audit(book: DataFrame, replica: DataFrame) -> DataFrame:
    """A manifest with `intact`: whether the replica's bytes in each offset range are the same.

    An empty manifest gives no rows."""
    height = levels(book)
    found = damaged(tree(book.select("volume", "position", "digest"), height), tree(replica, height), height)
    found = found.withColumn("_damaged", F.lit(True))
    node = F.col("volume") * VOLUME_RECORDS + F.col("position")
    return book.withColumn("node", node).join(found, "node", "left").withColumn(
        "intact", F.coalesce(~F.col("_damaged"), F.lit(True))
    ).drop("node", "_damaged")
