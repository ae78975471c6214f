"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import pulseline
from pulseline.session import scratch_path

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Tasks cut their Arrow batches into pieces of about so many bytes of text.
PIECE_BYTES = 1 << 20


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each Spark context: they may start in any
    folder. The archive goes through Spark's own file distribution."""
    context = spark.sparkContext
    if getattr(context, "_pulseline_shipped", False):
        return
    root = Path(pulseline.__file__).parent
    archive = Path(SparkFiles.getRootDirectory(), f"package-{os.urandom(4).hex()}", "pulseline_package.zip")
    archive.parent.mkdir(parents=True)
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._pulseline_shipped = True


def shipped(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage whose first argument is the session, after `ship_package`."""
    @wraps(fn)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship_package(spark)
        return fn(spark, *args)

    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once to the shared scratch folder and read back: later steps neither compute it
    again nor lose it with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def making_room(df: DataFrame, *names: str) -> DataFrame:
    """The input without columns that an operator is about to add, whatever their case."""
    added = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in added))


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text each; a longer text stands alone."""
    size = np.nan_to_num(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False)).astype(np.int64)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code of each word, first word of each text (one entry more than texts), distinct words.

    A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), ends[bounds - bounds[0]], coded.dictionary


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task and run: the sum of a mixed value for
    each byte with its place, mixed once more with the length."""
    raw = words.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    length = np.diff(bounds)
    place = np.arange(len(own)) - np.repeat(bounds[:-1] - bounds[0], length)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((place.astype(np.uint64) << np.uint64(8)) + own + np.uint64(0x9E37)))])
    ends = bounds - bounds[0]
    return mix(sums[ends[1:]] - sums[ends[:-1]] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of `size` words, and the first run of each text.

    A text with fewer words, but at least one, has a single shorter run of all its words.
    """
    n = np.diff(starts)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(starts[:-1], count)
    width = np.repeat(np.minimum(n, size), count)
    out = mix(width.astype(np.uint64))
    padded = np.concatenate([word_hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        out = np.where(k < width, mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]), out)
    return out, first


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of an id as text, by a modulus; 0 for a null id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def id_remainders(ids: pa.Array, modulus: int) -> np.ndarray:
    """`id_remainder` for an Arrow array."""
    return np.array([0 if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids.to_pylist()], np.int64)
