"""Token-id files: Parquet list columns with dictionary or delta encoding and small pages.

Documents are range-partitioned by id, encoded in that order, and written with one row per
document. Row groups and pages are small and Parquet's page index is kept, so a reader that asks
for some documents, or only for lengths and metadata, touches few pages. The place of a document
in the whole token stream is its place in its part plus the length of all parts before it, which
a small side table holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseline.llm.chunk_encoder import gathered
from pulseline.llm.common import pieces, words_of

#: A word that stands between words while they are encoded together.
MARK = "\x01"
#: Latin letters and closing punctuation: every tokenizer of this kind lower-cases the letters one by
#: one and cuts before the punctuation, so both parts can be encoded alone.
LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
CLOSING = ".,:;!?"
#: Words whose ids a task keeps; longer ones than KEPT_CHARS are never kept.
KEPT, KEPT_CHARS = 400_000, 32
PIECE = 8 << 20


class WordEncoder:
    """Ids of whole texts from a lower-casing tokenizer whose pre-tokens never span white space.

    Such a tokenizer gives a text the ids of its blank-separated words in order. The six ASCII
    blanks are white space to every tokenizer, so only they cut a text here, and a distinct word
    goes through the tokenizers library once as long as it is kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: Their strings are cut out of a text before anything else, so such texts go whole.
        self.special = sorted(t.content for t in self.model.get_added_tokens_decoder().values())
        self.mark = self._ids(MARK)
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no single id for the mark between words")
        self.kept: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, np.int32)

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word, all encoded together."""
        plain = [w for w in words if MARK not in w]
        out = {w: self._ids(w).tobytes() for w in words if MARK in w}
        together = self._ids(f" {MARK} ".join(plain))
        raw = together.tobytes()
        ends = np.append(np.nonzero(together == self.mark[0])[0], len(together)).tolist()
        first = 0
        for word, end in zip(plain, ends, strict=bool(plain)):
            out[word] = raw[4 * first:4 * end]
            first = end + 1
        return out

    def distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        known = self.kept
        new = [w for w in words if w not in known]
        if new:
            fresh = self._fresh(new)
            known = known | fresh if len(known) + len(new) > KEPT else known
            if known is self.kept:
                known.update(fresh)
        packed = list(map(known.__getitem__, words))
        if new and known is self.kept:
            for w in new:
                if len(w) > KEPT_CHARS:
                    del known[w]
        return np.frombuffer(b"".join(packed), np.int32), np.fromiter(map(len, packed), np.int64, len(packed)) // 4

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, list[str]]:
        """For each word the numbers of its two parts (the second may be empty), and all parts."""
        stems = pc.utf8_rtrim(words, CLOSING)
        plain = pc.match_substring_regex(stems, LETTERS)
        stems = pc.if_else(plain, pc.utf8_lower(stems), words)
        cut = np.nonzero((pc.binary_length(words).to_numpy() - pc.binary_length(stems).to_numpy()) > 0)[0]
        behind = [w[len(w.rstrip(CLOSING)):] for w in words.take(pa.array(cut)).to_pylist()]
        tails = ["", *dict.fromkeys(behind)]
        number = {t: k for k, t in enumerate(tails)}
        stems = stems.dictionary_encode()
        codes = np.stack([stems.indices.to_numpy().astype(np.int64), np.full(len(words), len(stems.dictionary))], axis=1)
        codes[cut, 1] += np.array([number[t] for t in behind], np.int64)
        return codes, [*stems.dictionary.to_pylist(), *tails]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by `end_id`, and how many each has: those
        of the library's plain call, which takes the strings of special tokens for these tokens."""
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        codes, starts, words = words_of(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        pair, parts = self._parts(words) if len(words) else (np.zeros((0, 2), np.int64), [])
        own, counts = self.distinct(parts) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        own, counts = np.append(own, np.int32(end_id)), np.append(counts, 1)
        # two parts for each word, then the end of each text
        flat = np.insert(pair[codes].ravel(), 2 * starts[1:], len(parts))
        ids, before = gathered(own, counts, flat)
        n = np.diff(before[2 * starts + np.arange(len(starts))])
        if odd.any():
            whole = [np.append(self._ids(t), np.int32(end_id)) for t in texts.filter(pa.array(odd)).to_pylist()]
            ends = np.cumsum(n)[odd]
            ids = np.delete(ids, ends - 1)  # the ends that stand for whole texts
            n[odd] = 0
            at = np.cumsum(n)[odd]
            n[odd] = [len(w) for w in whole]
            ids = np.insert(ids, np.repeat(at, n[odd]), np.concatenate(whole))
        return ids, n


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, which keeps it from task to task."""
    return WordEncoder(path)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, text: str = "text", key: str = "doc_id",
    meta: tuple[str, ...] = (), encoding: str = "delta", row_group_bytes: int = 8 << 20, page_rows: int = 512,
    page_bytes: int = 256 << 10, tasks: int | None = None,
) -> None:
    """Encode whole texts (null: empty), append `end_id` to each, and write them by ascending key.

    Rows with equal keys are ordered by a hash of their text; null keys come first. `encoding` is
    "delta" (delta-packed pages, format version 2) or "dictionary". `meta` columns are kept beside
    the tokens. Columns written: part, place (ids before the document in its part), `key`,
    n_tokens, ids, and `meta`. An empty input writes an empty table.
    """
    own = {"part", "place", "n_tokens", "ids"}
    if clash := own & {key, *meta}:
        raise ValueError(f"rename the columns {sorted(clash)} of the input first")
    spark = docs.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        docs.select(key, *meta, F.col(text).alias("_text"), F.xxhash64(text).alias("_tie"))
        .repartitionByRange(n, key, "_tie").sortWithinPartitions(key, "_tie")
        .select(F.spark_partition_id().alias("part"), key, *meta, "_text")
    )
    types = dict(placed.dtypes)
    schema = ", ".join(
        ["part int", "place long", f"`{key}` {types[key]}", "n_tokens long", "ids array<int>"]
        + [f"`{m}` {types[m]}" for m in meta]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = word_encoder(tokenizer_path), 0
        for batch in batches:
            for part in pieces(batch, "_text", PIECE):
                flat, count = encoder.encode(part["_text"], end_id)
                ends = np.concatenate([[0], np.cumsum(count)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                columns = [part["part"], pa.array(place + ends[:-1]), part[key], pa.array(count), ids]
                names = ["part", "place", key, "n_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([*columns, *(part[m] for m in meta)], names=[*names, *meta])
                place += int(ends[-1])

    placed.mapInArrow(run, schema).write.options(**{
        "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0",
        "parquet.enable.dictionary": "false" if encoding == "delta" else "true",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }).parquet(path)


def part_bases(files: DataFrame) -> DataFrame:
    """Ids before each part, from the lengths alone: 12 bytes for each written part, so their
    number is bounded by the writing job's tasks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    return totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",), where=None) -> DataFrame:
    """Documents with their start in the token stream and the asked columns; a condition on the
    key or on metadata reaches the row groups and pages."""
    files = spark.read.parquet(path)
    bases = part_bases(files)
    kept = files if where is None else files.filter(where)
    key = files.columns[2]
    return kept.join(F.broadcast(bases), "part").select(
        key, (F.col("_base") + F.col("place")).alias("start"), "n_tokens", *columns
    )


def with_crc(df: DataFrame, ids: str = "ids", into: str = "ids_crc32") -> DataFrame:
    """Replace an id list by the crc32 of its ids as little-endian unsigned 32-bit integers."""
    rest = [c for c in df.columns if c != ids]
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in rest), f"`{into}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[ids]
            raw = memoryview(lists.flatten().to_numpy().astype("<u4").tobytes())
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(count)]) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(crc, pa.int64())], names=[*rest, into])

    return df.mapInArrow(run, schema)
