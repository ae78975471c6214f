"""Benchmark decontamination by SimHash windows and a multi-index of Hamming blocks.

Fingerprints: 64 bits, the signs of the sums of +-weight per bit over the words of a window, where
longer words weigh more. Window sizes are a ladder. An item is represented by its own windows of
the largest ladder size within four fifths of it, at its start, middle and end, so an edit near an
edge leaves one of them whole; items that an edit anywhere else can leave above the threshold also
have windows of less than half their size at both ends, one of which misses any single edit. Every
position of every text gets a window of every ladder size.

Search: a fingerprint is cut into BLOCKS blocks. If two fingerprints differ in at most RADIUS bits,
some block differs in at most RADIUS // BLOCKS bits, so a table per block that holds each item
block with all its neighbours within that distance finds every pair within RADIUS. Pairs within
RADIUS are verified exactly: the item against the best run of as many words in the document around
the match, by the weighted Jaccard similarity of five-word shingles (counts are the weights).

The benchmark is the query set. It is read in blocks of BLOCK_ITEMS items (a proven bound for what
goes to every task) and every block meets all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulseline.llm.common import hashes_of, pieces, shingle_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
BITS, BLOCKS, RADIUS = 64, 4, 7
LADDER = 1.5
#: Least words of an item that stays above THRESHOLD with an edit at its edges, and anywhere.
EDGES, ANYWHERE = 13, 49
BLOCK_ITEMS = 5_000
#: Bytes of text that a task cuts into words at once, and words that it fingerprints at once.
PIECE_TEXT, SPAN = 4 << 20, 50_000


def normal(words: pa.Array) -> pa.Array:
    return pc.utf8_lower(words)


def bit_weights(words: pa.Array) -> np.ndarray:
    """One row of 64 signed weights for each word: its hash bits as +-w, w by the word's length."""
    bits = np.unpackbits(hashes_of(words).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    weight = (1 + (length > 3) + (length > 6)).astype(np.int8)
    return (2 * bits - 1) * weight[:, None]


def running(signed: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Running sums per bit. They may wrap around 16 bits: only differences over one window,
    which are small, are ever used."""
    sums = np.zeros((len(codes) + 1, BITS), np.int16)
    np.cumsum(signed[codes], axis=0, dtype=np.int16, out=sums[1:])
    return sums


def window_prints(sums: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of `size` words at all positions, as four 16-bit blocks."""
    signs = (sums[size:] - sums[:-size]) > 0
    return np.packbits(signs, axis=1).view(np.uint16)


def window_sizes(n: int) -> list[tuple[int, bool]]:
    """The most words that the windows of an item of n words may have, and whether one in the
    middle is wanted.

    One edited word changes as many shingles as its place from the nearer edge, five at most. It
    leaves (m - d) / (m + d) of m = n - 4 shingles, so THRESHOLD allows d <= m / 9: no edit below
    13 words, edits at the edges only below 49.
    """
    if n < EDGES:
        return [(n, False)]
    return [(n * 4 // 5, True), *([((n - 1) // 2, False)] if n >= ANYWHERE else [])]


def ladder(sizes: list[int]) -> list[int]:
    """Window sizes from the smallest on, each LADDER times the one before at most."""
    out, size = [], min(sizes)
    while size <= max(sizes):
        out.append(size)
        size = max(size + 1, int(size * LADDER))
    return out


def neighbours(distance: int) -> np.ndarray:
    """All 16-bit masks with at most so many bits set."""
    masks = [sum(1 << b for b in c) for k in range(distance + 1) for c in combinations(range(16), k)]
    return np.array(masks, np.uint16)


@dataclass
class Rung:
    size: int
    prints: np.ndarray  # fingerprints of the items' windows, as uint64
    item: np.ndarray  # which item each belongs to
    offset: np.ndarray  # where in the item the window starts
    tables: list[np.ndarray]  # per block: for each 16-bit value, first entry in `members` (and end)
    members: list[np.ndarray]
    present: list[np.ndarray]


class Index:
    """The multi-index of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        codes, starts, words = words_of(pa.array([t for _, t in items], pa.string()))
        words = normal(words)
        signed, hashed = bit_weights(words), hashes_of(words)
        self.ids = [i for i, _ in items]
        self.n = np.diff(starts)
        self.shingles: list[Counter] = []
        for k in range(len(items)):
            own = hashed[codes[starts[k]:starts[k + 1]]]
            self.shingles.append(Counter(shingle_hashes(own, np.array([0, len(own)]), SHINGLE)[0].tolist()))
        wanted = [(k, most, middle) for k, n in enumerate(self.n.tolist()) if n for most, middle in window_sizes(n)]
        self.rungs: list[Rung] = []
        steps = ladder([most for _, most, _ in wanted]) if wanted else []
        masks = neighbours(RADIUS // BLOCKS)
        for size, above in zip(steps, [*steps[1:], 1 << 40], strict=True):
            prints, item, offset = [], [], []
            for k, _, middle in (x for x in wanted if size <= x[1] < above):
                sums = running(signed, codes[starts[k]:starts[k + 1]])
                spare = int(self.n[k]) - size
                for at in sorted({0, *([spare // 2] if middle else []), spare}):
                    prints.append(window_prints(sums[at:at + size + 1], size)[0])
                    item.append(k)
                    offset.append(at)
            if not prints:
                continue
            blocks = np.array(prints, np.uint16)
            rung = Rung(size, np.ascontiguousarray(blocks).view(np.uint64)[:, 0], np.array(item), np.array(offset), [], [], [])
            for b in range(BLOCKS):
                value = (blocks[:, b, None] ^ masks[None, :]).ravel().astype(np.int64)
                order = np.argsort(value, kind="stable")
                rung.members.append((order // len(masks)).astype(np.int64))
                rung.tables.append(np.searchsorted(value[order], np.arange(65537)))
                present = np.zeros(65536, bool)
                present[value] = True
                rung.present.append(present)
            self.rungs.append(rung)

    def candidates(self, sums: np.ndarray, starts: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(word position where the item would start, item, Hamming distance, text) for every
        window, counted from word `low` on, whose fingerprint lies within RADIUS of an item's."""
        total = len(sums) - 1
        for rung in self.rungs:
            if total < rung.size:
                continue
            prints = window_prints(sums, rung.size)
            whole = np.ascontiguousarray(prints).view(np.uint64)[:, 0]
            for b in range(BLOCKS):
                near = np.nonzero(rung.present[b][prints[:, b]])[0]
                if not len(near):
                    continue
                value = prints[near, b].astype(np.int64)
                first = rung.tables[b][value]
                count = rung.tables[b][value + 1] - first
                window = np.repeat(near, count)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                entry = rung.members[b][at]
                away = np.bitwise_count(whole[window] ^ rung.prints[entry]).astype(np.int64)
                keep = away <= RADIUS
                window, entry, away = window[keep], entry[keep], away[keep]
                window = window + low
                # a window that runs over a text's end belongs to none
                own = np.searchsorted(starts, window, side="right") - 1
                keep = window + rung.size <= starts[own + 1]
                if keep.any():
                    yield (window - rung.offset[entry])[keep], rung.item[entry][keep], away[keep], own[keep]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def best_run(hashed: np.ndarray, at: int, n: int, item: Counter) -> tuple[float, int]:
    """The most similar run of n words whose start lies within n // 4 words of `at`."""
    slack = max(1, n // 4)
    best = (0.0, max(0, at))
    low, high = max(0, at - slack), max(0, min(len(hashed) - n, at + slack))
    if len(hashed) < n:
        low, high = 0, 0
    span = hashed[low:high + n]
    size = min(SHINGLE, n)
    grams = shingle_hashes(span, np.array([0, len(span)]), size)[0].tolist()
    width = max(1, min(n, len(span)) - size + 1)
    for k in range(high - low + 1):
        own = Counter(grams[k:k + width])
        found = weighted_jaccard(own, item)
        if found > best[0]:
            best = (found, low + k)
    return best


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
            item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each (document, item) found: key, item key, similarity, start_word, n_words,
    hamming (the smallest distance seen), over whole texts.

    A document is contaminated by an item if a run of as many words as the item has a weighted
    five-word-shingle similarity of 0.8 or more (words compared in lower case). Null or empty
    texts and items without words match nothing; items of fewer than five words must match
    exactly. A text shorter than the item by one in four words or more cannot match it. Repeated
    rows give repeated results; other columns of the inputs are not read. Null ids pass through.
    """
    key_type, item_type = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item_key]
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).filter(
        F.length(F.coalesce("text", F.lit(""))) > 0
    )
    schema = (
        f"`{key}` {key_type}, `{item_key}` {item_type}, similarity double, start_word long, n_words long, hamming int"
    )
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = None
    for block in item_blocks(rows):
        index = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "_text", PIECE_TEXT):
                    yield scan(part, index.value, key, item_key, item_type)

        own = slim.mapInArrow(run, schema)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else spark.createDataFrame([], schema)


def item_blocks(rows: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, BLOCK_ITEMS at a time: the driver holds one block, never the whole table."""
    block: list[tuple[int, str]] = []
    for row in rows.toLocalIterator():
        block.append((row["item"], row["text"]))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def scan(part: pa.RecordBatch, index: Index, key: str, item_key: str, item_type: str) -> pa.RecordBatch:
    codes, starts, words = words_of(part["_text"])
    words = normal(words)
    best: dict[tuple[int, int], tuple[int, set[int]]] = {}
    if len(codes) and index.rungs:
        signed, reach = bit_weights(words), index.rungs[-1].size
        for low in range(0, len(codes), SPAN):  # spans overlap by the largest window
            sums = running(signed, codes[low:low + SPAN + reach])
            for at, item, away, own in index.candidates(sums, starts, low):
                for a, i, h, d in zip(at.tolist(), item.tolist(), away.tolist(), own.tolist(), strict=True):
                    least, places = best.get((d, i), (BITS, set()))
                    places.add(a)
                    best[d, i] = (min(least, h), places)
    out: list[tuple] = []
    if best:
        hashed = hashes_of(words)
        for (d, i), (least, places) in sorted(best.items()):
            own, n = hashed[codes[starts[d]:starts[d + 1]]], int(index.n[i])
            top, done = (0.0, 0), None
            for a in sorted(places):
                if done is not None and a - done <= max(1, n // 8):
                    continue  # its runs were compared with the place before
                done = a
                top = max(top, best_run(own, a - int(starts[d]), n, index.shingles[i]), key=lambda x: x[0])
            if top[0] >= THRESHOLD:
                out.append((d, index.ids[i], top[0], top[1], n, least))
    rows = pa.array([o[0] for o in out], pa.int64())
    column = lambda k, kind: pa.array([o[k] for o in out], kind)
    ids = pa.array([o[1] for o in out], pa.int64() if item_type == "bigint" else None)
    return pa.RecordBatch.from_arrays(
        [part["_key"].take(rows), ids, column(2, pa.float64()), column(3, pa.int64()), column(4, pa.int64()), column(5, pa.int32())],
        names=[key, item_key, "similarity", "start_word", "n_words", "hamming"],
    )


def without(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that no item contaminates. The key should tell rows apart: rows with a null key
    all stay, and rows that share a key go together."""
    return docs.join(found.select(key).distinct(), key, "left_anti")
