"""Best-fit packing of token sequences, large items first.

Items above a third of the capacity fit at most twice into one sequence, so they are matched in
pairs: the largest with the largest that still fits, which leaves as few sequences as any matching.
Smaller items, largest first, go into the smallest remaining gap that holds them.

Lengths are whole numbers up to the capacity, so the packing of all items follows from one count for
each length. The plan is made of recipes, each for many sequences that look alike; its size depends
on the capacity, not on the number of items. Every item then finds its place by its rank among the
items of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseline.llm.chunk_encoder import chunk_encoder
from pulseline.llm.common import making_room, pieces, schema_text, stored

CAPACITY = 2048
PIECE_BYTES = 8 << 20
#: Ranks below 2 ** RANK_BITS and capacities below 2 ** 17 share one sorted key.
RANK_BITS = 45


@dataclass
class Recipe:
    """So many sequences, each with the given items: (length, how often), from offset 0 on."""

    copies: int
    items: list[tuple[int, int]] = field(default_factory=list)


def _matched(counts: dict[int, int], capacity: int) -> list[Recipe]:
    """Pairs and single ones of the lengths above a third of the capacity."""
    left = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    order = sorted(left, reverse=True)
    out = []
    for k, a in enumerate(order):
        for b in order[k:]:
            if not left[a]:
                break
            if a + b > capacity or not left[b]:
                continue
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if pairs:
                out.append(Recipe(pairs, [(a, 2)] if a == b else [(a, 1), (b, 1)]))
                left[a] -= pairs
                left[b] -= pairs
        if left[a]:
            out.append(Recipe(left[a], [(a, 1)]))
            left[a] = 0
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Recipe]:
    """Recipes that hold `counts` items of each length from 1 to the capacity."""
    done = _matched(counts, capacity)
    open_: list[list[Recipe]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # a bit for each gap that some recipe has

    def keep(recipe: Recipe, gap: int) -> None:
        nonlocal gaps
        open_[gap].append(recipe)
        gaps |= 1 << gap

    for recipe in done:
        keep(recipe, capacity - sum(n * times for n, times in recipe.items))
    for n in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
        rest = counts[n]
        while rest:
            fitting = gaps >> n
            if not fitting:  # new sequences: full ones and one for what remains
                keep(Recipe(-(-rest // (capacity // n))), capacity)
                continue
            gap = n + (fitting & -fitting).bit_length() - 1
            recipe = open_[gap].pop()
            if not open_[gap]:
                gaps ^= 1 << gap
            most = gap // n
            full = min(recipe.copies, rest // most)
            if full:
                keep(Recipe(full, [*recipe.items, (n, most)]), gap - n * most)
                rest -= full * most
            others = recipe.copies - full
            if others and rest:
                keep(Recipe(1, [*recipe.items, (n, rest)]), gap - n * rest)
                others, rest = others - 1, 0
            if others:
                keep(Recipe(others, recipe.items), gap)
    return [r for same in open_ for r in same if r.items]


def layout(recipes: list[Recipe]) -> np.ndarray:
    """Rows (length, first rank, items of this length in a sequence, first sequence, offset), sorted
    by length and rank: the items of a length take the places of the recipes in turn."""
    rows, taken, sequence = [], {}, 0
    for recipe in recipes:
        offset = 0
        for n, times in recipe.items:
            rows.append((n, taken.get(n, 0), times, sequence, offset))
            taken[n] = taken.get(n, 0) + recipe.copies * times
            offset += n * times
        sequence += recipe.copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def numbered(df: DataFrame, length: str = "length") -> DataFrame:
    """Add part (the number of the task) and place (how many rows of the same length the task has
    seen before). Both are the task's own, so the result must be written before it is used twice."""
    df = making_room(df, "part", "place").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            place = places(batch[length].to_numpy(), seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return df.mapInArrow(run, f"{schema_text(df)}, place long")


def places(lengths: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """How many items of the same length came before each one; `seen` is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    values, first, count = np.unique(lengths[order], return_index=True, return_counts=True)
    out = np.empty(len(lengths), np.int64)
    base = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
    out[order] = np.arange(len(lengths)) - np.repeat(first - base, count)
    seen.update(zip(values.tolist(), (base + count).tolist(), strict=True))
    return out


def cut(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """The pieces of each whole text (null: empty) with `end_id` behind it: part, `key`, piece, start
    (ids of the document before it), length, ids (packed little-endian 32-bit), place.

    A document of more than `capacity` ids is cut into pieces of that many; only the first may be
    shorter. Every row is a document of its own, repeated and null keys too; a text without words
    still has the end id. Other columns are dropped. Write the result before it is packed.
    """
    types = dict(docs.dtypes)
    given = docs.select(F.spark_partition_id().alias("part"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"part int, `{key}` {types[key]}, piece int, start long, length long, ids binary, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = chunk_encoder(tokenizer_path), {}
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                ids, n = encoder.encode(part["_text"])
                ids = np.insert(ids, np.cumsum(n), np.int32(end_id))
                n += 1
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = (n - (count - 1) * capacity)[row]
                length = np.where(piece == 0, head, capacity)
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                bounds = pa.array(4 * np.concatenate([[0], np.cumsum(length)]), pa.int32())
                raw = pa.Array.from_buffers(pa.binary(), len(row), [None, bounds.buffers()[1], pa.py_buffer(ids.astype("<i4").tobytes())])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part["part"].take(at), part["_key"].take(at), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                     raw, pa.array(places(length, seen))],
                    names=["part", key, "piece", "start", "length", "ids", "place"],
                )

    return given.mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add sequence_id (from 0, gapless) and offset (place in the sequence) to stored items with the
    columns part and place of `numbered` or `cut`, which go; lengths from 1 to the capacity.

    The driver gets one count for each length. Ranks need one count for each task and length; the
    items are joined to these by both, so a length that all items share is still dealt by task.
    """
    counts = stored(items.groupBy("part", F.col(length).cast("long").alias("_n")).agg(F.count("*").alias("_c")), "packing-counts")
    total = {r._n: r._c for r in counts.groupBy("_n").agg(F.sum("_c").alias("_c")).collect()}
    if bad := [n for n in total if n is None or not 0 < n <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    table = layout(plan(total, capacity))
    keys = (table[:, 0] << RANK_BITS) + table[:, 1]
    before = Window.partitionBy("_n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("part").alias("_part"), "_n", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    ranked = items.join(bases, (F.col("part") == F.col("_part")) & (F.col(length) == F.col("_n")))
    rest = [c for c in items.columns if c.lower() not in ("part", "place", "sequence_id", "offset")]
    ranked = ranked.select(*(f"`{c}`" for c in rest), "_n", (F.col("_base") + F.col("place")).alias("_rank"))
    own = ranked.select(*(f"`{c}`" for c in rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch["_n"].to_numpy(), batch["_rank"].to_numpy()
            row = table[np.searchsorted(keys, (n << RANK_BITS) + rank, side="right") - 1]
            copy, k = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in rest), pa.array(row[:, 3] + copy), pa.array(row[:, 4] + k * n)],
                names=[*rest, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{schema_text(own)}, sequence_id long, offset long")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """sequence_id, n_tokens and the ids of each whole sequence in the order of offsets."""
    items = F.sort_array(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))
    joined = packed.groupBy("sequence_id").agg(items.alias("items")).select(
        "sequence_id", F.expr("aggregate(items, X'', (a, x) -> concat(a, x.ids))").alias("ids")
    )
    return joined.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def packed_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """`cut` and `pack` in one: the stored pieces of all documents with their ids and places."""
    return pack(stored(cut(docs, tokenizer_path, end_id, capacity), "packing-pieces", compression="zstd"), capacity)
