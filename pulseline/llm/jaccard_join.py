"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Every text becomes its set of five-word shingles; equal sets are one node (a class of copies).
2. Nodes meet in bands of their MinHash values. Buckets with the same members are kept once.
3. Inside a bucket, pairs are compared a few MinHash values at a time. With a uniform prior, the
   posterior probability that a pair with m of n equal values reaches the threshold is a binomial
   tail; a pair is dropped as soon as it falls below TOLERANCE. Only a spanning forest of the pairs
   that survive leaves the task, so rows stay linear in the members.
4. Connected survivors form candidate components. Each node's text goes to its component once per
   block of BLOCK nodes, survivors are verified with exact set sizes, and the task returns each
   node's number of links and a spanning forest of the true links.
Large buckets and components are cut into pairs of blocks, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseline.llm.common import hashes_of, mix, pieces, shingle_hashes, stored, words_of

SHINGLE, THRESHOLD = 5, (4, 5)  # a similarity of 4/5 or more, as integers
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
#: A band misses a pair at the threshold with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
STEP, TOLERANCE = 16, 1e-7
BLOCK = 256
PAIRS_AT_ONCE = 100_000


def seeds() -> np.ndarray:
    return mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_matches() -> list[tuple[int, int]]:
    """(n, m): after n compared values a pair needs m equal ones, or its posterior probability of
    a similarity of 0.8 or more is below TOLERANCE: the tail sum of Binomial(n + 1, 0.8) up to m."""
    top, bottom = THRESHOLD
    t = top / bottom
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < TOLERANCE:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words compare as they are written."""
    codes, starts, words = words_of(texts)
    grams, first = shingle_hashes(hashes_of(words)[codes] if len(codes) else np.zeros(0, np.uint64), starts, SHINGLE)
    return [np.unique(grams[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES MinHash values of each non-empty set, 32 bits each."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint32)
    for k, seed in enumerate(seeds()):
        spread = (flat * seed) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(spread, starts)
    return out


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored: id, text, mark (unique), node (128-bit digest of the shingle set; null without words), bands, sig
    (the low 16 bits of each MinHash value)."""
    import xxhash

    kind = dict(docs.dtypes)[key]
    schema = f"id {kind}, text string, mark long, node binary, bands array<long>, sig binary"
    weights = mix(np.arange(1, VALUES + 1, dtype=np.uint64) ^ np.uint64(0xC2B2AE3D27D4EB4F)).reshape(BANDS, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part["text"])
                full = [i for i, s in enumerate(sets) if len(s)]
                node, bands, sig = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    values = signatures([sets[i] for i in full])
                    wide = mix(values.astype(np.uint64).reshape(len(full), BANDS, ROWS) * weights)
                    keys = mix(wide.sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                    short = values.astype(np.uint16)
                    for row, i in enumerate(full):
                        node[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                        bands[i], sig[i] = keys[row], short[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["text"], part["mark"], pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                     pa.array(sig, pa.binary())], names=["id", "text", "mark", "node", "bands", "sig"],
                )

    marked = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("mark"))
    return stored(marked.mapInArrow(run, schema), "jaccard-sketch")


def in_blocks(members: DataFrame, group: str, n: str) -> DataFrame:
    """Members of each group, dealt to pairs of blocks: low, high, side (0: of the low block).

    A group of up to BLOCK members has the single pair (0, 0). In a pair of two blocks only pairs
    across count, so every pair of members is met exactly once.
    """
    blocks = F.ceil(F.col(n) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    each = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return each.withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other")).withColumn(
        "side", (F.col("_own") != F.col("low")).cast("int")
    ).drop("_own", "_other").repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", "side", "node")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches that end where a group of the sorted input ends, and their groups' bounds."""
    held = None
    for batch in batches:
        both = batch if held is None else pa.concat_batches([held, batch])
        n = both.num_rows
        if not n:
            continue
        change = np.zeros(n - 1, bool)
        for key in keys:
            column = both[key]
            if pa.types.is_integer(column.type):
                values = column.to_numpy()
                change |= values[1:] != values[:-1]
            else:
                values = column.to_pylist()
                change |= np.fromiter((a != b for a, b in zip(values[1:], values, strict=False)), bool, n - 1)
        bounds = [0, *(np.nonzero(change)[0] + 1).tolist()]
        if len(bounds) > 1:
            yield both.slice(0, bounds[-1]), bounds
        held = both.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def pairs_of(bounds: list[int], low: np.ndarray, high: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups, at most about PAIRS_AT_ONCE together."""
    last = np.repeat(bounds[1:], np.diff(bounds))
    count = last - np.arange(bounds[-1]) - 1
    ends, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        own = count[at:to]
        a = np.repeat(np.arange(at, to), own)
        b = a + 1 + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        keep = (low[a] == high[a]) | (side[a] != side[b])
        yield a[keep], b[keep]
        at = to


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that keep a posterior probability of TOLERANCE or more through all steps."""
    equal = np.zeros(len(a), np.int64)
    for n, least in least_matches():
        equal = equal + (sig[a, n - STEP:n] == sig[b, n - STEP:n]).sum(axis=1)
        keep = equal >= least
        a, b, equal = a[keep], b[keep], equal[keep]
    return a, b


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _unite(parent: list[int], a: np.ndarray, b: np.ndarray) -> None:
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = _root(parent, x), _root(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def _columns(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint16).reshape(part.num_rows, VALUES)
    return sig, part["low"].to_numpy(), part["high"].to_numpy(), part["side"].to_numpy()


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of the surviving pairs of all buckets."""
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    shape = dealt.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.sum(F.hash("node").cast("long")).alias("_s")
    ).filter("n > 1")
    kept = shape.groupBy("n", "_x", "_s").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = dealt.join(kept, "bucket").join(nodes.select("node", "sig"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in whole_groups(batches, ["bucket", "low", "high"]):
            sig, low, high, side = _columns(part)
            parent = list(range(part.num_rows))
            for a, b in pairs_of(bounds, low, high, side):
                _unite(parent, *survivors(sig, a, b))
            root = np.array([_root(parent, x) for x in parent])
            leaf = np.nonzero(root != np.arange(len(root)))[0]
            node = part["node"]
            yield pa.RecordBatch.from_arrays([node.take(pa.array(leaf)), node.take(pa.array(root[leaf]))], names=["a", "b"])

    placed = in_blocks(members, "bucket", "n").select("bucket", "low", "high", "side", "node", "sig")
    return placed.mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge (a, b).

    Alternating stars: neighbours of a node move to the least node around it, first the greater
    ones, then the smaller ones. Only minima are aggregated, so a hub needs no task for itself;
    every round is written and its checksum compared with the round before.
    """
    def star(pairs: DataFrame) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("_m"))
        moved = large.join(down, "a").filter("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        return moved.unionByName(down.withColumnRenamed("_m", "b")).distinct()

    def checksum(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = stored(edges.filter("a != b"), "component-edges")
    before = checksum(now)
    while before[0]:
        now = stored(star(now), "component-edges")
        after = checksum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the sets of all given pairs."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, place = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(place) > 1
    column = np.cumsum(often) - 1
    keep = often[place]
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(often.sum()), 4096):
        low, high = np.searchsorted(place, [first, first + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[low:high], place[low:high] - first] = 1
        total += block @ block.T
    del grams
    return total[a, b].astype(np.int64)


def verified(members: DataFrame) -> DataFrame:
    """Per node and pair of blocks: texts and docs that it links to there, and its local root."""
    schema = "node binary, root binary, blocks long, texts long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, bottom = THRESHOLD
        for part, bounds in whole_groups(batches, ["root", "low", "high"]):
            for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                own = part.slice(first, last - first)
                n = own.num_rows
                sig, low, high, side = _columns(own)
                weight, sets = own["docs"].to_numpy(), shingle_sets(own["text"])
                size = np.array([len(s) for s in sets])
                parent, texts, docs = list(range(n)), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for a, b in pairs_of([0, n], low, high, side):
                    a, b = survivors(sig, a, b)
                    if len(a):
                        both = overlaps(sets, a, b)
                        link = bottom * both >= top * (size[a] + size[b] - both)
                        a, b = a[link], b[link]
                        for x, y in ((a, b), (b, a)):
                            np.add.at(texts, x, 1)
                            np.add.at(docs, x, weight[y])
                        _unite(parent, a, b)
                root = pa.array([_root(parent, x) for x in range(n)])
                yield pa.RecordBatch.from_arrays(
                    [own["node"], own["node"].take(root), own["blocks"], pa.array(texts), pa.array(docs)],
                    names=["node", "root", "blocks", "texts", "docs"],
                )

    placed = in_blocks(members, "root", "n").select(
        "root", "low", "high", "side", "node", "sig", "docs", "text", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")
    )
    return placed.mapInArrow(run, schema)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id (the least key of all documents connected to it by
    links of similarity 0.8 or more), n_links (other documents it links to, copies included) and
    n_text_links (different shingle sets it links to).

    Texts of one to four words are one shingle. Null, empty and blank texts link to nothing and
    are classes of their own. Repeated rows count as documents. Null keys come through; a class of null keys alone
    has a null id. Other columns are not read.
    """
    rows = sketch(docs, key, text)
    nodes = stored(
        rows.filter("node is not null").groupBy("node").agg(
            F.count("*").alias("docs"), F.min("id").alias("least"), F.min("mark").alias("mark"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
        ), "jaccard-nodes",
    )
    found = components(candidate_edges(nodes))
    sizes = found.groupBy("root").agg(F.count("*").alias("n"))
    # One row stands for a node, and its mark fetches the text: copies of one text never meet in a task.
    # The side grows with the corpus, so it is never broadcast, on small inputs either.
    members = found.join(sizes, "root").join(nodes.select("node", "docs", "sig", "mark"), "node")
    members = rows.select("mark", "text").join(members.hint("merge"), "mark").drop("mark")
    links = stored(verified(members), "jaccard-links")
    split = links.filter("blocks > 1 AND node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    joined = components(split)
    degree = links.groupBy("node").agg(
        F.sum("texts").alias("texts"), F.sum("docs").alias("linked"),
        F.min(F.when(F.col("blocks") == 1, F.col("root"))).alias("_alone"),
    )
    classed = nodes.select("node", "docs", "least").join(degree, "node", "left").join(joined, "node", "left").withColumn(
        "class", F.coalesce("root", "_alone", "node")
    )
    named = classed.join(classed.groupBy("class").agg(F.min("least").alias("class_id")), "class").select(
        "node", "class_id", (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("_links"), F.coalesce("texts", F.lit(0)).alias("_texts"),
    )
    # Rows without words join nothing; all their null nodes would be one partition.
    blank = rows.filter("node is null").select(F.col("id").alias(key), F.col("id").alias("class_id"), *(
        F.lit(0).cast("long").alias(n) for n in ("n_links", "n_text_links")))
    return rows.filter("node is not null").select("id", "node").join(named, "node").select(
        F.col("id").alias(key), "class_id", F.col("_links").cast("long").alias("n_links"), F.col("_texts").cast("long").alias("n_text_links"),
    ).unionByName(blank)
