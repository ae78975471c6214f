"""Hidden Markov language model: Baum-Welch counts from all training texts, exact likelihoods.

Model. A text is its words in order and one end token. A hidden state emits the bucket of a token
(words hash into BUCKETS buckets, the end token has its own), and a word is drawn within its bucket
by its training count, so the tables of the model have a fixed size whatever the vocabulary, and
every word still has its own probability. In each bucket one symbol stands for all words that
training never saw; its weight is one more than the number of words that training saw once there.

Counts. Each piece of PIECE bytes of text becomes one stored row: word codes, distinct words and
their training counts. Words meet over the whole corpus by shuffles only, in shares of the buckets; the counts of a piece's
words come back to it by its number. The vocabulary is never gathered or broadcast.

Training. EM starts from a fixed random model, which no text chooses. Every round runs over all
training texts: forward and backward passes give expected transition and emission counts, which are
added up across partitions. Rounds follow until the gain in likelihood is below GAIN. The texts of a
piece go forward and backward in lockstep, longest first, so a step is one product for all texts that
still have a token. Where few texts are left (see `heads`), the rest is cut into runs of RUN tokens;
transfer matrices carry the forward and backward vectors from run to run, so the counts are those of
the whole texts.

Scoring. The scaled forward recursion over each whole text is exact, by the same lockstep; the
transfer matrices of runs are multiplied in order, which is the same product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulseline.llm.common import hashes_of, id_remainders, pieces, stored, words_of

FOLDS, HELD = 7, 2
STATES, BUCKETS = 8, 65_536
END = BUCKETS
RUN = 64
RUNS_AT_ONCE = 4096
#: Texts go in lockstep while more than so many have a token; one step then costs less than transfer matrices.
FEW = 64
#: Tokens whose state vectors a task holds at once, and steps between two scalings.
TOKENS_AT_ONCE = 1 << 19
EACH = 4
#: Rows of a table of counts that travel as one value.
BLOCK = 1024
#: Training ends when a round gains less than so much log likelihood a token.
GAIN = 1e-3
PIECE = 6 << 20
#: A task counts the words of a share of the buckets; a share is that of the words of about so many pieces.
PIECES_A_SHARE = 8

PIECE_SCHEMA = (
    "piece long, ids array<{id}>, held array<boolean>, starts array<long>, codes binary, words array<string>,"
    " buckets array<int>, counts array<long>"
)


def ascii_lower(words: pa.Array) -> pa.Array:
    """A-Z in lower case, all other characters as they are."""
    upper, lower = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
    table = bytes.maketrans(upper, lower)
    values = words.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    raw = b"" if data is None else data.to_pybytes().translate(table)
    return pa.Array.from_buffers(pa.large_binary(), len(values), [None, offsets, pa.py_buffer(raw)], offset=values.offset).cast(
        pa.large_string()
    )


def packed(codes: np.ndarray) -> bytes:
    """32-bit codes as four planes of bytes: small codes leave planes of zeros, which compress."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64)


def cut_pieces(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored: one row per piece of text, see PIECE_SCHEMA. Words are distinct after lower-casing
    A-Z and ordered by frequency; `counts` counts them in the piece's training texts; codes are
    packed places in `words`."""
    schema = PIECE_SCHEMA.format(id=dict(docs.dtypes)[key])
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                codes, starts, words = words_of(part["text"])
                merged = ascii_lower(words).dictionary_encode() if len(words) else None
                if merged is not None:
                    codes = merged.indices.to_numpy().astype(np.int64)[codes]
                    order = np.argsort(-np.bincount(codes, minlength=len(merged.dictionary)), kind="stable")
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    codes, words = rank[codes], merged.dictionary.take(pa.array(order))
                held = id_remainders(part["id"], FOLDS) == HELD
                learn = np.repeat(~held, np.diff(starts))
                counts = np.bincount(codes[learn], minlength=len(words)) if len(words) else np.zeros(0, np.int64)
                buckets = (hashes_of(words) % np.uint64(BUCKETS)).astype(np.int32) if len(words) else np.zeros(0, np.int32)
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([
                    part["mark"].slice(0, 1),
                    pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["id"]),
                    one(held, pa.bool_()), one(starts, pa.int64()), pa.array([packed(codes)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                    one(buckets, pa.int32()), one(counts, pa.int64()),
                ], names=["piece", "ids", "held", "starts", "codes", "words", "buckets", "counts"])

    return stored(slim.mapInArrow(run, schema), "hmm-pieces", compression="zstd")


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # BUCKETS + 1 x STATES

    @cached_property
    def scaled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Moves and emissions in single precision, which has room for EACH steps of emissions scaled
        to a largest of 1 in each bucket, and the logs of the factors."""
        top = self.emit.max(axis=1)
        return self.move.astype(np.float32), (self.emit / top[:, None]).astype(np.float32), np.log(top)


def normalised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, corpus: np.ndarray) -> Model:
    """Probabilities from expected counts. A state's emissions lean to the corpus' bucket shares
    with as many pseudo-tokens as it has different buckets."""
    usual = emit.sum(axis=0) + 1e-9
    lean = (emit > 0.5).sum(axis=0) + 1
    shares = (emit + lean * corpus[:, None]) / (usual + lean)
    return Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True), shares)


class Room:
    """Arrays that a task uses again for each group of texts; fresh memory would cost more than the passes."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, like: np.ndarray, n: int) -> np.ndarray:
        """n rows for values like the given ones; what they hold is undefined."""
        if len(self.kept.get(name, ())) < n:
            self.kept[name] = np.empty((n, *like.shape[1:]), like.dtype)
        return self.kept[name][:n]


def heads(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each text's head, the number of runs of RUN tokens that follow it, and the first
    token of each run. Heads are whole texts, but for at most FEW whose rest is worth a run."""
    n = np.diff(starts)
    most = max(RUN, int(np.partition(n, -FEW - 1)[-FEW - 1]) if len(n) > FEW else 0)
    per = np.maximum(0, (n - most) // RUN)
    head = n - RUN * per
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return head, per, np.repeat(starts[:-1] + head, per) + RUN * place


def groups(length: np.ndarray, most: int) -> list[np.ndarray]:
    """Numbers of texts, longest first, in groups of about `most` tokens."""
    order = np.argsort(-length, kind="stable")
    return np.split(order, np.nonzero(np.diff((np.cumsum(length[order]) - 1) // most))[0] + 1)


def lockstep(first: np.ndarray, length: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Tokens of texts, longest first, in lockstep: at each place, those of all texts that reach it.
    Where each place begins, and the tokens' numbers."""
    active = np.searchsorted(-length, -np.arange(length[0]))
    begin = np.concatenate([[0], np.cumsum(active)])
    text = np.arange(begin[-1]) - np.repeat(begin[:-1], active)
    return begin.tolist(), first[text] + np.repeat(np.arange(len(active)), active)


def forward(move: np.ndarray, emit: np.ndarray, begin: list[int], first: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Forward vectors of tokens in lockstep (into `share`), from those at the first place before
    emission; log factor of each text. Every EACH places vectors are scaled to a sum of 1, and the
    emissions with them, unless `share` is `emit`."""
    log, ones, last = np.zeros(len(first)), np.ones((STATES, STATES), emit.dtype), 0
    for t, (a, b) in enumerate(zip(begin, begin[1:])):
        now = share[a:b]
        np.multiply(share[last:last + b - a] @ move if t else first, emit[a:b], out=now)
        if t % EACH == EACH - 1:
            scale = now @ ones  # the sum in every column
            now /= scale
            log[:b - a] += np.log(scale[:, 0])
            if share is not emit:
                emit[a:b] /= scale
        last = a
    return log


def backward(move: np.ndarray, emit: np.ndarray, begin: list[int], share: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Turn forward vectors into state shares, from the backward vectors at the texts' last tokens,
    which it uses up. Sums for expected moves within the texts; `emit` then has backward times emission."""
    moves, turned = np.zeros((STATES, STATES)), np.ascontiguousarray(move.T)
    ones = np.ones((STATES, STATES), emit.dtype)
    for t in range(len(begin) - 2, -1, -1):
        a, b = begin[t], begin[t + 1]
        now, own, weighted = back[:b - a], share[a:b], emit[a:b]
        if t % (2 * EACH) == 0:  # against drift
            now /= (own * now) @ ones
        own *= now
        weighted *= now
        if t:
            last = begin[t - 1]
            moves += share[last:last + b - a].T @ weighted
            np.matmul(weighted, turned, out=now)
    return moves


def last_vectors(share: np.ndarray, begin: list[int], length: np.ndarray) -> np.ndarray:
    """Vectors at the last token of each text."""
    return share[np.asarray(begin)[length - 1] + np.arange(len(length))]


def transfers(move: np.ndarray, emit: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transfer matrices of runs, each with the move into it, scaled; log factor of each."""
    seen = np.take(emit, tokens[np.arange(RUN)[:, None] + first], axis=0, mode="clip")
    ones, log = np.ones((STATES, STATES), emit.dtype), np.zeros(len(first))
    matrix = move[:, None, :] * seen[0]
    for t in range(1, RUN):
        matrix = (matrix.reshape(-1, STATES) @ move).reshape(matrix.shape)
        matrix *= seen[t]
        if t % EACH == EACH - 1:
            scale = matrix.sum(axis=0) @ ones
            matrix /= scale
            log += np.log(scale[:, 0])
    return np.ascontiguousarray(matrix.transpose(1, 0, 2)), log


def in_turn(per: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Texts with runs, those with most first, and for each k the numbers of the k-th runs of those that have one."""
    texts = np.argsort(-per, kind="stable")[:np.count_nonzero(per)]
    first, many = (np.cumsum(per) - per)[texts], -per[texts]
    return texts, [first[:np.searchsorted(many, -k)] + k for k in range(int(per.max(initial=0)))]


def expected(model: Model, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over some texts."""
    return counted(model, tokens, starts)[:3]


def counted(
    model: Model, tokens: np.ndarray, starts: np.ndarray, room: Room | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions over some texts, and their log likelihood."""
    room = room or Room()
    move, emit, factors = model.scaled
    log = float(factors @ np.bincount(tokens, minlength=BUCKETS + 1))
    moves, counts = np.zeros((STATES, STATES)), np.zeros((STATES, BUCKETS + 1))

    def passes(begin: list[int], at: np.ndarray, length: np.ndarray, first: np.ndarray, after: np.ndarray):
        """Add up moves, emissions and likelihood; the vectors at the last tokens, the shares, and backward times emission."""
        nonlocal log, moves
        own = tokens[at]
        seen = np.take(emit, own, axis=0, out=room("seen", emit, len(own)), mode="clip")
        share = room("share", emit, len(own))
        factor = forward(move, seen, begin, first, share)
        last = last_vectors(share, begin, length)
        log += float(factor.sum() + np.log(last.sum(axis=1), dtype=np.float64).sum())
        moves += backward(move, seen, begin, share, after / (last * after).sum(axis=1, keepdims=True))
        weights = room("weights", counts[0], len(own))
        for k in range(STATES):
            weights[:] = share[:, k]
            counts[k] += np.bincount(own, weights=weights, minlength=BUCKETS + 1)
        return last, share, seen

    head, per, runs = heads(starts)
    blocks = range(0, len(runs), RUNS_AT_ONCE)
    matrix = np.empty((len(runs), STATES, STATES), np.float32)
    for low in blocks:
        matrix[low:low + RUNS_AT_ONCE] = transfers(move, emit, tokens, runs[low:low + RUNS_AT_ONCE])[0]
    texts, turns = in_turn(per)
    # backward vectors, up to a factor, at the last tokens of runs and heads
    after, beyond = np.ones((len(runs), STATES), np.float32), np.ones((len(head), STATES), np.float32)
    for k, at in reversed(list(enumerate(turns))):
        moved = np.einsum("nij,nj->ni", matrix[at], after[at])
        moved /= moved.max(axis=1, keepdims=True)
        if k:
            after[at - 1] = moved
        else:
            beyond[texts] = moved
    start, ends = np.zeros(STATES), np.empty((len(head), STATES), np.float32)
    for some in groups(head, TOKENS_AT_ONCE):
        begin, at = lockstep(starts[:-1][some], head[some])
        ends[some], share, _ = passes(begin, at, head[some], np.tile(model.start.astype(np.float32), (len(some), 1)), beyond[some])
        start += share[:len(some)].sum(axis=0, dtype=np.float64)
    # forward shares before each run
    now, before = ends[texts], np.empty((len(runs), STATES), np.float32)
    for at in turns:
        now = now[:len(at)] / now[:len(at)].sum(axis=1, keepdims=True)
        before[at] = now
        now = np.einsum("ni,nij->nj", now, matrix[at])
    for low in blocks:
        own = slice(low, low + RUNS_AT_ONCE)
        n = len(runs[own])
        begin, at = [n * t for t in range(RUN + 1)], (np.arange(RUN)[:, None] + runs[own]).ravel()
        weighted = passes(begin, at, np.full(n, RUN), before[own] @ move, after[own])[2]
        moves += before[own].T @ weighted[:n]
    return start, moves * model.move, counts.T, log


def training_tokens(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bucket tokens of a piece's training texts, each closed by END, and their starts."""
    buckets = np.asarray(row["buckets"], np.int64)
    codes = unpacked(row["codes"])
    starts, held = np.asarray(row["starts"]), np.asarray(row["held"], bool)
    tokens, first = with_ends(buckets[codes] if len(codes) else np.zeros(0, np.int64), starts, END)
    n = np.diff(first)
    keep = np.repeat(~held, n)
    return tokens[keep], np.concatenate([[0], np.cumsum(n[~held])])


def with_ends(tokens: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(tokens, starts[1:], end), starts + np.arange(len(starts))


def corpus_counts(table: DataFrame, shares: int) -> DataFrame:
    """Stored: for each piece, in several rows, places of its words and their counts in all training
    texts (words that training never saw are left out). Rows without a piece give for each bucket
    (in `at`) three numbers (in `c`): its tokens, its words, and its words seen once.

    Words meet by shares of the buckets, so a word's rows, one a piece, are in one share. A share
    holds the distinct words of about PIECES_A_SHARE pieces.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, buckets, counts = (batch[name][k].values for name in ("words", "buckets", "counts"))
                if not len(words):
                    continue
                share = buckets.to_numpy().astype(np.int64) * shares // BUCKETS
                order = pa.array(np.argsort(share, kind="stable"), pa.int32())
                some, n = np.unique(share, return_counts=True)
                first = np.append(0, np.cumsum(n))
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), x) for x in (
                    order, words.take(order), buckets.take(order), counts.take(order))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.repeat(batch["piece"][k], len(some)), *lists],
                    names=["share", "piece", "at", "words", "buckets", "counts"])

    def meet(group: pa.Table) -> pa.Table:
        rows = group.combine_chunks()
        words, at, buckets, counts = (rows[name].combine_chunks().flatten() for name in ("words", "at", "buckets", "counts"))
        first = np.append(0, np.cumsum(pc.list_value_length(rows["words"]).to_numpy()))
        coded = words.dictionary_encode()
        code, own = coded.indices.to_numpy(), buckets.to_numpy()
        c = np.bincount(code, weights=counts.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
        seen = c[code] > 0
        held = np.append(0, np.cumsum(seen))[first]
        bucket = np.empty(len(c), np.int64)
        bucket[code] = own
        low = int(bucket.min())
        shape = np.stack([np.bincount(bucket - low, weights=w) for w in (c, c > 0, c == 1)], axis=1).astype(np.int64)
        there = np.nonzero(shape[:, 0])[0]
        places = np.append(at.to_numpy()[seen], (there + low).astype(np.int32))
        numbers = np.append(c[code][seen], shape[there].ravel())
        return pa.table({
            "piece": pa.concat_arrays([rows["piece"].combine_chunks(), pa.nulls(1, pa.int64())]),
            "at": pa.ListArray.from_arrays(pa.array(np.append(held, len(places)), pa.int32()), pa.array(places, pa.int32())),
            "c": pa.ListArray.from_arrays(pa.array(np.append(held, len(numbers)), pa.int32()), pa.array(numbers, pa.int64())),
        })

    lists = "at array<int>, words array<string>, buckets array<int>, counts array<long>"
    cut = table.select("piece", "words", "buckets", "counts").mapInArrow(split, f"share int, piece long, {lists}")
    return stored(cut.groupBy("share").applyInArrow(meet, "piece long, at array<int>, c array<long>"), "hmm-vocabulary")


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch[name][k].as_py() if name == "codes" else _values(batch[name], k) for name in batch.schema.names}


def _values(column: pa.Array, k: int):
    value = column[k]
    if not value.is_valid:
        return None
    if isinstance(value, pa.ListScalar):
        inner = value.values
        return inner if pa.types.is_string(inner.type) else inner.to_numpy(zero_copy_only=False)
    return value.as_py()


def count_round(table: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Expected counts over all training texts, their log likelihood and number of tokens, added up
    across partitions. Counts travel in blocks of BLOCK rows, those of buckets in single precision;
    what reaches the driver has BUCKETS + STATES + 3 rows. Every task sends a whole model's worth of
    counts, so there are twice as many as cores, however many files the pieces have."""
    context = table.sparkSession.sparkContext
    shared = context.broadcast(model)
    height = BUCKETS + 1 + STATES + 2
    cuts = [*range(0, BUCKETS + 1, BLOCK), height]  # the last block has END and all that is no bucket

    def blocks_of(blocks: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], names=["block", "sums"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, room = np.zeros((height, STATES)), Room()
        for row in batched(batches):
            tokens, starts = training_tokens(row)
            if len(tokens):
                start, moves, counts, log = counted(shared.value, tokens, starts, room)
                total[:BUCKETS + 1] += counts
                total[BUCKETS + 1:-2] += moves
                total[-2] += start
                total[-1, :2] += log, len(tokens)
        some = [k for k in range(len(cuts) - 1) if total[cuts[k]:cuts[k + 1]].any()]
        yield blocks_of(some, [total[cuts[k]:cuts[k + 1]].astype("<f4" if cuts[k] < BUCKETS else "<f8") for k in some])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch["block"].to_pylist(), batch["sums"]):
                own = np.frombuffer(raw.as_buffer(), "<f4" if cuts[block] < BUCKETS else "<f8").astype("<f8")
                sums[block] = sums[block] + own if block in sums else own
        yield blocks_of([*sums], [*sums.values()])

    schema = "block int, sums binary"
    parts = table.select("held", "starts", "codes", "buckets").coalesce(2 * context.defaultParallelism).mapInArrow(count, schema)
    total = np.zeros((height, STATES))
    for block, raw in parts.repartition("block").mapInArrow(add_up, schema).collect():
        total[cuts[block]:cuts[block + 1]] += np.frombuffer(raw, "<f8").reshape(-1, STATES)
    return total[-2], total[BUCKETS + 1:-2], total[:BUCKETS + 1], float(total[-1, 0]), int(total[-1, 1])


def starting_point(corpus: np.ndarray) -> Model:
    """A fixed random model around the corpus' bucket shares, with states that tend to stay."""
    draw = np.random.default_rng(7)
    return normalised(
        np.ones(STATES), np.ones((STATES, STATES)) + 30 * np.eye(STATES),
        corpus[:, None] * 1e5 * draw.gamma(1.0, size=(BUCKETS + 1, STATES)), corpus,
    )


def fit(table: DataFrame, corpus: np.ndarray) -> Model:
    """corpus: share of each bucket (and END) in all training tokens."""
    model, before = starting_point(corpus), -np.inf
    while True:
        *counts, log, tokens = count_round(table, model)
        model = normalised(*counts, corpus)
        if log - before < GAIN * tokens or not tokens:
            return model
        before = log


def log_likelihoods(model: Model, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Exact log10 probability of each text's bucket sequence, by the scaled forward recursion: heads
    in lockstep, then their runs' transfer matrices in order, a bounded number of matrices at once."""
    head, per, runs = heads(starts)
    out, state = np.zeros(len(head)), np.empty((len(head), STATES))
    for some in groups(head, TOKENS_AT_ONCE // 2):
        begin, at = lockstep(starts[:-1][some], head[some])
        share = np.take(model.emit, tokens[at], axis=0, mode="clip")
        out[some] = forward(model.move, share, begin, np.tile(model.start, (len(some), 1)), share)
        state[some] = last_vectors(share, begin, head[some])
    owner = np.repeat(np.arange(len(per)), per)
    for low in range(0, len(runs), RUNS_AT_ONCE):
        matrix, log = transfers(model.move, model.emit, tokens, runs[low:low + RUNS_AT_ONCE])
        own, many = np.unique(owner[low:low + RUNS_AT_ONCE], return_counts=True)
        texts, turns = in_turn(many)
        for at in turns:
            some = own[texts[:len(at)]]
            moved = np.einsum("ni,nij->nj", state[some], matrix[at])
            scale = moved.sum(axis=1)
            out[some] += np.log(scale) + log[at]
            state[some] = moved / scale[:, None]
    return (out + np.log(state.sum(axis=1))) / np.log(10)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone. Held-out documents (crc32 of the key modulo
    FOLDS is HELD; a null key counts as training) teach nothing. Repeated rows are documents of
    their own; other columns are not read; an empty table gives no rows. Without training
    documents all tokens are unknown.
    """
    table = cut_pieces(docs, key, text)
    many, ends = table.agg(F.count("*"), F.coalesce(F.sum(F.expr("size(filter(held, h -> NOT h))")), F.lit(0))).first()
    vocabulary = corpus_counts(table, many // PIECES_A_SHARE + 1)
    known = np.zeros((BUCKETS, 3), np.int64)  # per bucket: tokens, words, words seen once
    for row in vocabulary.filter("piece IS NULL").collect():
        known[row["at"]] = np.reshape(row["c"], (-1, 3))
    total = int(known[:, 0].sum() + ends)
    distinct = int(known[:, 1].sum() + (ends > 0))
    corpus = np.append(known[:, 0] + 0.5, ends + 0.5)
    corpus = corpus / corpus.sum()
    model = fit(table, corpus)

    found = vocabulary.filter("piece IS NOT NULL").groupBy("piece").agg(
        F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("c")).alias("c")
    )
    ready = table.select("piece", "ids", "held", "starts", "codes", "buckets").join(found, "piece", "left").drop("piece")
    shared = docs.sparkSession.sparkContext.broadcast((model, known))
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value
        unseen = seen[:, 2] + 1
        size = seen[:, 0] + unseen
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: _values(batch[name], k) for name in ("starts", "held", "buckets", "at", "c")}
                buckets = np.asarray(row["buckets"], np.int64)
                c = np.zeros(len(buckets) + 1)
                if row["at"] is not None:
                    c[np.asarray(row["at"], np.int64)] = row["c"]
                c[-1] = ends
                codes = unpacked(batch["codes"][k].as_py())
                codes, first = with_ends(codes, np.asarray(row["starts"]), len(buckets))
                n = np.diff(first)
                base = np.log10((c + 1) / (total + distinct + 1))[codes]
                inner = np.append(np.log10(np.where(c[:-1] > 0, c[:-1], unseen[buckets]) / size[buckets]), 0.0)[codes]
                sequence = log_likelihoods(own, np.append(buckets, END)[codes], first)
                sums = lambda x: np.add.reduceat(x, first[:-1]) if len(n) else x
                yield pa.RecordBatch.from_arrays([
                    batch["ids"][k].values, pa.array(np.asarray(row["held"], bool)), pa.array(n),
                    pa.array(sums((c > 0)[codes].astype(np.int64))), pa.array(np.full(len(n), total)),
                    pa.array(sums(base)), pa.array(sums(inner) + sequence),
                ], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.mapInArrow(run, schema)
