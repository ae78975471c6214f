"""Runs: stretches of words that repeat with a period, found for every period of a whole text.

A run of period p covers a multiple of p and the word p further on. So for every p only the pairs
(0, p), (p, 2p), ... are looked at, n log n pairs for all periods of a text of n words. Where both
words are equal, the pair is extended forwards and backwards; together the two extensions must reach
a whole period.

Extensions (LCE) are answered by a difference cover: only suffixes that start at places sampled by
their remainder are sorted, by doubling blocks of their ranks. Two places reach sampled ones together
after a few words, which are compared one by one; from there the answer is a range minimum over the
common prefixes of neighbours in sorted order, kept in a sparse table. Most equal pairs end within
a few words anyway, so only texts with a longer match are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulseline.llm.common import making_room, pieces, schema_text, words_of

#: Every difference modulo 13 is one of two members (a perfect difference set; fixed values).
MODULUS, COVER = 13, (0, 1, 3, 9)
LEAST_LENGTH = 12
#: Pairs of places that are looked at in one step.
AT_ONCE = 1 << 19


def shifts() -> np.ndarray:
    """For two remainders: the least shift that makes both members of the cover."""
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER)
    return out


SHIFTS = shifts()


def equal_words(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | int, step: int = 1) -> np.ndarray:
    """How many words are equal from the places i and j on, going by `step`, up to `most`."""
    most = np.broadcast_to(most, i.shape)
    out = np.zeros(len(i), np.int64)
    open_ = np.nonzero(most > 0)[0]
    k = 0
    while len(open_):
        same = words[i[open_] + step * k] == words[j[open_] + step * k]
        open_ = open_[same]
        out[open_] += 1
        k += 1
        open_ = open_[most[open_] > k]
    return out


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 on of tuples of non-negative numbers."""
    key = keys[0].astype(np.int64)
    for other in keys[1:]:
        key = key * (int(other.max(initial=0)) + 1) + other
    return np.unique(key, return_inverse=True)[1] + 1


class Extensions:
    """Longest common extensions to the right in a sequence that ends with a word of its own."""

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        rank, width = _ranks(words), 1

        def ahead(ranks: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate([ranks[by:], np.zeros(min(by, len(ranks)), np.int64)])

        while 2 * width <= MODULUS:
            rank, width = _ranks(rank, ahead(rank, width)), 2 * width
        sampled = np.isin(np.arange(n) % MODULUS, COVER)
        at = np.nonzero(sampled)[0]
        self.slot = np.cumsum(sampled) - 1
        # a block of the whole modulus; then blocks twice as long, whose halves are both sampled
        levels = [_ranks(rank[at], ahead(rank, MODULUS - width)[at])]
        while len(at) and levels[-1].max() < len(at):
            then = at + (MODULUS << (len(levels) - 1))
            half = np.where(then < n, levels[-1][self.slot[np.minimum(then, n - 1)]], 0)
            levels.append(_ranks(levels[-1], half))
        self.rank = levels[-1] - 1
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            i, j = a + common, b + common
            inside = (i < n) & (j < n)
            i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
            common += np.where(inside & (levels[k][self.slot[i]] == levels[k][self.slot[j]]), MODULUS << k, 0)
        common += equal_words(words, a + common, b + common, MODULUS)
        table = [common.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(common):
            half = 1 << (len(table) - 1)
            least = np.minimum(table[-1][:-half], table[-1][half:])
            table.append(np.concatenate([least, np.zeros(len(common) - len(least), np.int32)]))
        self.table = np.stack(table)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of equal words from each pair of different places on."""
        shift = SHIFTS[i % MODULUS, j % MODULUS]
        out = equal_words(self.words, i, j, shift)
        deep = np.nonzero(out == shift)[0]
        a, b = (self.rank[self.slot[x[deep] + shift[deep]]] for x in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out[deep] += np.minimum(self.table[k, low], self.table[k, high - (1 << k)])
        return out


def apart(codes: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the given texts with a word of its own before each and behind the last, and the
    place of each text's first word. Codes are numbers from 0 on, all below the separators."""
    n = np.diff(starts)[texts]
    first = np.cumsum(n) - n + np.arange(1, len(n) + 1)
    top = int(codes.max(initial=-1)) + 1
    out = np.empty(int(n.sum()) + len(n) + 1, np.int64)
    ends = np.append(first - 1, len(out) - 1)
    out[ends] = top + np.arange(len(ends))
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = codes[np.arange(int(n.sum())) + np.repeat(starts[:-1][texts] - (np.cumsum(n) - n), n)]
    return out.astype(np.int32 if len(out) + top < 1 << 31 else np.int64), first


def equal_pairs(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and period of the grid pairs with equal words, in blocks of about AT_ONCE pairs."""
    periods = np.where(n >= LEAST_LENGTH, n // 2, 0)
    text = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (n[text] - 1) // period
    total = np.cumsum(count)
    begin = 0
    while begin < len(text):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + AT_ONCE, side="right")))
        c = count[begin:end]
        p = np.repeat(period[begin:end], c)
        k = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        at = k * p + np.repeat(first[text[begin:end]], c)
        hit = np.nonzero(words[at] == words[at + p])[0]
        yield np.repeat(text[begin:end], c)[hit], at[hit], p[hit]
        begin = end


def _long_enough(text, at, period, forward, backward) -> np.ndarray:
    """Rows (text, start, length, period) of the pairs whose extensions reach a whole period."""
    length = period + forward + backward
    good = (forward + backward >= period) & (length >= LEAST_LENGTH)
    return np.unique(np.stack([text, at - backward, length, period], axis=1)[good], axis=0)


def runs_of(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of all texts, sorted; text k has the words
    codes[starts[k]:starts[k + 1]], and its words are numbered from 0."""
    n = np.diff(starts)
    words, first = apart(codes, starts, np.arange(len(n)))
    found, deep = [np.zeros((0, 4), np.int64)], np.zeros(len(n), bool)
    for text, at, period in equal_pairs(words, first, n):
        forward = equal_words(words, at, at + period, MODULUS)
        backward = equal_words(words, at - 1, at + period - 1, MODULUS, -1)
        open_ = (forward == MODULUS) | (backward == MODULUS)
        deep[text[open_]] = True
        rows = _long_enough(text, at, period, np.where(open_, 0, forward), np.where(open_, 0, backward))
        rows[:, 1] -= first[rows[:, 0]]
        found.append(rows)
    which = np.nonzero(deep)[0]
    if len(which):
        words, first = apart(codes, starts, which)
        right, left, last = Extensions(words), Extensions(np.ascontiguousarray(words[::-1])), len(words) - 1
        for text, at, period in equal_pairs(words, first, n[which]):
            rows = _long_enough(text, at, period, right(at, at + period), left(last - at + 1, last - at - period + 1))
            rows[:, 1] -= first[rows[:, 0]]
            rows[:, 0] = which[rows[:, 0]]
            found.append(rows)
    rows = np.unique(np.concatenate(found), axis=0)
    # one stretch found with several periods has the least of them; all others are its multiples
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each word stays when every run is reduced to its first period."""
    change = np.zeros(int(starts[-1]) + 1, np.int64)
    begin = starts[rows[:, 0]] + rows[:, 1]
    np.add.at(change, begin + rows[:, 3], 1)
    np.add.at(change, begin + rows[:, 2], -1)
    return np.cumsum(change)[:-1] == 0


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, runs (start, length and period in words, by start and then period) and collapsed
    (the words outside later periods of any run, joined by one space) for each whole text.

    A run repeats a smallest period at least twice, has at least 12 words, and no neighbour extends
    it. A null, empty or blank text has no words, no runs and an empty collapsed text. Rows are
    independent, repeated ones give repeated rows; columns called like an added one are replaced.
    """
    given = df.withColumn("_periodic", F.col(text))
    df = making_room(df, "n_words", "runs", "collapsed")
    given = making_room(given, "n_words", "runs", "collapsed")
    schema = schema_text(df)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_periodic"):
                codes, starts, words = words_of(part["_periodic"])
                rows = runs_of(codes, starts)
                cuts = np.searchsorted(rows[:, 0], np.arange(part.num_rows + 1))
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3)], fields=list(kind))
                runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts)
                kept = kept_words(rows, starts)
                bounds = np.concatenate([[0], np.cumsum(kept)])[starts]
                stay = words.cast(pa.string()).take(pa.array(codes[kept]))
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), stay), " ")
                own = [part[c] for c in part.schema.names if c != "_periodic"]
                names = [c for c in part.schema.names if c != "_periodic"]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.diff(starts)), runs, collapsed],
                    names=[*names, "n_words", "runs", "collapsed"],
                )

    return given.mapInArrow(run, f"{schema}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
