import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np

from pulseline.llm import hidden_markov as h


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    draw = random.Random(2)
    tongues = [[f"{p}{i}" for i in range(60)] for p in ("ka", "zu")]
    return [(i, " ".join(draw.choices(tongues[i % 2], k=draw.randrange(5, 200)))) for i in range(300)]


def test_base_and_gain_over_it(spark, make_docs, odd_rows):
    rows = corpus() + [((i or 0) + 9000, t) for i, t in odd_rows]
    got = h.score(make_docs(rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(words(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    want = Counter()
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        base += math.log10((ends + 1) / (total + distinct + 1))
        want[i, held(i), len(own) + 1, sum(w in counts for w in own) + 1, total, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    tested = [r for r in got if r.held_out and r.doc_id < 9000]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


def small_model(seed=1):
    draw, k, n = np.random.default_rng(seed), h.STATES, h.BUCKETS + 1
    return h.normalised(draw.random(k), draw.random((k, k)), draw.random((n, k)) * 5, np.full(n, 1 / n))


def test_forward_recursion_is_exact():
    model, draw = small_model(), np.random.default_rng(4)
    starts = np.array([0, 1, 2, 66, 131, 1200])
    tokens = draw.integers(0, h.BUCKETS, 1200)
    got = h.log_likelihoods(model, tokens, starts)
    for k in range(len(starts) - 1):
        own = tokens[starts[k]:starts[k + 1]]
        alpha, log = model.start * model.emit[own[0]], 0.0
        for x in own[1:]:
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum() @ model.move * model.emit[x]
        assert math.isclose(got[k], log + math.log10(alpha.sum()), rel_tol=1e-9)


def test_expected_counts_match_all_paths():
    """Baum-Welch counts of a tiny text against a sum over all state paths."""
    model, tokens = small_model(3), np.array([5, 9, 5])
    start, moves, counts = h.expected(model, tokens, np.array([0, 3]))
    weight, want_moves, want_counts = 0.0, np.zeros_like(moves), np.zeros((10, h.STATES))
    for path in product(range(h.STATES), repeat=3):
        p = model.start[path[0]] * model.emit[5, path[0]] * model.move[path[0], path[1]] * model.emit[9, path[1]]
        p *= model.move[path[1], path[2]] * model.emit[5, path[2]]
        weight += p
        for a, b in zip(path, path[1:]):
            want_moves[a, b] += p
        for x, s in zip(tokens, path):
            want_counts[x, s] += p
    assert np.allclose(moves, want_moves / weight, rtol=1e-4)
    assert np.allclose(counts[:10], want_counts / weight, rtol=1e-4) and math.isclose(start.sum(), 1, rel_tol=1e-5)


def test_emissions_are_probabilities():
    model = small_model()
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_empty_table(make_docs):
    assert h.score(make_docs([])).count() == 0


def test_expected_counts_of_long_texts():
    """Counts of texts of several runs against forward and backward passes over whole texts."""
    model, draw = small_model(5), np.random.default_rng(6)
    starts = np.array([0, 300, 301, 365, 430, 630])
    tokens = draw.integers(0, 50, 630)
    start, moves, counts = h.expected(model, tokens, starts)
    want_start, want_moves, want_counts = np.zeros_like(start), np.zeros_like(moves), np.zeros_like(counts)
    for a, b in zip(starts, starts[1:]):
        own = tokens[a:b]
        alpha, beta = [model.start * model.emit[own[0]]], [np.ones(h.STATES)]
        for x in own[1:]:
            alpha.append(alpha[-1] / alpha[-1].sum() @ model.move * model.emit[x])
        for x in own[:0:-1]:
            new = model.move @ (model.emit[x] * beta[0])
            beta.insert(0, new / new.sum())
        for k, x in enumerate(own):
            both = alpha[k] * beta[k] / (alpha[k] @ beta[k])
            want_counts[x] += both
            want_start += both if k == 0 else 0
            if k:
                pair = alpha[k - 1][:, None] * model.move * (model.emit[x] * beta[k])
                want_moves += pair / pair.sum()
    assert math.isclose(moves.sum(), 630 - 5, rel_tol=1e-4)
    assert np.allclose(moves, want_moves, rtol=1e-3) and np.allclose(start, want_start, rtol=1e-3)
    assert np.allclose(counts[:50], want_counts[:50], rtol=1e-3, atol=1e-4)


def test_training_does_not_depend_on_the_file_layout(make_docs):
    """All training texts choose the model, however rows are dealt to pieces."""
    docs = make_docs(corpus())
    one, many = ({r.doc_id: r for r in h.score(x).collect()} for x in (docs.coalesce(1), docs.repartition(7, "doc_id")))
    assert one.keys() == many.keys()
    assert all(abs(one[i].score - many[i].score) < 1e-3 * one[i].n_tokens for i in one)


def test_training_ends_when_little_is_gained(spark, make_docs):
    table = h.cut_pieces(make_docs(corpus()), "doc_id", "text").cache()
    shares = np.full(h.BUCKETS + 1, 1e-6)
    for row in (r.asDict() for r in table.select("held", "starts", "codes", "buckets").collect()):
        np.add.at(shares, h.training_tokens(row)[0], 1)
    shares /= shares.sum()
    first = h.fit(table, shares)
    *counts, log, tokens = h.count_round(table, first)
    assert h.count_round(table, h.normalised(*counts, shares))[3] - log < 2 * h.GAIN * tokens


def plain_counts(model, tokens, starts):
    """Expected counts and log likelihood by forward and backward passes over each whole text."""
    start, moves, counts, log = np.zeros(h.STATES), np.zeros((h.STATES, h.STATES)), np.zeros((h.BUCKETS + 1, h.STATES)), 0.0
    for a, b in zip(starts, starts[1:]):
        own, alpha, beta = tokens[a:b], [], [np.ones(h.STATES)]
        for k, x in enumerate(own):
            now = (alpha[-1] @ model.move if k else model.start) * model.emit[x]
            log += math.log(now.sum())
            alpha.append(now / now.sum())
        for x in own[:0:-1]:
            new = model.move @ (model.emit[x] * beta[0])
            beta.insert(0, new / new.sum())
        for k, x in enumerate(own):
            both = alpha[k] * beta[k]
            counts[x] += both / both.sum()
            start += both / both.sum() if k == 0 else 0
            if k:
                pair = alpha[k - 1][:, None] * model.move * (model.emit[x] * beta[k])
                moves += pair / pair.sum()
    return start, moves, counts, log


def test_counts_of_many_texts_of_all_lengths():
    """Heads in lockstep, in several groups, and the runs of the longest texts, against whole texts."""
    model, draw = small_model(8), np.random.default_rng(9)
    n = np.concatenate([draw.integers(1, 300, 2 * h.FEW), [300 + h.RUN - 1, 300 + h.RUN, 900, 2000], np.ones(5, int)])
    starts = np.concatenate([[0], np.cumsum(draw.permutation(n))])
    tokens = draw.integers(0, 40, starts[-1])
    want = plain_counts(model, tokens, starts)
    once = h.TOKENS_AT_ONCE
    try:
        for h.TOKENS_AT_ONCE in (once, 3000):
            got = h.counted(model, tokens, starts)
            assert np.allclose(got[0], want[0], rtol=1e-3) and np.allclose(got[1], want[1], rtol=1e-3)
            assert np.allclose(got[2], want[2], rtol=1e-3, atol=1e-3) and math.isclose(got[3], want[3], rel_tol=1e-6)
            assert math.isclose(h.log_likelihoods(model, tokens, starts).sum() * math.log(10), want[3], rel_tol=1e-9)
    finally:
        h.TOKENS_AT_ONCE = once


def test_states_that_hardly_move_and_rare_words():
    """Steps between scalings stay within single precision when every token but one state's is unlikely."""
    k, n = h.STATES, h.BUCKETS + 1
    emit = np.full((n, k), 1e-9)
    emit[np.arange(n), np.arange(n) % k] = 1.0
    emit /= emit.sum(axis=0)
    move = np.full((k, k), 1e-9) + np.eye(k)
    model = h.Model(np.full(k, 1 / k), move / move.sum(axis=1, keepdims=True), emit)
    draw = np.random.default_rng(3)
    tokens, starts = draw.integers(0, 200, 900), np.array([0, 400, 900])
    want, got = plain_counts(model, tokens, starts), h.counted(model, tokens, starts)
    assert all(np.isfinite(x).all() for x in got) and math.isclose(got[3], want[3], rel_tol=1e-5)
    assert math.isclose(got[2].sum(), 900, rel_tol=1e-4) and math.isclose(got[1].sum(), 898, rel_tol=1e-4)


def test_texts_of_usual_lengths_need_no_transfer_matrices(monkeypatch):
    """A matrix costs as much as a vector for every state: only runs that few texts reach have one."""
    made, transfers = [], h.transfers

    def counting(*given):
        out = transfers(*given)
        made.append(len(out[0] if isinstance(out, tuple) else out))
        return out

    monkeypatch.setattr(h, "transfers", counting)
    draw = np.random.default_rng(1)
    n = np.append(draw.integers(400, 500, 300), 5000)
    starts = np.concatenate([[0], np.cumsum(n)])
    h.expected(small_model(), draw.integers(0, 500, starts[-1]), starts)
    assert sum(made) <= 5000 // h.RUN  # the long text's runs, not those of 300 others


def test_words_meet_in_shares_of_the_buckets(make_docs):
    """Counts of all training texts come back to each piece, and buckets add up, however many shares."""
    rows = [*corpus(), (1, None), (2, " "), (9001, "Solo once"), (9001, "ärger Solo")]
    table = h.cut_pieces(make_docs(rows).repartition(5, "doc_id"), "doc_id", "text").cache()
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    pieces = {r.piece: r for r in table.collect()}
    for shares in (1, 7):
        got, known = {}, {}
        for r in h.corpus_counts(table, shares).collect():
            if r.piece is None:
                known.update(zip(r.at, np.reshape(r.c, (-1, 3)).tolist()))
            else:
                got.setdefault(r.piece, {}).update(zip(r.at, r.c))
        assert {p: {pieces[p].words[k]: c for k, c in own.items()} for p, own in got.items()} == {
            p: {w: counts[w] for w in r.words if counts[w]} for p, r in pieces.items() if any(counts[w] for w in r.words)}
        bucket_of = {w: b for r in pieces.values() for w, b in zip(r.words, r.buckets)}
        want = {}
        for w, c in counts.items():
            mine = want.setdefault(bucket_of[w], [0, 0, 0])
            mine[:] = mine[0] + c, mine[1] + 1, mine[2] + (c == 1)
        assert known == want


def test_a_round_sends_no_more_for_more_files(spark, make_docs):
    """Every task sends counts of the size of the model, so the tasks of a round are bounded."""
    table = h.cut_pieces(make_docs(corpus()).repartition(60), "doc_id", "text").repartition(60).cache()
    tasks, plain = [], type(table).mapInArrow

    def counting(df, run, schema, *more):
        tasks.append(df.rdd.getNumPartitions())
        return plain(df, run, schema, *more)

    type(table).mapInArrow = counting
    try:
        h.count_round(table, small_model())
    finally:
        type(table).mapInArrow = plain
    assert tasks[0] <= 2 * spark.sparkContext.defaultParallelism < 60
