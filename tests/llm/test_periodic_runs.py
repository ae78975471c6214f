import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from pulseline.llm import periodic_runs as pr
from pulseline.llm.queries import plant_repeats


def brute(words):
    """All runs by comparing every word with the one a period later."""
    best = {}
    n = len(words)
    for p in range(n // 2, 0, -1):
        i = 0
        while i + p < n:
            e = i
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e - i >= p and e + p - i >= 12:
                best[i, e + p] = p  # periods fall, so the least stays
            i = e + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def runs_of(texts):
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    rows = pr.runs_of(np.array([c for t in texts for c in t], np.int64), starts)
    return [[tuple(r[1:].tolist()) for r in rows if r[0] == k] for k in range(len(texts))]


BLOCKS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 6)), max_size=8).map(
    lambda x: [c for block, times in x for c in block * times])


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(BLOCKS, st.lists(st.integers(0, 1), max_size=60)), max_size=4))
def test_runs_match_brute_force(texts):
    assert runs_of(texts) == [brute(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=120), st.integers(1, 4))
def test_extensions_match_comparison(words, times):
    words = np.array([*words * times, 7])
    ext = pr.Extensions(words)
    i, j = np.triu_indices(len(words), 1)
    want = [next(k for k in range(len(words)) if words[a + k] != words[b + k]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert ext(i, j).tolist() == want and ext(j, i).tolist() == want


def test_every_pair_of_remainders_meets_in_the_cover():
    assert {(a - b) % pr.MODULUS for a in pr.COVER for b in pr.COVER} == set(range(pr.MODULUS))


def test_long_texts_in_several_steps(monkeypatch):
    monkeypatch.setattr(pr, "AT_ONCE", 1000)
    rng = np.random.default_rng(5)
    unit = rng.integers(0, 50, 700).tolist()
    texts = [[3] * 4000, rng.integers(0, 1000, 3000).tolist(), unit * 3 + unit[:99], [], [1, 2] * 5, [1, 2] * 6, rng.integers(0, 4, 900).tolist()]
    assert runs_of(texts) == [brute(t) for t in texts]


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_operator_on_odd_rows(spark, make_docs, odd_rows):
    rows = [*odd_rows, (20, "so it goes " * 9 + "end"), (21, "a b\tc d e f\n" * 3), (22, "x\x1cy " * 12), (23, "one two " * 5)]
    docs = make_docs(rows).selectExpr("*", "'q' AS runs", "1.5 AS Collapsed")
    got = pr.find(docs).select("doc_id", "text", "n_words", "runs", "collapsed", "ids", "record").collect()
    assert len(got) == len(rows) and {(r.ids, r.record) for r in got} == {("x", 2)}
    for r in got:
        words = words_in(r.text)
        want = brute(words) if r.doc_id != 6 else [tuple(x) for x in r.runs]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == want
        assert r.collapsed == collapsed(words, want)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_planted_repeats(spark, make_docs, odd_rows):
    rows = [(i, t) for i in range(60) for _, t in odd_rows if t is None or len(t) < 1000] + [(None, "a b c"), (-3, "x y z " * 7)]
    got = plant_repeats(make_docs(rows)).select("doc_id", "text").collect()
    changed = 0
    for r, (i, t) in zip(got, rows, strict=True):
        assert words_in(r.text) == planted(i, words_in(t))
        changed += r.text != t
    assert changed > 20


def test_empty_table(make_docs):
    assert pr.find(make_docs([])).count() == 0
