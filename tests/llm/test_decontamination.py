import random

from pulseline.llm import decontamination as d

draw = random.Random(5)
ITEMS = [(k, " ".join(f"i{k}w{draw.randrange(10**6)}" for _ in range(n))) for k, n in enumerate([3, 8, 14, 20, 33, 50, 61])]


def filler(n, seed):
    own = random.Random(seed)
    return [f"f{own.randrange(3000)}" for _ in range(n)]


def test_whole_and_edited_passages_are_found(spark, make_docs, odd_rows):
    benchmark = spark.createDataFrame([*ITEMS, (90, None), (91, ""), (92, ITEMS[4][1])], "item_id long, text string")
    rows, want = list(odd_rows), set()
    for k, text in ITEMS:
        for place in (0, 37, 400):
            words = filler(400, 100 * k + place)
            words[place:place] = text.upper().split() if place == 37 else text.split()
            rows.append((1000 + 10 * k + place % 9, "\n".join(words)))
            want |= {(rows[-1][0], i) for i in ([k, 92] if k == 4 else [k])}
    edited = ITEMS[6][1].split()
    edited[30] = "changed"  # 61 words with one changed: 52 of 62 shingles
    rows.append((5000, " ".join(filler(20, 1) + edited + filler(20, 2))))
    want.add((5000, 6))
    half = ITEMS[6][1].split()[:30]
    rows.append((5001, " ".join(filler(20, 3) + half + filler(20, 4))))
    found = d.matches(make_docs(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    exact = [r for r in found if r.doc_id != 5000]
    assert all(r.similarity == 1.0 and r.hamming == 0 for r in exact)


def test_every_fingerprint_within_the_radius_is_a_candidate():
    """The multi-index against a comparison of all fingerprints."""
    import numpy as np
    import pyarrow as pa

    from pulseline.llm.common import words_of

    index = d.Index(ITEMS)
    text = " ".join(filler(300, 9) + ITEMS[5][1].split()[:48] + filler(5, 1) + ITEMS[3][1].split() + filler(30, 2))
    codes, starts, words = words_of(pa.array([text]))
    sums = d.running(d.bit_weights(d.normal(words)), codes)
    got = {(int(a), int(i)) for at, item, _, _ in index.candidates(sums, starts, 0) for a, i in zip(at, item, strict=True)}
    want = set()
    for rung in index.rungs:
        prints = np.ascontiguousarray(d.window_prints(sums, rung.size)).view(np.uint64)[:, 0]
        for p, value in enumerate(prints):
            for e, own in enumerate(rung.prints):
                if int(value ^ own).bit_count() <= d.RADIUS:
                    want.add((p - int(rung.offset[e]), int(rung.item[e])))
    assert got == want and want


def test_empty_tables(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.matches(make_docs(odd_rows), none).count() == 0
    assert d.matches(make_docs([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_one_edit_at_every_place(spark, make_docs):
    """Each item of 13 to 70 words with one word changed at each place that leaves 0.8."""
    from collections import Counter

    grams = lambda words: Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    own, items, rows, want = random.Random(8), [], [], set()
    for n in range(13, 71):
        words = [f"{'abc'[own.randrange(3)] * own.randrange(1, 6)}{own.randrange(10**5)}" for _ in range(n)]
        items.append((n, " ".join(words)))
        for place in range(n):
            changed = [*words[:place], words[place] + ",", *words[place + 1:]]
            if d.weighted_jaccard(grams(changed), grams(words)) >= d.THRESHOLD:
                rows.append((100 * n + place, " ".join(filler(30, n) + changed + filler(30, place))))
                want.add((100 * n + place, n))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = d.matches(make_docs(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 1000
