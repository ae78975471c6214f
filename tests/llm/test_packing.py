import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseline.llm import packing
from pulseline.llm.chunk_encoder import ChunkEncoder
from pulseline.llm.common import stored

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
OWN = ChunkEncoder(PATH)

BITS = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "a", "Word", "'s", "don't", ",", ")).", "é", "ß", "漢字", " ", "\u0085", "\x1c", "᠎",
                        " ", "12", "½", "<|endoftext|>", "<|", "🙂", "\r\n", "x" * 210, "é", "_", "\x00"])


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@example(["", None, " ", "\n", "a\n", " a", "a  b", "a \nb", "a\n b", "\n\na"])
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.lists(BITS, max_size=14).map("".join)), max_size=5))
def test_ids_are_those_of_the_whole_text(texts):
    ids, n = OWN.encode(pa.array(texts, pa.string()))
    assert n.tolist() == [len(ids_of(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in ids_of(t)]


def checked(recipes, counts, capacity):
    """Sequences of a plan, after checks that it holds exactly the items and no more than fits."""
    held = Counter()
    for r in recipes:
        assert r.copies > 0 and sum(n * t for n, t in r.items) <= capacity
        for n, t in r.items:
            held[n] += r.copies * t
    assert held == Counter({n: c for n, c in counts.items() if c})
    return sum(r.copies for r in recipes)


@lru_cache(maxsize=None)
def fewest(items, capacity):
    """Fewest bins by trying every way to fill the bin of the largest item."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)

    def fill(k, room, left):
        nonlocal best
        if k == len(rest):
            best = min(best, 1 + fewest(tuple(left), capacity))
            return
        fill(k + 1, room, [*left, rest[k]])
        if rest[k] <= room:
            fill(k + 1, room - rest[k], left)

    fill(0, capacity - first, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_plans_hold_all_items_in_few_sequences(items):
    counts = Counter(items)
    n = checked(packing.plan(counts, 12), counts, 12)
    best = fewest(tuple(sorted(items, reverse=True)), 12)
    assert n <= best + (best + 3) // 4
    large = Counter({k: c for k, c in counts.items() if 3 * k > 12})
    assert checked(packing.plan(large, 12), large, 12) == fewest(tuple(sorted(large.elements(), reverse=True)), 12)


def test_plan_of_many_items_is_small():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 400_000).astype(int) + 1, 2048)
    counts = Counter(lengths.tolist())
    recipes = packing.plan(counts)
    assert checked(recipes, counts, 2048) <= 1.002 * max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    many = packing.plan({n: c * 10**9 for n, c in counts.items()})
    checked(many, {n: c * 10**9 for n, c in counts.items()}, 2048)
    assert len(packing.layout(recipes)) < 60_000 and len(packing.layout(many)) < 60_000


def pieces_of(text, capacity):
    ids = [*ids_of(text), 0]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


@pytest.mark.parametrize("capacity", [2048, 16])
def test_documents_are_packed_whole(spark, make_docs, odd_rows, capacity):
    rows = odd_rows + [(50 + k, " ".join(["packed"] * k)) for k in range(40)]
    docs = make_docs(rows).repartition(5)
    packed = stored(packing.packed_documents(spark, docs, PATH, 0, capacity), "test-packed")
    got = packed.withColumn("crc", F.crc32("ids")).collect()
    want = Counter((i, *p) for i, t in rows for p in pieces_of(t, capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got) == want
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length, r.ids))
    assert sorted(inside) == list(range(len(inside)))
    for items in inside.values():
        at = 0
        for offset, length, _ in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    whole = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in packing.sequences(packed).collect()}
    assert whole == {s: (sum(x[1] for x in v), b"".join(bytes(x[2]) for x in sorted(v))) for s, v in inside.items()}


def test_one_length_for_all_and_clashing_names(spark):
    items = spark.range(3000).selectExpr("id", "cast(700 as int) AS length", "'x' AS sequence_id", "id AS offset", "'p' AS part", "7 AS place")
    packed = packing.pack(stored(packing.numbered(items.repartition(7)), "test-numbered")).collect()
    assert Counter((r.sequence_id, r.offset) for r in packed) == Counter((s, o) for s in range(1500) for o in (0, 700))
    assert sorted(r.id for r in packed) == list(range(3000))


def test_empty_table_and_wrong_lengths(spark, make_docs):
    assert packing.packed_documents(spark, make_docs([]), PATH, 0).count() == 0
    with pytest.raises(ValueError, match="lengths outside"):
        packing.pack(stored(packing.numbered(spark.range(3).selectExpr("id AS length")), "test-wrong"))
