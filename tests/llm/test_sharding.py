import zlib
from collections import Counter

from pulseline.llm import sharding as s


def test_placement(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, "same text") for i in range(400)] + [(50, f"text {i} " * (i % 9)) for i in range(400)]
    records, history = s.plan(make_docs(rows), 6)
    got = s.placed(records, history, 1).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    for shard in range(6):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert {r.version for r in history.select("version").distinct().collect()} == {0, 1}


def test_bytes_are_nearly_equal():
    weight = {i: 100 + (i * 7919) % 400 for i in range(s.SLOTS)}
    start = s.first_map(24)
    moved = s.rebalanced(start, weight, 24)
    load = Counter()
    for slot, shard in moved.items():
        load[shard] += weight[slot]
    assert max(load.values()) - min(load.values()) <= sum(load.values()) / 24 / 10_000
    assert sum(moved[x] != start[x] for x in start) < s.SLOTS / 10


def test_a_new_shard_takes_slots_and_nothing_else_is_rehashed():
    weight = dict.fromkeys(range(s.SLOTS), 10)
    before = s.rebalanced(s.first_map(24), weight, 24)
    after = s.rebalanced(before, weight, 25)
    load = Counter(after.values())
    assert set(after.values()) == set(range(25)) and max(load.values()) - min(load.values()) <= 1
    gone = s.rebalanced(after, weight, 24)
    assert set(gone.values()) == set(range(24))


def test_empty_table(make_docs):
    records, history = s.plan(make_docs([]), 4)
    assert s.placed(records, history, 1).count() == 0
