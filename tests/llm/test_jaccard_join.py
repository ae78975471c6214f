import random
import re

from pulseline.llm import jaccard_join as j


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links, texts = list(range(len(rows))), [0] * len(rows), [set() for _ in rows]
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
                if sets[a] != sets[b]:
                    texts[a].add(frozenset(sets[b]))
                    texts[b].add(frozenset(sets[a]))
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in own if i is not None), default=None) for g, own in groups.items()}
    return sorted(((i, least[find(k)], links[k], len(texts[k])) for k, (i, _) in enumerate(rows)), key=str)


def check(docs, rows):
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in j.join(docs).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(make_docs, odd_rows):
    check(make_docs(odd_rows), odd_rows)


def test_near_copies_in_blocks(make_docs, monkeypatch):
    """A group of near copies larger than a block, chains, exact copies and unrelated texts."""
    draw = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in draw.sample(range(60), draw.choice([0, 1, 1, 2])):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    for k in range(90, 150):
        words = [f"c{(k - 90) // 3}_{i}" for i in range(40)]
        if k % 3:
            words[k % 40:k % 40 + 1] = ["edit"]
        rows.append((k, " ".join(words)))
    rows += [(k, rows[k - 150][1]) for k in range(150, 170)]
    monkeypatch.setattr(j, "BLOCK", 16)
    check(make_docs(rows), rows)


def test_a_third_of_all_rows_is_one_text(make_docs):
    """Copies of one text with near copies, as many rows without words, and null ids among both."""
    words = [f"h{i}" for i in range(50)]
    near = [" ".join(["edit", *words[1:]]), " ".join([*words[:-1], "edit"])]
    rows = [(k if k % 9 else None, " ".join(words)) for k in range(100)]
    rows += [(1000 + k if k % 9 else None, (None, "", " \n")[k % 3]) for k in range(100)]
    rows += [(2000 + k, near[k % 2]) for k in range(4)] + [(3000 + k, f"alone {k} of many") for k in range(96)]
    check(make_docs(rows), rows)


def test_pruning_keeps_pairs_at_the_threshold():
    for n, least in j.least_matches():
        assert least <= 0.8 * n  # the expected number of equal values is never cut


def test_empty_table(make_docs):
    assert j.join(make_docs([])).count() == 0
