import re
from collections import Counter
from itertools import permutations

from pulseline.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int, text string"


def failing(rows):
    """Names of the failed filters of each (id, text, lang) row, by the rules as they are worded."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append("".join(name for name, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", bool(re.search("[#$%&*|]", t))), ("E", smaller),
        ) if bad))
    return out


def brute(rows, labels):
    fails = failing(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        docs = [(f, i in good, i in toxic) for f, (i, _, lang) in zip(fails, rows, strict=True) if (lang or "") == part]
        by_filter, found = Counter(), {}
        for order in permutations("ABCDE"):
            left = docs
            for k, name in enumerate(order):
                gone = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                by_filter[name] += len(gone)
                found["".join(order), k + 1] = (
                    len(left), len(gone), sum(name in d[0] for d in docs) - len(gone), sum(d[0] == name for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone))
        for (order, step), figures in found.items():
            out[part, order, step] = (*figures, by_filter[order[step - 1]])
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame(
        [(i, t, lang, 5, "x", "h", True) for i, t, lang in rows],
        "doc_id long, text string, lang string, n int, part string, hash string, failed boolean")
    known = spark.createDataFrame([(*x, "other") for x in labels], LABELS)
    got = fa.audit(fa.patterns(docs, known)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got}


LONG = " ".join(f"word{i}" for i in range(230))


def test_all_orders_match_brute_force(spark, odd_rows):
    langs = ["en", None, "", "de"]
    rows = [(i, t, langs[k % 4]) for k, (i, t) in enumerate(odd_rows)]
    rows += [(20 + k, t, langs[k % 3]) for k, t in enumerate([
        LONG, LONG, LONG + " #", LONG.upper(), "a " * 300, "a " * 300, "", None, "f\ff\vv\rf\tf\nf", LONG + "\x0cend", "$", "$", "É" * 40])]
    rows += [(None, LONG, "en"), (None, LONG, "en"), (20, LONG, "en"), (20, LONG, "en"), (-4, LONG, None)]
    labels = [(i, k % 2, (k // 2) % 2) for k, (i, _, _) in enumerate(rows)] + [(None, 1, 1), (999, 1, 1), (22, None, None), (23, 1, None)]
    got, want = run(spark, rows, labels), brute(rows, labels)
    assert len(got) == 3 * 600
    assert got == want


def test_one_group_of_copies_and_no_labels(spark):
    rows = [(i, LONG if i % 3 else f"{LONG} {i}", "en") for i in range(90)]
    assert run(spark, rows, []) == brute(rows, [])


def test_each_row_meets_one_partner(spark, make_docs):
    """The self-join gives each copy once, whatever the size of its group."""
    docs = make_docs([(i, LONG) for i in range(500)])
    rows = fa._rows(docs, "text", "doc_id", "lang").select("id", "part", "hash")
    copies = fa.later_copies(docs, rows)
    assert sorted(r.id for r in copies.collect()) == list(range(1, 500))
    plan = copies._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_table(spark):
    assert run(spark, [], []) == {}
