import re
from collections import Counter

from pulseline.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


CASES = ["a b c d e a b c d e", "a a a a a a a", "x\nx\n\nx\n \n", "### <b> $5 | x", "one two three four five six seven eight nine ten eleven", "é é é\x1c漢"]


def test_measures_match_brute_force(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(CASES)]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.measure(make_docs(rows)).collect())
    assert got == Counter((i, *brute(t)) for i, t in rows)


def test_policies_and_ablation(make_docs, odd_rows):
    book = q.ledger(make_docs(odd_rows)).cache()
    rows = book.collect()
    assert book.filter(q.passes("base")).count() == sum(r.failed_bits & q.mask("base") == 0 for r in rows)
    for r in q.ablation(book, "v1").collect():
        bit = {rule.name: 1 << rule.bit for rule in q.RULES}[r.rule]
        whole = q.mask("v1")
        assert r.failing == sum(bool(x.failed_bits & bit) for x in rows)
        assert r.failing_alone == sum(x.failed_bits & whole == bit for x in rows)
        assert r.kept_without == sum(x.failed_bits & (whole - bit) == 0 for x in rows)


def test_filters_stay_above_the_measures(make_docs, odd_rows):
    plan = q.ledger(make_docs(odd_rows)).filter(q.passes())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(_text#") <= 2 and plan.index("Filter") < plan.index("Generate")


def test_empty_table(make_docs):
    assert q.ledger(make_docs([])).count() == 0
