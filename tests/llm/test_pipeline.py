"""Each stage of the pipeline against a brute-force version over its own input."""

import base64
import os
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from pulseline.llm.queries import ORACLES, QUERIES
from test_jaccard_join import brute

FOLDER = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test-stage")
        out.append(docs.toPandas())
    return out


def ids(frame):
    return set(frame.doc_id.tolist())


def test_quality(steps):
    con = duckdb.connect()
    con.register("documents", steps[0])
    kept = con.execute(f"SELECT doc_id FROM ({ORACLES['op4_quality_rules']}) WHERE kept").fetchall()
    assert ids(steps[1]) == {k for k, in kept}


def test_toxicity(steps):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{FOLDER}/labels.parquet'").fetchall())
    gone = ids(steps[1]) - ids(steps[2])
    assert all(labels.get(i, 1) == 1 for i in gone)
    clean = [i for i in ids(steps[1]) if labels.get(i) == 0]
    assert set(clean) <= ids(steps[2])


def test_near_duplicates(steps):
    rows = list(steps[2][["doc_id", "text"]].itertuples(index=False, name=None))
    assert ids(steps[3]) == {least for _, least, _, _ in brute(rows)}


def test_decontamination(steps):
    words = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    items = [f" {words(t)} " for t, in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    whole = {i for i, t in steps[3][["doc_id", "text"]].itertuples(index=False, name=None) if any(x in f" {words(t)} " for x in items)}
    assert whole.isdisjoint(ids(steps[4]))
    share = lambda t, x: len({*zip(*[t.split()[k:] for k in range(5)])} & {*zip(*[x.split()[k:] for k in range(5)])}) / (len(x.split()) - 4)
    texts = {i: words(t) for i, t in steps[3][["doc_id", "text"]].itertuples(index=False, name=None)}
    for i in ids(steps[3]) - ids(steps[4]) - whole:  # an edge of an item may be joined to its neighbour
        assert max(share(texts[i], x) for x in items) >= 0.8


def test_tokens(steps):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = steps[4].set_index("doc_id").text
    assert ids(steps[5]) == ids(steps[4]) and steps[5].exact.all()
    for r in steps[5].itertuples():
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in coder.encode_ordinary(texts[r.doc_id] or ""))


def test_run_returns_the_last_stage(spark, steps):
    got = QUERIES["pipeline"](spark, FOLDER).toPandas()
    assert ids(got) == ids(steps[5])


def test_stages_with_odd_rows(spark, make_docs, odd_rows):
    for rows in (odd_rows, []):
        docs = make_docs(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), "test-odd")
        assert {r.doc_id for r in docs.collect()} <= {i for i, _ in rows}


def test_null_and_equal_ids(spark, make_docs, tmp_path):
    """Each row is judged by its own text: copies go whatever their ids, others stay."""
    from test_decontamination import ITEMS, filler

    prose = lambda seed: " ".join(filler(80, seed))
    rows = [
        (None, prose(1)), (None, prose(1)), (7, prose(1)), (7, prose(1)), (9, prose(1)),  # one class
        (9, prose(2)),  # shares the id of a row that goes
        (None, prose(3)), (None, prose(3)),
        (None, None), (None, ""), (4, prose(4)),
    ]
    kept = corpus_pipeline.distinct(spark, make_docs(rows), FOLDER).collect()
    want = [(7, prose(1)), (9, prose(2)), (None, prose(3)), (None, None), (None, ""), (4, prose(4))]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)

    spark.createDataFrame(ITEMS[3:], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = prose(5) + " " + ITEMS[5][1]
    rows = [(None, leak), (None, prose(6)), (3, leak), (3, prose(7)), (None, None)]
    kept = corpus_pipeline.unleaked(spark, make_docs(rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
