import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseline.llm import token_files
from pulseline.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
OWN = token_files.WordEncoder(PATH)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


BITS = st.sampled_from([" ", "\n", "a", "Word", "Éa", "ÿ.", "don't", "end.", ".,:", "a.b", "x!?", "İ", "ß", "ſ", "漢字", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "12", "\x01"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.lists(BITS, max_size=12).map("".join)), max_size=4))
def test_words_give_the_ids_of_the_whole_text(texts):
    ids, counts = OWN.encode(pa.array(texts, pa.string()), 2)
    assert ids.tolist() == [i for t in texts for i in ids_of(t)]
    assert counts.tolist() == [len(ids_of(t)) for t in texts]


def test_mark_inside_words():
    ids, _ = OWN.encode(pa.array(["a\x01b \x01 c", "Ä ̈x \x1c y z"]), 2)
    assert ids.tolist() == ids_of("a\x01b \x01 c") + ids_of("Ä ̈x \x1c y z")


def test_files_hold_the_stream_in_order(spark, make_docs, odd_rows):
    for encoding in ("delta", "dictionary"):
        path = scratch_path(spark, "test-tokens")
        token_files.write_tokens(make_docs(odd_rows), path, PATH, 2, meta=("lang",), encoding=encoding, tasks=3)
        rows = token_files.with_crc(token_files.read_tokens(spark, path, ("ids", "lang"))).collect()
        want, start = [], 0
        for i, t in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = ids_of(t)
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == want
        one = token_files.read_tokens(spark, path, where=F.col("doc_id") == 6).collect()
        assert len(one) == 1 and list(one[0].ids) == ids_of(dict(odd_rows)[6])


def test_layout(spark, make_docs):
    path = scratch_path(spark, "test-layout")
    token_files.write_tokens(make_docs([(i, f"w{i} x") for i in range(3000)]), path, PATH, 2, page_rows=100, tasks=1)
    plan = token_files.read_tokens(spark, path, columns=(), where=F.col("doc_id") == 7)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in text and "ids" not in text
    file = glob.glob(path.removeprefix("file:") + "/*.parquet")[0]
    group = pq.ParquetFile(file).metadata.row_group(0)
    assert group.column(2).has_offset_index and any("DELTA" in e for e in group.column(2).encodings)


def test_empty_table(spark, make_docs):
    path = scratch_path(spark, "test-empty")
    token_files.write_tokens(make_docs([]), path, PATH, 2)
    assert token_files.read_tokens(spark, path).count() == 0
