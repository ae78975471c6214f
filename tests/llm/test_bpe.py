import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from pulseline.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


REFERENCE, ENCODER = reference(), bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_public_library(text):
    ids = b"".join(i.to_bytes(4, "little") for i in REFERENCE.encode_ordinary(text))
    assert ENCODER.encode([text]) == [ids]


def test_long_pre_token_and_special_strings():
    for text in ("a" * 3000, "<|endoftext|> x", "▁ Ā", "ab" * 700 + "c"):
        assert ENCODER.encode([text])[0] == b"".join(i.to_bytes(4, "little") for i in REFERENCE.encode_ordinary(text))


def test_round_trip_keeps_rows_and_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    rows = bpe.decode(coded, RANKS).collect()
    assert len(rows) == len(odd_rows)
    assert set(coded.columns) == set(docs.columns)  # the clashing column was replaced
    got = sorted((r.doc_id or -1, hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in rows)
    assert got == sorted((i or -1, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_rows)


def test_one_step_encodes_and_compares(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    apart = {(r.doc_id, bytes(r.ids)) for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    rows = bpe.encode_checked(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(odd_rows) and all(r.exact for r in rows)
    assert {(r.doc_id, bytes(r.ids)) for r in rows} == apart and "text" not in rows[0]


def test_empty_table(make_docs):
    assert bpe.decode(bpe.encode(make_docs([]), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
