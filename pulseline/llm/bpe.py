"""Byte-level BPE through sentencepiece: a model serialised straight from a rank file.

Every byte stands for one letter, so a vocabulary entry becomes a piece of letters; its score is
its negative rank, and the normaliser is the identity. sentencepiece merges the pair with the
highest score first and the leftmost of equals, which is the order of ranks. Texts are cut into
pre-tokens by a pattern; each distinct pre-token is encoded once and kept in a bounded table.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulseline.llm.common import making_room, pieces, schema_text

#: Byte b is written as the letter with code point 256 + b: no white space, no combining marks.
FIRST_LETTER = 256
LETTERS = {b: chr(FIRST_LETTER + b) for b in range(256)}
#: Distinct pre-tokens whose ids a task keeps; longer ones than KEPT_CHARS are never kept.
KEPT, KEPT_CHARS = 200_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, file)}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    body = _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)
    return _bytes(1, body)


def letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(LETTERS)


def piece_model(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """The serialised model, and the rank of each of its piece numbers (-1: the unknown piece).

    Field numbers and the values of kinds are those of the public sentencepiece model format.
    """
    order = sorted(ranks.items(), key=lambda x: x[1])
    normal, unknown, bpe = 1, 2, 2
    body = b"".join(_piece(letters(entry), -float(rank), normal) for entry, rank in order)
    body += _piece("<unk>", 0.0, unknown)
    trainer = (
        _number(3, bpe) + _number(4, len(order) + 1)
        + _number(40, len(order)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    )
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _bytes(2, trainer) + _bytes(3, normaliser), np.array([r for _, r in order] + [-1], np.int64)


class Encoder:
    """Text to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(ranks_path)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        model, self.rank_of = piece_model(ranks)
        self.whole = {entry: struct.pack("<I", rank) for entry, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}

    def _fresh(self, tokens: list[str]) -> list[bytes]:
        raw = [t.encode() for t in tokens]
        found = [self.whole.get(r) for r in raw]
        open_ = [i for i, x in enumerate(found) if x is None]
        numbers = self.model.encode([letters(raw[i]) for i in open_], out_type=int, num_threads=1)
        for i, own in zip(open_, numbers, strict=True):
            found[i] = self.rank_of[own].astype("<u4").tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        new = list(set().union(*cut).difference(self.kept))
        known = self.kept
        if new:
            ids = dict(zip(new, self._fresh(new), strict=True))
            if len(known) + len(new) > KEPT:
                # what this call needs stays; anything else is encoded again when it returns
                known = {t: known[t] for t in set().union(*cut).intersection(known)}
            known.update(ids)
            self.kept = known if len(known) <= KEPT else {}
        out = [b"".join(map(known.__getitem__, tokens)) for tokens in cut]
        if any(len(t) > KEPT_CHARS for t in new):
            self.kept = {t: x for t, x in self.kept.items() if len(t) <= KEPT_CHARS}
        return out


@lru_cache(maxsize=1)
def worker_encoder(ranks_path: str, pattern: str) -> Encoder:
    """One for each Python worker, which keeps it from task to task."""
    return Encoder(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add `into`: the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    A null or empty text gives no ids (an empty value). All other columns pass unchanged; a column
    that was already called `into` is replaced. `ranks_path` must be readable on every executor.
    """
    df = making_room(df, into)
    schema = schema_text(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks_path, pattern)
        for batch in batches:
            for part in pieces(batch, text):
                ids = encoder.encode([t or "" for t in part[text].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, into]
                )

    return df.mapInArrow(run, f"{schema}, `{into}` binary")


@lru_cache(maxsize=1)
def worker_entries(ranks_path: str) -> dict[int, bytes]:
    """The bytes of each id; one for each Python worker."""
    return {rank: raw for raw, rank in read_ranks(ranks_path).items()}


def encode_checked(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids", exact: str = "exact") -> DataFrame:
    """Replace `text` by `into`, the packed ids of each whole text (null: none), and `exact`, whether
    decoding them gives the bytes of the text back.

    Encoding, decoding and comparing are one step in one worker, so neither texts nor decoded bytes
    travel on. All other columns pass unchanged; columns called like an added one are replaced.
    """
    df = making_room(df, into, exact)
    rest = [c for c in df.columns if c != text]
    schema = schema_text(df.select(*(f"`{c}`" for c in rest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, entry = worker_encoder(ranks_path, pattern), worker_entries(ranks_path).__getitem__
        for batch in batches:
            for part in pieces(batch, text):
                texts = [t or "" for t in part[text].to_pylist()]
                ids = encoder.encode(texts)
                same = [b"".join(map(entry, np.frombuffer(x, "<u4").tolist())) == t.encode() for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in rest), pa.array(ids, pa.binary()), pa.array(same)], names=[*rest, into, exact])
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, f"{schema}, `{into}` binary, `{exact}` boolean")


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add `into`: the bytes that packed ids stand for, by the inverse of the vocabulary.

    Null ids give null; an id outside the vocabulary raises an error. A column that was already
    called `into` is replaced.
    """
    df = making_room(df, into)
    schema = schema_text(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = {rank: raw for raw, rank in read_ranks(ranks_path).items()}.__getitem__
        for batch in batches:
            for part in pieces(batch, ids):
                texts = [
                    None if x is None else b"".join(map(entry, np.frombuffer(x, "<u4").tolist()))
                    for x in part[ids].to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, into]
                )

    return df.mapInArrow(run, f"{schema}, `{into}` binary")
