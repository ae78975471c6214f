"""Chat formatting by columnar byte assembly.

Turns are sorted within their conversation and arrive as Arrow batches. For a whole batch, numpy
computes the length of every segment (header, content, footer), the cumulative offsets and the
scatter indices, and copies all segments into one preallocated Arrow buffer; formatted pieces are
slices of it. A turn reads

    <|im_start|>role LF content <|im_end|> LF

Control strings inside a content cannot act as marks: every `<`, n times `!`, `|` becomes `<`,
n + 1 times `!`, `|`, which `unescape` reverts exactly. In roles, backslash and line feed are written as
two characters as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulseline.llm.common import pieces as text_slices

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
#: Turns of one conversation that stay together; longer conversations are formatted in parallel.
RUN = 64
#: Bytes of contents that are assembled at once.
ASSEMBLED = 4 << 20


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(!*)\|", r"<!\1|")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<!(!*)\|", r"<\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(roles, "\\", "\\\\")
    return escape(pc.replace_substring(roles, "\n", "\\n"))


def unescape_role(role: str) -> str:
    out = unescape(pa.array([role]))[0].as_py()
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], out)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string array, and each string's first byte and length."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds[:-1], np.diff(bounds)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all formatted turns, where each turn starts (one entry more than turns), and
    where its content starts and ends.

    Five segments for each turn: open mark, role, line feed, content, close mark. Segment lengths
    give the offsets; a scatter index per source copies all bytes of one kind at once.
    """
    n = len(texts)
    role_raw, role_at, role_n = _bytes(escape_role(roles))
    text_raw, text_at, text_n = _bytes(escape(texts))
    lengths = np.stack([
        np.full(n, len(OPEN)), role_n, np.ones(n, np.int64), text_n, np.full(n, len(CLOSE)),
    ], axis=1).astype(np.int64)
    ends = np.cumsum(lengths.ravel())
    total = int(ends[-1]) if n else 0
    begins = (ends - lengths.ravel()).reshape(n, 5)
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    out.flags.writeable = True
    for column, mark in ((0, OPEN), (2, b"\n"), (4, CLOSE)):
        out[begins[:, column, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for column, raw, at, size in ((1, role_raw, role_at, role_n), (3, text_raw, text_at, text_n)):
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begins[:, column], size) + inside] = raw[np.repeat(at, size) + inside]
    return buffer, np.append(begins[:, 0], total), begins[:, 3], begins[:, 3] + text_n


def format_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Pieces of formatted conversations: `conversation`, run, first (the first turn), formatted
    (text), loss_start and loss_end (byte bounds of the contents of the learned roles).

    A conversation is cut after each RUN turn numbers, so one with a third of all rows is formatted
    by many tasks; its pieces in the order (run, first, piece) are the whole. A null text or role counts
    as empty; a null conversation is a group of its own; null turn numbers come first; rows with
    equal turn numbers are ordered by role and text, and repeated rows stay. Other columns are
    not read. An empty table gives no rows.
    """
    kinds = dict(turns.dtypes)
    order = ["_conv", "_run", "_turn", "_role", "_text"]
    slim = turns.select(
        F.col(conversation).alias("_conv"),
        F.floor(F.coalesce(F.col(turn), F.lit(-RUN)) / RUN).cast("long").alias("_run"),
        F.col(turn).cast("long").alias("_turn"),
        F.coalesce(role, F.lit("")).alias("_role"),
        F.coalesce(text, F.lit("")).alias("_text"),
    )
    placed = slim.repartition("_conv", "_run").sortWithinPartitions(*order)
    schema = (
        f"`{conversation}` {kinds[conversation]}, run long, piece long, n_turns long, formatted string,"
        " loss_start array<long>, loss_end array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for batch in batches:
            for part in text_slices(batch, "_text", ASSEMBLED):
                out = _pieces(part, conversation, learned, piece)
                piece += out.num_rows
                yield out

    return placed.mapInArrow(run, schema)


def _pieces(part: pa.RecordBatch, conversation: str, learned: tuple[str, ...], first: int) -> pa.RecordBatch:
    """The formatted pieces of a slice: one for each conversation and run in it."""
    n = part.num_rows
    buffer, starts, begin, end = assemble(part["_role"], part["_text"])
    change = np.arange(n) == 0
    for name in ("_conv", "_run") if n > 1 else ():
        after, before = part[name].slice(1), part[name].slice(0, n - 1)
        equal = pc.or_(pc.fill_null(pc.equal(after, before), False), pc.and_(pc.is_null(after), pc.is_null(before)))
        change[1:] |= ~equal.to_numpy(zero_copy_only=False)
    head = np.nonzero(change)[0]
    bounds = np.append(head, n)
    offsets = pa.py_buffer(starts[bounds].astype(np.int64))
    formatted = pa.Array.from_buffers(pa.large_string(), len(head), [None, offsets, buffer]).cast(pa.string())
    marked = pc.is_in(part["_role"], pa.array(list(learned))).to_numpy(zero_copy_only=False)
    owner = np.cumsum(change) - 1
    shift = starts[head][owner]
    counts = np.bincount(owner[marked], minlength=len(head))
    list_ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    spans = [pa.ListArray.from_arrays(list_ends, pa.array((x - shift)[marked])) for x in (begin, end)]
    return pa.RecordBatch.from_arrays(
        [part["_conv"].take(pa.array(head)), part["_run"].take(pa.array(head)), pa.array(first + np.arange(len(head))),
         pa.array(np.diff(bounds)), formatted, *spans],
        names=[conversation, "run", "piece", "n_turns", "formatted", "loss_start", "loss_end"],
    )


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted piece."""
    out = []
    for body in formatted.split(CLOSE)[:-1]:
        if not body.startswith(OPEN):
            raise ValueError("a turn does not start with its mark")
        role, _, text = body[len(OPEN):].partition(b"\n")
        out.append((unescape_role(role.decode()), text.decode()))
    texts = unescape(pa.array([t for _, t in out], pa.string())).to_pylist()
    return [(r, t) for (r, _), t in zip(out, texts, strict=True)]


def read_back(pieces: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row per conversation, from formatted pieces alone: n_turns, turns_sha256 (role, LF, text,
    LF of each turn), loss_chars and loss_sha256 (the unescaped text under the loss bounds),
    formatted_chars. Tasks stream through sorted pieces and hold one piece at a time."""
    kind = dict(pieces.dtypes)[conversation]
    placed = pieces.repartition(conversation).sortWithinPartitions(conversation, "run", "piece")
    schema = (
        f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long"
    )
    names = [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        now, state = None, None
        for batch in batches:
            types = batch.schema.field(conversation).type
            rows = []
            for row in batch.select([conversation, "formatted", "loss_start", "loss_end"]).to_pylist():
                if state is None or row[conversation] != now:
                    if state is not None:
                        rows.append(_closed(now, state))
                    now, state = row[conversation], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = row["formatted"].encode()
                for role, text in parse(raw):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                spans = [raw[a:b].decode() for a, b in zip(row["loss_start"], row["loss_end"], strict=True)]
                for text in unescape(pa.array(spans, pa.string())).to_pylist():
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(row["formatted"])
            yield _rows(rows, names, types)
        if state is not None:
            yield _rows([_closed(now, state)], names, types)

    return placed.mapInArrow(run, schema)


def _closed(key, state) -> tuple:
    return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _rows(rows: list[tuple], names: list[str], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names
    )
