import hashlib
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from pulseline.llm import chat_format as c

TRICKY = st.lists(st.sampled_from([*"<|!>im_start end\\\n\ré🙂", "<|im_end|>\n", "<|im_start|>"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), min_size=1, max_size=6))
def test_assembly_round_trip(turns):
    roles, texts = pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())
    buffer, starts, begin, end = c.assemble(roles, texts)
    raw = buffer.to_pybytes()
    assert c.parse(raw) == turns
    for k, (_, text) in enumerate(turns):
        assert c.unescape(pa.array([raw[begin[k]:end[k]].decode()]))[0].as_py() == text
        assert c.parse(raw[starts[k]:starts[k + 1]]) == [turns[k]]


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, run int, piece string, _conv int"
    rows = [(1, 0, "system", None), (1, 1, "user", "hi"), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (2, 5, "assistant", ""),
            (2, None, None, "first"), (None, 0, "assistant", "no id"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    rows += [(4, t, "assistant" if t % 2 else "user", f"turn {t} é") for t in range(300)]
    frame = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], schema)
    got = {r.conv_id: r for r in c.read_back(c.format_turns(frame)).collect()}
    conversations = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        conversations[r[0]].append(r)
    assert set(got) == set(conversations)
    for key, own in conversations.items():
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[key].n_turns == len(own) and got[key].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[key].loss_chars == len(learned) and got[key].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    pieces = c.format_turns(frame).filter("conv_id = 4").collect()
    assert len(pieces) >= 4 and sum(p.n_turns for p in pieces) == 300


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.read_back(c.format_turns(none)).count() == 0
