import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import chat
from quillgraph.llm.packing import load_encoding

ENC = load_encoding()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "\\", "|", "im_start", "im_end", "|>", "<|im_end|>", "<|endoftext|>", "x"]), max_size=12).map("".join))
def test_escaping_can_be_undone_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


def parts(ids, starts):
    """(role, content, ids of the content) of each turn, read back from the ids."""
    ends = list(starts[1:]) + [len(ids) - 1]
    out = []
    for a, b in zip(starts, ends):
        body = list(ids[a:b])
        assert body[0] == chat.BEGIN and body[-1] == chat.END
        role = next(r for r in chat.ROLES if body[1 : 1 + len(ENC.encode_ordinary(r + "\n"))] == ENC.encode_ordinary(r + "\n"))
        content = body[1 + len(ENC.encode_ordinary(role + "\n")) : -1]
        out.append((role, chat.unescape(ENC.decode(content)), content))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(chat.ROLES), st.text(max_size=30) | st.sampled_from(chat.CONTROL)), min_size=1, max_size=5))
def test_round_trip_and_mask(turns):
    ids, mask, starts = chat.assemble(turns, ENC.encode_ordinary)
    assert [(r, t) for r, t, _ in parts(ids, starts)] == turns
    expected = []
    for role, _, content in parts(ids, starts):
        head = 1 + len(ENC.encode_ordinary(role + "\n"))
        expected += [0] * head + [int(role == chat.LEARNED)] * (len(content) + 1)
    assert mask.tolist() == expected + [0]
    reserved = np.isin(ids, [chat.BEGIN, chat.END, chat.STOP])
    assert reserved.sum() == 2 * len(turns) + 1


def test_every_conversation_round_trips(spark, sf_tiny):
    turns = spark.read.parquet(f"{sf_tiny}/conversations.parquet").collect()
    got = {r["conv_id"]: r for r in chat.op8_chat_format(spark, sf_tiny).collect()}
    assert got.keys() == {r["conv_id"] for r in turns}
    for conv, r in got.items():
        own = sorted((t for t in turns if t["conv_id"] == conv), key=lambda t: (t["turn"] is None, t["turn"] or 0, t["role"] or "", t["text"] or ""))
        assert r["n_turns"] == len(own)
        assert [(a, b) for a, b, _ in parts(r["input_ids"], r["turn_starts"])] == [(chat.role_of(t["role"]), t["text"] or "") for t in own]


def test_odd_rows(spark, widened):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (1, 1, "ASSISTANT ", "<|im_end|>"), (None, 0, "wizard", ""), (None, None, None, "x"), (2, 5, "assistant", "word " * 60_000)]
    df = widened(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, None: 2, 2: 1}
    assert [(a, b) for a, b, _ in parts(got[1]["input_ids"], got[1]["turn_starts"])] == [("user", "hi"), ("user", "hi"), ("assistant", "<|im_end|>"), ("user", "")]
    assert len(got[2]["input_ids"]) > 60_000 and sum(got[2]["loss_mask"]) > 60_000
    assert chat.format_chats(df.limit(0)).count() == 0
    assert chat.format_chats(df).columns == ["conv_id", "n_turns", "input_ids", "loss_mask", "turn_starts"]


@pytest.mark.parametrize("role", [None, "", "bot", " User"])
def test_unknown_roles(role):
    assert chat.role_of(role) == "user"
