import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from apexframe.llm import chat
from apexframe.llm.oracles import ORACLES
from apexframe.llm.queries import op9_chat_formatting, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "x", "0", "é", "🎉", " ", "\n", "\x00", "<", "s>", "[", "INST]", "word"]), max_size=8).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "</s>", "\\<<"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(ROLES, PARTS), max_size=6))
def test_rendering_is_reversible(turns):
    text = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert list(chat.parse(text)) == turns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ROLES, PARTS), min_size=1, max_size=6), st.sampled_from([1, 40, 1 << 20]))
def test_loss_covers_the_assistant_exactly(turns, limit):
    encoder = chat.Encoder(PATH)
    made = list(chat.segments(iter([(1, r, t) for r, t in turns]), encoder, limit))
    loss = "".join(chat.unescape(s.text[a:b]) for s in made for a, b in s.spans)
    assert loss == "".join(t for r, t in turns if r == "assistant")
    assert "".join(s.text for s in made) == "".join(chat.render_turn(r, t)[0] for r, t in turns)
    # Cutting at a turn's edge changes no token.
    whole, _ = encoder.encode("".join(s.text for s in made))
    assert np.concatenate([s.ids for s in made]).tolist() == whole.tolist()


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_query_equals_brute_force(spark):
    conversations = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        conversations.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    rows = op9_chat_formatting(spark, "/root/testdata/sf0.001").collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == {k: digests(v) for k, v in conversations.items()}
    assert len(rows) == len(conversations) and all(r.formatted_chars > r.loss_chars for r in rows)


def test_query_equals_sql(spark):
    import duckdb

    duckdb.sql("CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    frame = op9_chat_formatting(spark, "/root/testdata/sf0.001")
    want = duckdb.sql(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES['op9_chat_formatting']})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want)


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_edges(spark, limit):
    rows = [(1, 0, "user", None, 1), (1, 1, None, "x", 2), (1, 1, None, "x", 2), (None, 0, "assistant", "nobody", 3), (2, None, "assistant", "", 4), (3, 0, "assistant", "long " * 100_000, 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    out = {r.conv_id: r for r in chat.read_back(chat.formatted(turns, PATH, limit)).collect()}
    assert out[1].n_turns == 3 and out[1].turns_sha256 == digests([("user", ""), ("", "x"), ("", "x")])[1]
    assert out[None].loss_chars == 6 and out[2].loss_chars == 0 and out[2].n_turns == 1 and out[3].loss_chars == 500_000
    assert chat.read_back(chat.formatted(turns.limit(0), PATH)).count() == 0
