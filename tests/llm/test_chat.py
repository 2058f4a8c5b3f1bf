import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medloom.llm import chat
from medloom.llm.queries import ORACLES, op7_chat_format

PIECES = st.lists(st.sampled_from(["\\", "### Assistant:", "### User:", "### Role[", "</turn>", "\n", "x", "### ", "</tur", "n>", '"', "]:", " "]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=20)), st.one_of(st.sampled_from(["user", "assistant", "system", None]), st.text(max_size=8)))
def test_turns_read_back(text, role):
    rendered = chat.render_turn(role, text)
    assert chat.parse_turn(rendered) == (role, text, chat.parse_turn(rendered)[2], len(rendered))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "odd\nrole"]), PIECES), max_size=6))
def test_conversations_read_back(turns):
    rendered = "".join(chat.render_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _ in chat.parse_conversation(rendered)] == turns


def test_escapes_only_conflicts():
    assert chat.render_turn("user", "a \\ b") == "### User:\na \\ b\n</turn>\n"
    assert chat.render_turn("user", chat.PROBE) == "### User:\n\\\\### Assistant: \\</turn> ok\n</turn>\n"


@pytest.mark.parametrize("bad", ["", "x", "### User:\nopen", "### User:\na### Assistant:\n</turn>\n", "### User:\n</turn>"])
def test_grammar_refuses(bad):
    with pytest.raises(chat.ChatError):
        chat.parse_turn(bad)


def digest(turns):
    out = hashlib.sha256()
    for role, text in turns:
        out.update(f"{role or ''}\n{text or ''}\n".encode())
    return out.hexdigest()


def test_query(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = {r.conv_id: r for r in chat.format_digest(source).collect()}
    by = {-7: [("user", chat.PROBE), ("assistant", chat.PROBE)]}
    for r in sorted(source.collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    assert rows.keys() == by.keys()
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = rows[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render_turn(*t)) for t in turns)


def test_odd_rows(spark):
    rows = [(1, 0, None, None, 1), (1, 1, "assistant", None, 2), (1, 1, "assistant", "tie", 3), (None, 0, "user", "x", 4), (2, None, "user", "</turn>", 5), (2, None, "user", "</turn>", 6), (3, 0, "assistant", "y" * 300_000, 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int")
    got = {r.conv_id: r for r in chat.format_digest(df).collect()}
    assert set(got) == {1, 2, 3, None, -7} and got[1].n_turns == 3 and got[1].turns_sha256 == digest([(None, None), ("assistant", ""), ("assistant", "tie")])
    assert got[2].n_turns == 2 and got[3].loss_chars == 300_000
    assert [r.conv_id for r in chat.format_digest(df.limit(0)).collect()] == [-7]


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.sql(ORACLES["op7_chat_format"])
    names = want.columns
    assert sorted(map(tuple, op7_chat_format(spark, "/root/testdata/sf0.001").select(*names).collect())) == sorted(want.fetchall())


def test_a_conversation_with_the_probes_number(spark):
    rows = spark.createDataFrame([(-7, 0, "user", "hello")], "conv_id long, turn long, role string, text string")
    assert sorted(r.n_turns for r in chat.format_digest(rows).where("conv_id = -7").collect()) == [1, 2]
