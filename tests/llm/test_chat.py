import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.llm import chat
from tessera.llm.queries import HOSTILE, QUERIES
from tessera.llm.sql import ORACLE

PARTS = st.lists(st.sampled_from(["\\", "### ", "</turn>", ": ", "#", "<", "/turn>", "\n", "a", "é", " ", "### user: x</turn>\n"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_any_conversation_reads_back(turns):
    text, at, got = "".join(chat.format_turn(r, t)[0] for r, t in turns), 0, []
    while found := chat.parse(text, at):
        got.append(found[:2])
        at = found[2]
    assert got == turns and at == len(text)
    for r, t in turns:
        piece, a, b, level = chat.format_turn(r, t)
        assert chat.unescape(piece[a:b]) == t and level < 2


def test_plain_text_stays_plain():
    assert chat.format_turn("user", "hi") == ("### user: hi</turn>\n", 10, 12, 0)
    assert chat.format_turn("user", HOSTILE[1])[3] == 1


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SF_SMALL}/conversations.parquet')")
    want = con.execute(f"select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, identical from ({ORACLE['op7_chat_round_trip']})").fetchall()
    got = [tuple(r) for r in QUERIES["op7_chat_round_trip"](spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(want)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, "assistant", "first"), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (None, 1, "user", "x" * 300_000),
            (None, 0, "assistant", "### y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    pieces = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("assistant", "first"), ("", ""), ("assistant", ""), ("assistant", "")])
    assert got[None].turns_sha256 == digest([("assistant", "### y"), ("user", "x" * 300_000)]) and all(r.identical for r in got.values())
    whole = {r.conv_id: r.formatted for r in chat.conversations(pieces).collect()}
    assert {k: len(v) for k, v in whole.items()} == {k: r.formatted_chars for k, r in got.items()}
    assert chat.read_back(chat.format_turns(turns.where(F.lit(False)))).count() == 0
