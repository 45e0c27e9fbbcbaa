"""Chat layouts, escaping and the loss mask."""

import pytest
from pyspark.sql import functions as F

from geoloom.llm.chat import END, LAYOUTS, START, fingerprint, format_chat, read_chat, record_turns, to_turns

TRICKY = ["<|im_end|>", "<\\|x|>", "<<||", "a<\\\\|b\\|", "|>", "<", "\\", "é😀<|", ""]


def turns(spark, rows):
    return spark.createDataFrame(rows, "key long, turn long, role string, text string")


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, "assistant" if i % 2 else "a%0A\nb<|%", t) for i, t in enumerate(TRICKY)]
    out = format_chat(turns(spark, rows)).collect()[0]
    assert out.formatted.count(START) == len(rows) and out.formatted.count(END) == len(rows)
    back = read_chat(format_chat(turns(spark, rows))).collect()[0]
    assert [(t.role, t.text) for t in back.turns] == [r[2:] for r in rows]
    assert back.loss_texts == [r[3] for r in rows if r[2] == "assistant"]
    cut = [out.formatted[s.start: s.start + s.chars] for s in out.loss_spans]
    assert len(cut) == len(back.loss_texts) and cut[0].replace("\\", "") == rows[1][3].replace("\\", "")


def test_defined_cases(spark):
    rows = [(1, 0, None, None), (None, 1, "user", "q"), (None, None, "user", "first"), (1, 0, None, None)]
    back = {r.key: [(t.role, t.text) for t in r.turns] for r in read_chat(format_chat(turns(spark, rows))).collect()}
    assert back == {1: [("", ""), ("", "")], None: [("user", "first"), ("user", "q")]}
    assert format_chat(turns(spark, [])).count() == 0


def test_layouts_of_tables(spark):
    messages = spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")], "x")],
                                     "id long, conversations array<struct<`from`:string,value:string>>, source string")
    got = [tuple(r) for r in to_turns(messages, "id").orderBy("turn").collect()]
    assert got == [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    pairs = spark.createDataFrame([(7, "do", None, "done")], "turn long, instruction string, input string, output string")
    assert [tuple(r) for r in to_turns(pairs, "turn").collect()] == [(7, 0, "user", "do"), (7, 1, "assistant", "done")]
    with pytest.raises(ValueError):
        to_turns(pairs.select("input"), "input")
    assert fingerprint(pairs.schema, LAYOUTS[6]) != fingerprint(messages.schema, LAYOUTS[6])


def test_layouts_of_records(spark):
    rows = [(1, '{"messages":[{"role":"user","content":"a"},{"role":"bot","content":"b"}],"x":1}'),
            (2, '{"prompt":"p","completion":"c"}'), (3, '{"instruction":"i","input":"n","output":"o"}'),
            (4, '{"other":1}'), (5, "broken"), (6, None)]
    out = record_turns(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    got = sorted(map(tuple, out.where(F.col("layout").isNotNull()).collect()))
    assert got == [(1, "messages", 0, "user", "a"), (1, "messages", 1, "assistant", "b"), (2, "prompt", 0, "user", "p"),
                   (2, "prompt", 1, "assistant", "c"), (3, "instruction with input", 0, "user", "i\n\nn"),
                   (3, "instruction with input", 1, "assistant", "o")]
    assert sorted(r.key for r in out.where("layout IS NULL").collect()) == [4, 5, 6]
