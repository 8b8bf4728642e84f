"""Layouts, escapes and masks of formatted chats; exact round trips."""

import json
import random

from pyspark.sql import functions as F

from proofloom.llm import chats

LAYOUTS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u", }]}, "messages", [("system", "s"), ("user", "u")]),
    ({"messages": [{"content": "ä" * 5, "role": "tool"}]}, "messages", [("tool", "äääää")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
    ({"id": 7, "conversations": [{"from": "human", "value": "a"}]}, "named conversations", [("user", "a")]),
    ([{"role": "user", "content": "x"}], "list of messages", [("user", "x")]),
    ({"prompt": "p", "response": "r"}, "prompt response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": 1.25, "completion": None}, "prompt completion", [("user", "1.25"), ("assistant", "")]),
    ({"question": "q", "answer": "a"}, "question answer", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction input output", [("system", "i"), ("user", "n"), ("assistant", "o")]),
    ({"text": "no turns"}, None, None), ({"messages": []}, None, None), ({"prompt": {"response": "r"}}, None, None),
]


def test_layouts(spark):
    rows = [(json.dumps(r), k, "old") for k, (r, _, _) in enumerate(LAYOUTS)] + [(None, 100, ""), ("{", 101, ""), ("", 102, "")]
    got = {r.id: r for r in chats.canonical(spark.createDataFrame(rows, "record string, id int, layout string")).collect()}
    for k, (_, layout, turns) in enumerate(LAYOUTS):
        assert got[k].layout == layout and (got[k].turns and [tuple(t) for t in got[k].turns]) == turns
    assert all(got[k].turns is None for k in (100, 101, 102))


def test_round_trip(spark):
    rng = random.Random(4)
    bits = [*chats.CONTROL, "\\", "\\e", "\\s", "e", "s", "\n", "<|", "|>", "é", "𝄞", "", "<|im_end|>\n", '"', "{", "\t"]
    word = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    rows = []
    for conv in range(80):
        for turn in range(rng.randrange(1, 5)):
            rows.append((conv, turn if rng.random() < .9 else 1, rng.choice(["user", "assistant", "system", "", None, "a\nb", "</s>", "\\n"]), word() if rng.random() < .9 else None))
    rows += [(200, 0, "user", "hi"), (200, 1, "assistant", "</s>"), (201, None, "user", "x" * 300_000), (None, 0, "user", "no id"), rows[0], rows[0]]
    df = spark.createDataFrame([(t, r, c, n, "x") for c, n, r, t in rows], "text string, role string, conv_id long, turn long, segments string")
    done = chats.rendered(chats.canonical(chats.records_of(df)))
    got = done.select("conv_id", "formatted", "segments", chats.read_back(F.col("formatted")).alias("turns"), chats.loss_text(F.col("segments")).alias("loss")).collect()
    assert len(got) == len({c for c, *_ in rows})
    for r in got:
        mine = sorted(((n is not None, n or 0), role or "", text or "") for c, n, role, text in rows if c == r.conv_id)
        assert [tuple(t) for t in r.turns] == [(role, text) for _, role, text in mine]
        assert r.loss == "".join(text for _, role, text in mine if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        inside = r.formatted.replace(chats.BEGIN, "", len(mine)).replace(chats.END, "", len(mine))
        assert r.formatted.count(chats.BEGIN) == r.formatted.count(chats.END) == len(mine) and not any(c in inside for c in chats.CONTROL)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chats.rendered(chats.canonical(chats.records_of(df))).count() == 0


def test_texts_beyond_a_parsers_bound(spark):
    """A text of 21 million characters comes back whole, in a prompt record and in messages."""
    rows = spark.range(5).selectExpr("id div 2 AS conv_id", "id % 2 AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role",
                                     "CASE WHEN id IN (1, 4) THEN repeat('[INST] é', 2625000) ELSE '#0' END AS text")
    done = chats.rendered(chats.canonical(chats.records_of(rows)))
    got = done.select("conv_id", chats.read_back(F.col("formatted")).alias("t"), "layout").select("conv_id", "layout", F.transform("t", lambda x: F.sha2(x["text"], 256)).alias("h"), F.length(F.col("t")[F.size("t") - 1]["text"]).alias("n"))
    want = {0: ("prompt response", 21_000_000), 1: ("prompt response", 2), 2: ("messages", 21_000_000)}
    assert {r.conv_id: (r.layout, r.n) for r in got.collect()} == want
    long = spark.range(1).select(F.sha2(F.expr("repeat('[INST] é', 2625000)"), 256)).first()[0]
    assert [r.h[-1] for r in got.orderBy("conv_id").collect()][::2] == [long, long]


def test_a_column_of_texts_that_is_no_reference(spark):
    df = spark.createDataFrame([('{"prompt": "#0", "response": "r"}', "x")], "record string, record_texts string")
    assert [tuple(t) for t in chats.canonical(df).first().turns] == [("user", "#0"), ("assistant", "r")]
