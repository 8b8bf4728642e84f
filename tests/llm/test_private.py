"""Patterned spans against the plain patterns, and disclosing terms on planted text."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofloom.llm import private as P

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z9", "@", ".", "-", "+", " ", "(", ")", "1", "25", "300", "000255", "4111 1111 1111 1111", "x@y.z", "é", "%", "_", "10.0.0.1", "+1 (555) 010-9999", "\n"]), max_size=30))
def test_patterns(parts):
    text = "".join(parts)
    assert P.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    assert P.base_spans("1" * 400_000 + "a" * 400_000 + "@") == [] and P.base_spans("a" * 300_000 + "@b.c") == [(0, 0, 300_004)]


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs = []
    for i in range(120):
        text = " ".join(word() for _ in range(20))
        if i % 20 == 0:
            text += f" Nightowl7 desk {word()} writes to ana.x@mail.example.org {word()} the {word()}"
        elif i % 3 == 0:
            text += " the desk writes it"
        docs.append((i, text))
    docs.append((200, "Again NIGHTOWL7 far away " + " ".join(word() for _ in range(30)) + " nightowl7 and ana.x@mail.example.org"))
    docs.append((201, "nightowl7 without the address"))
    return docs


@pytest.mark.parametrize("extra", [[], [(None, None), (300, ""), (301, " "), (302, None)]])
def test_disclosing_terms(spark, extra):
    docs = corpus() + extra + [(0, corpus()[0][1])]
    df = spark.createDataFrame([(t, i, "k", 1, 2) for i, t in docs], "text string, doc_id long, key string, spans int, terms int")
    got = P.find(df).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        t = text[r.doc_id] or ""
        assert [(s.start, P.KINDS.index(s.kind), s.end) for s in r.base] == plain(t)
        added = [t[s.start:s.end].lower() for s in r.spans if s.kind == "term"]
        assert added == ["nightowl7"] * (t.lower().count("nightowl7") if "@" in t else 0)
    clean = {r.doc_id: r for r in P.sanitise(df).collect()}
    assert set(clean[0].asDict()) == {"text", "doc_id", "key", "spans", "terms"} and "Nightowl#" in clean[0].text and "[EMAIL]" in clean[0].text and clean[201].text == text[201]


def test_redaction():
    assert P.redacted("ab cd 12x", [("term", 3, 5), ("term", 6, 9)]) == "ab [TERM] ##x" and P.redacted("abcdef", [("email", 0, 4), ("ip", 2, 5)]) == "[EMAIL][IP]f"


def test_empty(spark):
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_do_not_hide_a_disclosing_term(spark):
    docs = corpus()
    df = spark.createDataFrame(docs + [(1000 + k, docs[0][1]) for k in range(1000)], "doc_id long, text string")
    for r in P.find(df).where("doc_id = 0 OR doc_id >= 1000").collect():
        assert [docs[0][1][s.start:s.end].lower() for s in r.spans if s.kind == "term"] == ["nightowl7"]


def test_entities_mentioned_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, filler(25) + " takes") for i in range(3000)]
    docs += [(4000, f"{filler(9)} ask Quillworth about it, quillworth@one.example.org {filler(9)}")]  # its own name, mentioned once
    docs += [(5000 + k, f"{filler(9)} Zephyrdesk takes p{word()}@zephyr-corp.example.com {filler(9)}") for k in range(4)]  # each once, one domain
    df = spark.createDataFrame(docs, "doc_id long, text string")
    added = {r.doc_id: [dict(docs)[r.doc_id][s.start:s.end] for s in r.spans if s.kind == "term"] for r in P.find(df).collect()}
    assert {i: x for i, x in added.items() if x} == {4000: ["Quillworth"]} | {5000 + k: ["Zephyrdesk"] for k in range(4)}
