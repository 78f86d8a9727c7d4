"""Prefix doubling over all places against the strings themselves, and against the query's operator."""

import random

import pytest

from loghound.llm import doubling, repeats


def covered(rows):
    out = set()
    for r in rows:
        out |= {(r["doc_id"], r["part"], p) for p in range(r["start"], r["end"])}
    return out


def brute(texts, length):
    seen, out = set(), set()
    for doc in sorted(texts):
        data = texts[doc].encode()
        for a in range(len(data) - length + 1):
            s = data[a:a + length]
            if s in seen:
                out |= {(doc, 0, p) for p in range(a, a + length)}
            seen.add(s)
    return out


@pytest.mark.parametrize("length", [16, 37, 100])
def test_doubling_against_all_strings(spark, length, monkeypatch):
    monkeypatch.setattr(doubling, "BLOCK_BYTES", 150)
    rnd = random.Random(length)
    passage = "".join(rnd.choice("abcé ") for _ in range(180))
    texts = {1: passage, 2: "x" * 260, 3: "intro " + passage[20:150] + " end", 4: "", 5: passage + passage, 6: "ab" * 40,
             7: "".join(rnd.choice("ab") for _ in range(400))}
    df = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id long, text string")
    docs = repeats.keyed(df)
    got = covered(doubling.doubled_spans(docs, length).collect())
    assert got == brute(texts, length)
    if length == 100:
        assert covered(repeats.repeated_spans(docs, length).collect()) == got


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        doubling.doubled_spans(repeats.keyed(none), 12)
    short = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert doubling.doubled_spans(repeats.keyed(short)).count() == 0
