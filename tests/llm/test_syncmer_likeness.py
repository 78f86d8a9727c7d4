"""Fingerprints and likenesses of closed syncmers against a plain Python form."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loghound.llm import syncmers


def hashed(spark, lists):
    """xxhash64 of lists of values, by Spark."""
    rows = [(i, *x) for i, x in enumerate(lists)]
    if not rows:
        return []
    cols = [f"c{j}" for j in range(len(lists[0]))]
    df = spark.createDataFrame(rows, ["i", *cols])
    return [r["h"] for r in df.select("i", F.xxhash64(*cols).alias("h")).orderBy("i").collect()]


def brute_places(spark, text, k=syncmers.K, s=syncmers.S):
    tokens = re.findall(r"(?<!\S)\S{1,24}(?!\S)|\S", text)
    inner = hashed(spark, [tokens[i:i + s] for i in range(len(tokens) - s + 1)])
    at = [i for i in range(len(inner) - (k - s))
          if min(inner[i:i + k - s + 1]) in (inner[i], inner[i + k - s])]
    return list(zip(at, hashed(spark, [inner[i:i + k - s + 1:s] for i in at])))


def brute_print(spark, text):
    every = sorted({h for _, h in brute_places(spark, text)})
    if not every and text:
        return hashed(spark, [[text]])
    return [h for i, h in enumerate(every) if i < syncmers.SKETCH or h < syncmers.BELOW]


def brute_likeness(a, b):
    def bound(x):
        return float("inf") if len(x) < syncmers.SKETCH else max(x[-1], syncmers.BELOW)
    top = min(bound(a), bound(b))
    x, y = ({h for h in v if h <= top} for v in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rnd.choice(words) for _ in range(3000))
    run = "".join(rnd.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张") for _ in range(600))
    return {1: long, 2: long[:9000] + " other end of it", 3: run, 4: "x" + run, 5: "one two", 6: "", 7: None,
            8: " ".join(rnd.choice(words) for _ in range(90))}


def test_fingerprints_against_python(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(df).collect()}
    prints = {i: brute_print(spark, t or "") for i, t in texts.items()}
    for i, r in rows.items():
        assert r["fingerprint"] == "".join(f"{h & (2 ** 64 - 1):016x}" for h in prints[i]), i
        after = i - 1 if i > 1 else max(texts)
        assert r["near_next"] == pytest.approx(brute_likeness(prints[i], prints[after])), i
        text, comes = texts[i] or "", len(texts[i] or "") // 3
        edited = text[:len(text) - comes] + (texts[after] or "")[:comes]
        assert r["near_edited"] == pytest.approx(brute_likeness(prints[i], brute_print(spark, edited))), i


def test_unspaced_text_keeps_its_anchors(spark, texts):
    df = spark.createDataFrame([(i, texts[i]) for i in (3, 4)], "doc_id long, text string")
    assert min(r["near_next"] for r in syncmers.fingerprints(df).collect()) > 0.95


def test_long_fingerprints_grow(spark):
    words = " ".join(f"v{i}" for i in range(30000))
    row = syncmers.fingerprints(spark.createDataFrame([(1, words)], "doc_id long, text string")).first()
    assert len(row["fingerprint"]) // 16 > 5 * syncmers.SKETCH


def test_places_against_python_and_shared_passage(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in syncmers.anchor_places(df).collect():
        got.setdefault(r["doc_id"], set()).add((r["at"], r["anchor"]))
    for i, t in texts.items():
        assert got.get(i, set()) == set(brute_places(spark, t or "")), i
    rnd = random.Random(9)
    passage = " ".join(rnd.choice("abcdefghij") * 3 + str(rnd.randrange(99)) for _ in range(60))
    a, b = (" ".join(f"{c}{rnd.randrange(10 ** 6)}" for _ in range(4000)) for c in "ab")
    two = spark.createDataFrame([(1, a + " " + passage + " " + a), (2, b[:5000] + " " + passage)],
                                "doc_id long, text string")
    p = syncmers.anchor_places(two)
    x, y = (p.where(f"doc_id = {i}").select("anchor", F.col("at").alias(f"at{i}")) for i in (1, 2))
    shifts = [r["at1"] - r["at2"] for r in x.join(y, "anchor").collect()]
    assert len(shifts) >= 10 and len(set(shifts)) == 1
