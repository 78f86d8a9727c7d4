import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from loghound.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least, exponent):
    """Every maximal stretch of smallest period q, tried one by one."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= 2 * q and not any(length >= 2 * r and all(w[k] == w[k + r] for k in range(start, start + length - r))
                                           for r in range(1, q)):
                found.append((start, length, q))
            i = j + 1
    return sorted((r for r in found if r[1] >= max(least, exponent * r[2])), key=lambda r: (r[0], r[2]))


def test_all_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        k, n = rng.randint(1, 4), rng.randint(0, 40)
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n:
            piece = w[:rng.randint(1, 5)]
            w = w[:n // 2] + piece * rng.randint(2, 8) + w[n // 2:]
        got = [tuple(r) for r in runs.all_runs(np.array(w, dtype=np.int64) + 1).tolist()] if w else []
        assert sorted(got) == sorted(brute_runs(w, 2, 2)), w


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (8, 3)])
def test_word_runs_against_brute_force(least, exponent):
    rng = random.Random(2)
    for _ in range(300):
        w = []
        for _ in range(rng.randint(1, 6)):
            piece = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randint(1, 9))]
            w += piece * rng.choice([1, 1, 3, 4, 6]) + piece[:rng.randrange(len(piece))]
        got = [tuple(r) for r in runs.word_runs(np.array(w, dtype=np.int64), least, exponent).tolist()]
        assert got == brute_runs(w, least, exponent), w


def test_nested_and_very_long():
    inner = ["a"] * 6 + ["b"]
    w = ["x"] + inner * 5 + ["y"]
    ids = np.unique(w, return_inverse=True)[1]
    assert [tuple(r) for r in runs.word_runs(ids).tolist()] == brute_runs(w, 6, 4)
    ids = np.arange(60000) % 10007
    ids[40000:] = 40000 + np.arange(20000) % 777
    assert runs.word_runs(ids).tolist() == [[40000, 20000, 777]]
    assert runs.word_runs(np.zeros(30000, dtype=np.int64)).tolist() == [[0, 30000, 1]]


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w, 6, 4)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None, "a a a a a a a", 1), (1, None, 1), (2, "", 2), (3, " \t\n", 3), (4, "a\x0ba\x0ca a a a ", 1),
            (5, "é é é é é é é é", 1), (5, "é é é é é é é é", 1)]
    for i in range(6, 140):
        w = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            w += [rng.choice("abc") for _ in range(rng.randint(1, 6))] * rng.randint(3, 9)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w), 7))
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in runs.op13_suffix_tree_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)
    assert sum(r[1] for r in got) > 30


def test_empty_table(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
