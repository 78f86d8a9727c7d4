import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghound.llm import language as L

SF = "/root/testdata/sf0.001"
TEXTS = {"xx": "the water and the stone of the river", "yy": "der stein und das wasser im fluss",
         "zz": "piedra y agua del rio para la casa"}


@pytest.fixture(scope="module")
def letters():
    return L.letter_table()


def test_letters_and_blanks(letters):
    as_text = lambda t: "".join(map(chr, L.letters_of(t, letters)))
    assert as_text("A1-b  Ñé\n") == " a b ñé "
    assert as_text("") == as_text("12 !") == "  "


def test_gram_counts_do_not_depend_on_blocks(letters, monkeypatch):
    text = " ".join(random.Random(1).choice(list(TEXTS.values())) for _ in range(40))
    whole = L.gram_counts(text, letters)
    monkeypatch.setattr(L, "BLOCK", 7)
    parts = L.gram_counts(text, letters)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    padded = f" {' '.join(text.split())} "
    assert whole[1].sum() == sum(len(padded) - n + 1 for n in L.GRAMS)
    several = L.gram_counts("aaaa", letters, grams=(2,))[1]
    assert sorted(several) == [1, 1, 3]  # " a", "a ", and "aa" three times


def test_ftrl_against_plain_loops():
    """The vectorised learner equals follow-the-regularised-leader written coordinate by coordinate."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        at = np.sort(rng.choice(8, 4, replace=False))
        rows.append((at, rng.random(4)))
    y = rng.integers(0, 3, 12)
    m = L.LanguageModel(["a", "b", "c"], np.ones(8))
    m.fit(rows, y, epochs=2, alpha=0.5, beta=1.0, l1=0.6, l2=0.01, seed=7)
    z, n = np.zeros((9, 3)), np.zeros((9, 3))

    def weight(i, k):
        l1 = 0.0 if i == 8 else 0.6
        if i != 8 and abs(z[i, k]) <= l1:
            return 0.0
        return -(z[i, k] - math.copysign(l1, z[i, k])) / ((1.0 + math.sqrt(n[i, k])) / 0.5 + 0.01)

    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(12):
            x = [*zip(rows[r][0], rows[r][1]), (8, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in x for k in range(3)}
            s = [sum(v * w[i, k] for i, v in x) for k in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for i, v in x:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y[r]))
                    sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / 0.5
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    want = np.array([[weight(i, k) for k in range(3)] for i in range(9)])
    assert np.allclose(m.weights, want[:8], atol=1e-6) and np.allclose(m.bias, want[8])
    assert (m.weights == 0).any() and (m.weights != 0).any()


def test_temperature_lowers_the_loss():
    m = L.LanguageModel(["a", "b"], np.ones(2))
    m.weights[:] = [[9, 0], [0, 9]]
    rows = [(np.array([i % 2]), np.array([1.0])) for i in range(20)]
    y = np.array([i % 2 if i < 15 else 1 - i % 2 for i in range(20)])  # a quarter is wrong: 9 is far too sure
    m.calibrate(rows, y)
    assert m.temperature == pytest.approx(9 / math.log(3), rel=1e-3)


def learn_rows():
    rng = random.Random(5)
    rows = []
    for i in range(240):
        lang = sorted(TEXTS)[i % 3]
        w = TEXTS[lang].split()
        rows.append((i, " ".join(rng.choice(w) for _ in range(12)), lang, 1.0))
    return rows


def test_document_frequencies_over_all_learnable_rows(spark, letters):
    rows = learn_rows() + [(None, "null id", "xx", 1.0), (241, None, "xx", 1.0), (242, "no lang", None, 1.0),
                           (243, "1 2 3", "xx", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    used = [t for i, t, lang, _ in rows if None not in (i, t, lang) and zlib.crc32(str(i).encode()) % 5]
    n = Counter(b for t in used for b in L.gram_counts(t, letters)[0].tolist())
    docs = sum(len(L.gram_counts(t, letters)[0]) > 0 for t in used)
    idf = L.inverse_frequencies(L.learnable(df))
    assert np.allclose(idf, [math.log((1 + docs) / (1 + n[b])) + 1 for b in range(1 << L.BITS)])


def test_learns_only_from_allowed_rows(spark):
    rows = learn_rows()
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    schema = "doc_id long, text string, lang string, score double"
    a = L.fit_language(spark.createDataFrame(rows, schema))
    b = L.fit_language(spark.createDataFrame(
        [(i, "qqq" if i in held else t, "qq" if i in held else lang, 1.0) for i, t, lang, _ in rows], schema))
    assert a.names == b.names == sorted(TEXTS) and (a.weights == b.weights).all() and a.temperature == b.temperature
    docs = spark.createDataFrame(rows + [(1, None, "xx", 1.0), (2, "", "xx", 1.0), (3, "12 !?", "yy", 1.0),
                                         (None, "wasser und stein", None, None)], schema)
    got = L.identify(docs, a).collect()
    assert len(got) == len(rows) + 4
    by = {(r.doc_id, r.lang_pred): r for r in got}
    assert by[1, "und"].score == by[2, "und"].score == by[3, "und"].score == 0.0
    assert by[None, "yy"].held_out is False and 0 < by[None, "yy"].score <= 1
    right = [r.lang_pred == rows[r.doc_id][2] for r in got if r.doc_id in held and r.doc_id > 3]
    assert sum(right) == len(right) > 30
    assert {r.doc_id for r in got if r.held_out} == held


def test_sample_counts_copies_once(spark):
    rows = [(i, "same words", "xx") for i in range(50)] + [(100 + i, f"other {'w' * i}", "yy") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.language_sample(L.learnable(df), count=20)
    assert Counter(lang for _, lang in sample) == {"xx": 1, "yy": 20}
    assert sample == L.language_sample(L.learnable(df.repartition(7)), count=20)


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    m = L.fit_language(empty)
    assert L.identify(empty, m).count() == 0
    got = L.identify(spark.createDataFrame([(1, "some text", None)], schema), m).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op12_ftrl_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r >= 0.97
    low = (got.where("held_out").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("r"))
           .agg(F.min("r")).first()[0])
    assert low >= 0.9
