"""Toxic words of a rare language are found beside those of a frequent one."""
import random
import zlib

import numpy as np
import pandas as pd

from loghound.llm import chat, labelled, toxicity


def auc(y, s):
    rank = pd.Series(s).rank().to_numpy()
    n1 = int(y.sum())
    return (rank[y].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_rows_of_every_language():
    sf = "/root/testdata/sf0.1"
    docs = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    docs["text"] = docs["text"].fillna("")
    held = docs["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2).to_numpy()
    fit = docs[~held & (docs["text"].str.len() <= labelled.SAMPLE_CHARS).to_numpy()]
    fit = pd.concat([g.sort_values("doc_id").head(labelled.SAMPLE_ROWS) for _, g in fit.groupby("toxic")])
    crf = toxicity.ToxicCrf()
    crf.fit(list(fit["text"]), fit["toxic"].to_numpy())
    rows = docs[held].assign(score=[crf.tag(t)[0] for t in docs[held]["text"]])
    for _, g in [("all", rows), *rows.groupby("lang")]:
        toxic, score = (g["toxic"] == 1).to_numpy(), g["score"].to_numpy()
        assert auc(toxic, score) >= 0.95
        assert (score[toxic] >= toxicity.THRESHOLD).mean() >= 0.8
        assert (score[~toxic] >= toxicity.THRESHOLD).mean() <= 0.05


def test_rare_language_is_marked_in_a_later_round():
    rng = random.Random(3)

    def text(letters, bad, n):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n)]
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), bad + rng.choice(letters) + rng.choice(letters))
        return " ".join(words)

    big, small = "abcdefgh", "rstuvwxy"
    texts = [text(big, "", 60) for _ in range(300)] + [text(big, "gabb", 60) for _ in range(150)]
    texts += [text(small, "", 60) for _ in range(40)] + [text(small, "ruvv", 60) for _ in range(12)]
    y = np.array([0] * 300 + [1] * 150 + [0] * 40 + [1] * 12)
    crf = toxicity.ToxicCrf()
    crf.fit(texts, y)
    assert any(w.startswith("gabb") for w in crf.words) and any(w.startswith("ruvv") for w in crf.words)
    assert crf.tag(text(small, "ruvv", 80))[0] >= toxicity.THRESHOLD > crf.tag(text(small, "", 80))[0]
    score, spans = crf.tag("sss ruvvtt yyy")
    assert [(a, b) for a, b, _ in spans] == [(4, 10)]


def test_weighted_sequences_count_as_often_as_they_stand():
    crf = toxicity.ToxicCrf()
    crf.emit, crf.move, crf.start = np.array([0.1, 0.9]), np.array([[0.3, -0.2], [0.1, 0.4]]), np.array([0.2, -0.1])
    ids, tags = np.array([[0, 1, 0], [1, 0, 0]]), np.array([[0, 1, 0], [1, 0, 0]])
    mask = np.array([[True, True, True], [True, True, False]])
    twice = [np.concatenate([x, x[:1], x[:1]]) for x in (ids, tags, mask)]
    for a, b in zip(crf._gradient(ids, tags, mask, np.array([3.0, 1.0])), crf._gradient(*twice, np.ones(4))):
        assert np.allclose(a, b)


def test_sample_takes_one_text_of_each_id(spark):
    docs = spark.createDataFrame([(i, f"{t}{i}") for i in range(40) for t in "ba"], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = labelled.fit_sample(docs, labels, "toxic", rows=5)
    assert len(got) == 10 and all(t[0] == "a" and int(t[1:]) % 2 == y for t, y in got)
    assert got == labelled.fit_sample(docs.repartition(3), labels, "toxic", rows=5)
    assert labelled.fit_sample(docs.limit(0), labels, "toxic") == []


def test_private_characters_in_roles_and_texts():
    turns = [("ser", "x"), ("user", ""), ("assistant", ""), ("\U000f0000", "  ")]
    got = chat.render_series(turns, chat.turn_template)
    assert [chat.unescape(r["piece"][r["text_start"]:r["text_end"]]) for r in got] == [t for _, t in turns]
    assert not any(r["rewrites"] for r in got)
