"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loghound.llm.common import empty_if_null, prepare, stage, table

#: Most documents of each language in the fitting sample, and the longest text in characters that may be in it.
SAMPLE_ROWS = 600
SAMPLE_CHARS = 40000
#: Parts of a language that are ranked on their own before the last ranking.
SAMPLE_PARTS = 64
#: Lengths of the character n-grams, and the bits of their hash: one weight a language and bucket.
GRAMS = (1, 2, 3, 4)
BITS = 16
#: Characters whose n-grams are held at once; a longer text adds up the counts of its blocks.
BLOCK = 1 << 18
UNKNOWN = "und"
#: Every CALIBRATE-th document of the sample sets the temperature and is not trained on.
CALIBRATE = 5


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32(doc_id as text) mod 5 is 0 (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def letter_table() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letters_of(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text; each stretch of other characters is one blank, also at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = table[c]
    c = np.where(letter, c, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = c[keep]
    return np.concatenate([[32], c, [32] * int(not len(c) or c[-1] != 32)]).astype(np.uint32)


def gram_counts(text: str, letters: np.ndarray, grams: tuple[int, ...] = GRAMS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the hashed n-grams of a whole text; none if it has no letter."""
    c = letters_of(text, letters)
    if len(c) <= 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    most = max(grams)
    total = 0
    for a in range(0, len(c), BLOCK):
        part = c[a:a + BLOCK + most - 1]
        own = min(BLOCK, len(c) - a)  # an n-gram belongs to the block that it starts in
        rolled, buckets = np.zeros(len(part), dtype=np.uint32), []
        for n in range(1, most + 1):
            rolled = rolled[:len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1:]
            if n in grams:
                mixed = (rolled[:own] + np.uint32(n)) * np.uint32(0x9E3779B1)
                mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
                buckets.append(mixed >> np.uint32(32 - bits))
        total = total + np.bincount(np.concatenate(buckets), minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at]


class LanguageModel:
    """Weights of the languages over TF-IDF n-grams, learned by follow-the-regularised-leader."""

    def __init__(self, names: list[str], idf: np.ndarray):
        self.names, self.idf = names, idf.astype(np.float32)
        self.letters = letter_table()
        self.weights = np.zeros((len(idf), len(names)), dtype=np.float32)
        self.bias = np.zeros(len(names))
        self.temperature = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, value): (1 + ln count) * idf, of length 1."""
        at, count = gram_counts(text, self.letters, bits=len(self.idf).bit_length() - 1)
        x = (1 + np.log(count)) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return (at, x / norm) if norm > 0 else (at[:0], x[:0])

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 3, alpha: float = 0.5,
            beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 7) -> None:
        """FTRL-proximal, one document at a time: each weight has its own rate and is exactly 0
        unless its gradients outweigh ``l1``; ``l2`` shrinks the others."""
        k = len(self.names)
        z = np.zeros((len(self.idf) + 1, k))
        n = np.zeros_like(z)
        bias = len(self.idf)  # a bucket of its own, always 1 and without l1

        def weights(zi, ni, free):
            w = -(zi - np.sign(zi) * l1 * ~free) / ((beta + np.sqrt(ni)) / alpha + l2)
            return np.where((np.abs(zi) <= l1) & ~free, 0.0, w)

        rng = np.random.default_rng(seed)
        one_hot = np.eye(k)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at = np.append(rows[i][0], bias)
                x = np.append(rows[i][1], 1.0)
                free = (at == bias)[:, None]
                zi, ni = z[at], n[at]
                w = weights(zi, ni, free)
                p = _softmax(x @ w)
                g = x[:, None] * (p - one_hot[y[i]])[None]
                sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
                z[at] = zi + g - sigma * w
                n[at] = ni + g * g
        free = (np.arange(len(z)) == bias)[:, None]
        w = weights(z, n, free)
        self.weights, self.bias = w[:-1].astype(np.float32), w[-1]

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """The temperature of least log loss on documents that were not trained on (golden section over its logarithm)."""
        if not rows:
            return
        logits = np.stack([self.logits(*r) for r in rows])

        def loss(log_t):
            p = np.stack([_softmax(v / np.exp(log_t)) for v in logits])
            return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

        low, high, part = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - part * (high - low), low + part * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def predict(self, text: str) -> tuple[str, float]:
        at, x = self.features(text)
        if not self.names or not len(at):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(at, x) / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best])


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def learnable(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of the rows that may be learned from."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
            .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
                   & ~is_held_out(F.col("doc_id"))))


def inverse_frequencies(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the n-gram)) + 1 of every bucket, over all learnable documents.

    Each task adds up its own documents, so at most 2^bits rows a task are
    shuffled and 2^bits reach the driver, whatever the table holds.
    """
    letters = np.packbits(letter_table())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_letter = np.unpackbits(letters).astype(bool)
        n = np.zeros((1 << bits) + 1, dtype=np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                at, _ = gram_counts(text, is_letter, bits=bits)
                n[at] += 1
                n[-1] += len(at) > 0
        at = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": at, "n": n[at]})

    found = rows.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    n = np.zeros((1 << bits) + 1, dtype=np.int64)
    for r in found.collect():
        n[r["bucket"]] = r["n"]
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 1


def language_sample(rows: DataFrame, count: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``count`` different texts of each language by a hash of doc_id, sorted by it, so reruns agree.

    Copies of a text count once.  Only ids and hashes are ranked, first
    within SAMPLE_PARTS parts of a language, so a language with most rows is
    no hot task; the texts of the few chosen ids are read last.
    """
    short = rows.where(F.length("text") <= chars)
    ids = (short.select("lang", "doc_id", F.xxhash64("text").alias("_same")).groupBy("lang", "_same")
           .agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("doc_id"))).alias("_id")))

    def first(df: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_id.h", "_id.doc_id"))
        return df.withColumn("_at", rank).where(F.col("_at") <= count)

    parts = first(ids.withColumn("_part", F.pmod("_id.h", F.lit(SAMPLE_PARTS))), "lang", "_part")
    # written, so that its size is known to the join
    picked = stage(first(parts, "lang").select("lang", "_same", "_id.doc_id", "_at"))
    found = (short.withColumn("_same", F.xxhash64("text")).join(picked, ["lang", "_same", "doc_id"])
             .dropDuplicates(["lang", "_same", "doc_id"]).select("_at", "lang", "text").collect())
    return [(r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["_at"], r["lang"], r["text"]))]


def fit_language(docs: DataFrame, count: int = SAMPLE_ROWS) -> LanguageModel:
    """n-gram frequencies of all learnable documents, weights and temperature from a bounded sample of them.

    The number of languages is taken to be small: the sample holds ``count``
    texts of each, the model 2^BITS weights of each.
    """
    rows = learnable(docs)
    idf = inverse_frequencies(rows)
    sample = language_sample(rows, count)
    names = sorted({lang for _, lang in sample})
    model = LanguageModel(names, idf)
    known = [(model.features(t), names.index(lang)) for t, lang in sample]
    known = [(f, y) for f, y in known if len(f[0])]
    if not known:
        return LanguageModel([], idf)
    held = [r for i, r in enumerate(known) if i % CALIBRATE == CALIBRATE - 1]
    rest = [r for i, r in enumerate(known) if i % CALIBRATE != CALIBRATE - 1]
    model.fit([f for f, _ in rest], np.array([y for _, y in rest]))
    model.calibrate([f for f, _ in held], np.array([y for _, y in held]))
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text; one narrow stage.

    Cases: a null text, or one without a letter, is ``und`` with score 0, and
    so is every text if nothing could be learned; a null doc_id stays null and
    is not held out; repeated rows give repeated rows; an empty table gives
    none; other columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [model.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"],
                                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"),
                    empty_if_null(F.col("text")).alias("text"))
    return d.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op12_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_language(docs))
