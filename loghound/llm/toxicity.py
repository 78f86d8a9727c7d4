"""Toxicity: a linear-chain conditional random field over words (operator 8)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghound.llm.common import empty_if_null, prepare, table
from loghound.llm.labelled import fit_sample, is_held_out

THRESHOLD = 0.3
#: A word is a labelled token of toxic documents if LIFT times as many of the sample's toxic documents hold
#: it as its rate in clean text gives for documents of their lengths, and that is beyond chance: the log
#: likelihood ratio exceeds the log of the number of words by MARGIN.
LIFT = 4.0
MARGIN = 6.0
#: Lengths of word beginnings that are tried as features beside whole words (written with a star), and
#: the fewest different words of toxic documents that one must begin.
STEMS = range(4, 9)
STEM_WORDS = 4
#: Words of one training sequence; the texts of the sample are cut into sequences of this length, all of them.
STEPS = 48
SPAN_MARGINAL = 0.5
_TOKEN = re.compile(r"[^\W\d_]+")


class ToxicCrf:
    """Two tags (clean, toxic); a weight per word and tag, per tag pair and for the first tag.

    Words without a weight of their own share one.  A run of them between two
    known words is one step of the chain, its matrix power taken in closed
    form, so the marginals are those of the whole chain.
    """

    def __init__(self):
        self.words: dict[str, int] = {}
        self.emit = np.zeros(1)        # score of toxic over clean by word; 0: any other word
        self.move = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.out = np.array([-3.0, 1.0, 1.0, 1.0])  # document score: bias, mass, share, highest marginal

    # -- inference -----------------------------------------------------------
    def _run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues and vectors of one step over an unknown word."""
        step = np.exp(self.move) * np.exp(np.array([0.0, self.emit[0]]))[None, :]
        values, right = np.linalg.eig(step)
        values, right = values.real, right.real
        return values / values.max(), right, np.linalg.inv(right)

    def marginals(self, known: list[int], gaps: list[int], tail: int) -> list[float]:
        """P(toxic) of each known word; ``gaps[i]`` unknown words stand before it, ``tail`` after the last."""
        values, right, left = self._run()

        def power(n):
            return (right * values ** n) @ left

        move = np.exp(self.move)
        first = np.exp(self.start)
        alphas = []
        a = None
        for w, gap in zip(known, gaps):
            e = np.array([1.0, np.exp(self.emit[w])])
            if a is None:
                a = first * np.array([1.0, np.exp(self.emit[0])]) @ power(gap - 1) @ move if gap else first
            else:
                a = a @ (power(gap) @ move if gap else move)
            a = np.maximum(a, 1e-300) * e
            a = a / a.sum()
            alphas.append(a)
        b = power(tail) @ np.ones(2) if tail else np.ones(2)
        out = []
        for i in range(len(known) - 1, -1, -1):
            p = alphas[i] * np.maximum(b, 0)
            out.append(float(p[1] / p.sum()))
            e = np.array([1.0, np.exp(self.emit[known[i]])])
            b = move @ (e * b)
            b = power(gaps[i]) @ b if gaps[i] else b
            b = b / b.sum()
        return out[::-1]

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Document score and the toxic spans (start, end, marginal) of a whole text, in code points."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose small form is longer: keep the offsets
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        known, gaps, spans, at, total = [], [], [], 0, 0
        for m in self._pattern.finditer(low):
            gap = len(_TOKEN.findall(low, at, m.start()))
            known.append(self._id(m[0]))
            gaps.append(gap)
            spans.append(m.span())
            at = m.end()
            total += gap + 1
        tail = 0
        marg = []
        if known:
            tail = len(_TOKEN.findall(low, at))
            total += tail
            marg = self.marginals(known, gaps, tail)
        x = self.document_features(marg, total)
        score = float(1 / (1 + np.exp(-np.clip(x @ self.out, -30, 30))))
        return score, [(a, b, p) for (a, b), p in zip(spans, marg) if p >= SPAN_MARGINAL]

    @staticmethod
    def document_features(marg: list[float], total: int) -> np.ndarray:
        mass = float(sum(marg))
        return np.array([1.0, np.log1p(mass), min(1.0, 30 * mass / max(1, total)), max(marg, default=0.0)])

    def _id(self, word: str) -> int:
        i = self.words.get(word)
        return i if i is not None else next(self.words[word[:k] + "*"] for k in STEMS if word[:k] + "*" in self.words)

    def compile(self) -> None:
        """One pattern for all known words and beginnings."""
        rest = r"[^\W\d_]*"
        parts = [re.escape(w[:-1]) + rest if w[-1] == "*" else re.escape(w) for w in sorted(self.words)]
        self._pattern = re.compile(r"(?<![^\W\d_])(?:" + "|".join(parts) + r")(?![^\W\d_])" if parts else r"(?!)")

    # -- learning --------------------------------------------------------------
    def fit(self, texts: list[str], y: np.ndarray, iterations: int = 40, rate: float = 0.3) -> None:
        y = np.asarray(y)
        tokens = [_TOKEN.findall(t.lower()) for t in texts]
        other, toxic_docs, clean_words = Counter(), [], 0
        copies = set()
        for words, label in zip(tokens, y):
            # near copies share their lowest three-word hash most of the time: they count once
            low = min((crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)
            if (low, label) in copies:
                continue
            copies.add((low, label))
            if label:
                toxic_docs.append((set(words), len(words)))
                continue
            for w, n in Counter(words).items():
                other[w] += n
                for k in STEMS:
                    if len(w) >= k:
                        other[w[:k] + "*"] += n
            clean_words += len(words)
        # documents without a marked word go through another round: what marks a rare language is not held
        # against the documents of the frequent ones
        marked: set[str] = set()
        while new := self._concentrated(toxic_docs, other, clean_words):
            marked |= new
            toxic_docs = [(words, n) for words, n in toxic_docs if not any(
                w in new or any(w[:k] + "*" in new for k in STEMS if len(w) >= k) for w in words)]
        # the shortest marked beginning stands for the words and longer beginnings under it
        marked = {w for w in marked if not any(
            w[:k] + "*" in marked for k in STEMS if k < len(w.rstrip("*")) or k == len(w) and w[-1] != "*")}
        index = {w: i + 1 for i, w in enumerate(sorted(marked))}

        def known(w):
            i = index.get(w)
            for k in STEMS:
                if i is not None or k > len(w):
                    break
                i = index.get(w[:k] + "*")
            return i or 0

        # all training sequences; equal ones, such as those without a known word, are one with a weight
        seqs = Counter()
        for w, label in zip(tokens, y):
            for a in range(0, len(w), STEPS):
                seqs[tuple(known(t) for t in w[a:a + STEPS]), int(bool(label))] += 1
        if not index:
            self.words = {}
            self.compile()
            self._fit_documents(texts, y)
            return
        rows = len(seqs)
        ids, tags = np.zeros((rows, STEPS), dtype=int), np.zeros((rows, STEPS), dtype=int)
        mask = np.zeros((rows, STEPS), dtype=bool)
        weight = np.array(list(seqs.values()), dtype=float)
        for r, (part, label) in enumerate(seqs):
            ids[r, :len(part)], mask[r, :len(part)] = part, True
            tags[r, :len(part)] = [label and int(k > 0) for k in part]
        n = weight.sum()
        size = len(index) + 1
        self.emit = np.zeros(size)
        square = [np.zeros(size), np.zeros((2, 2)), np.zeros(2)]
        for _ in range(iterations):
            g_emit, g_move, g_start = self._gradient(ids, tags, mask, weight)
            grads = [g_emit / n - 1e-3 * self.emit, g_move / n - 1e-3 * self.move, g_start / n - 1e-3 * self.start]
            for k, (p, g) in enumerate(zip((self.emit, self.move, self.start), grads)):
                square[k] += g * g
                p += rate * g / (np.sqrt(square[k]) + 1e-8)
        self.words = index
        self.compile()
        self._fit_documents(texts, y)

    @staticmethod
    def _concentrated(toxic_docs: list[tuple[set[str], int]], other: Counter, clean_words: int) -> set[str]:
        """Words and beginnings that more of the documents hold than their rate in clean text explains."""
        toxic, begins = Counter(), {}
        for words, _ in toxic_docs:
            toxic.update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
            for w in words:
                for k in STEMS:
                    if len(w) >= k:
                        begins.setdefault(w[:k] + "*", set()).add(w)
        beyond = np.log(len(toxic) + 1) + MARGIN
        lengths = np.array([n for _, n in toxic_docs], dtype=float)
        out = set()
        for w, n in toxic.items():
            if n < 3 or w[-1] == "*" and len(begins[w]) < STEM_WORDS:
                continue
            chance = -np.expm1(-(other[w] + 0.5) / (clean_words + 1) * lengths).sum()
            if n >= LIFT * chance and n * np.log(n / chance) - (n - chance) >= beyond:
                out.add(w)
        return out

    def _gradient(self, ids, tags, mask, weight):
        """Observed minus expected counts over padded, weighted sequences (forward-backward, step by step)."""
        n, steps = ids.shape
        e = np.stack([np.ones(ids.shape), np.exp(self.emit[ids])], -1)
        move = np.exp(self.move)
        alpha, beta = np.zeros((n, steps, 2)), np.ones((n, steps, 2))
        a = np.exp(self.start)[None] * e[:, 0]
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, steps):
            a = (alpha[:, t - 1] @ move) * e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
        g_move = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            live = mask[:, t]
            pair = alpha[:, t - 1, :, None] * move[None] * (e[:, t] * beta[:, t])[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            g_move -= (pair * weight[:, None, None])[live].sum(0)
            np.add.at(g_move, (tags[live, t - 1], tags[live, t]), weight[live])
            b = (e[:, t] * beta[:, t]) @ move.T
            beta[:, t - 1] = np.where(live[:, None], b / b.sum(1, keepdims=True), beta[:, t - 1])
        p = alpha * beta
        p = p[..., 1] / p.sum(-1)
        diff = (tags - p) * mask * weight[:, None]
        g_emit = np.bincount(ids.ravel(), weights=diff.ravel(), minlength=len(self.emit))
        first = diff[:, 0].sum()
        return g_emit, g_move, np.array([-first, first])

    def _fit_documents(self, texts: list[str], y: np.ndarray) -> None:
        """The logistic unit over a document's marginals, by Newton steps."""
        keep, self.out = self.out, np.array([0.0, 0.0, 0.0, 0.0])
        rows = []
        for t in texts:
            low = t.lower()
            known = [(m.start(), m.end(), self._id(m[0])) for m in self._pattern.finditer(low)]
            at, gaps = 0, []
            for a, b, _ in known:
                gaps.append(len(_TOKEN.findall(low, at, a)))
                at = b
            tail = len(_TOKEN.findall(low, at)) if known else 0
            marg = self.marginals([k for _, _, k in known], gaps, tail) if known else []
            rows.append(self.document_features(marg, sum(gaps) + len(known) + tail))
        x = np.array(rows)
        if len(set(y.tolist())) < 2:
            self.out = keep
            return
        w = np.zeros(4)
        ridge = np.diag([1e-3, 0.3, 0.3, 0.3])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge
            w = w - np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
        self.out = w


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicCrf:
    """Fit on the bounded sample of ``labelled.fit_sample``.

    Only documents are labelled; a token of a toxic document is labelled toxic
    if its word, or its beginning, stands in far more toxic documents than the
    rate of clean text explains (LIFT, MARGIN).
    Without labels nothing is toxic.
    """
    sample = fit_sample(docs, labels, "toxic")
    crf = ToxicCrf()
    if sample:
        crf.fit([t for t, _ in sample], np.array([y for _, y in sample]))
    else:
        crf.compile()
    return crf


def score_toxicity(docs: DataFrame, crf: ToxicCrf, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every whole text; one narrow stage.

    ``spans`` holds start, end (code points) and marginal of the offending
    words.  Cases: a null text is empty and scores like a text without known
    words; repeated rows give repeated rows; an empty table gives none; other
    columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tagged = [crf.tag(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": [s for s, _ in tagged],
                                "spans": [[{"start": a, "end": b, "marginal": p} for a, b, p in x] for _, x in tagged]})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"),
                    empty_if_null(F.col("text")).alias("text"))
    out = d.mapInPandas(run, "doc_id long, held_out boolean, score double, "
                             "spans array<struct<start:long,end:long,marginal:double>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, crf: ToxicCrf, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text the model rejects; all columns stay.

    Cases: a null or empty text holds no known word and stays unless the model
    calls such texts toxic; repeated rows share their decision; an empty table
    gives an empty one; other columns are not read.
    """
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: crf.tag(t or "")[0] < threshold).astype(bool)

    return docs.where(clean("text"))


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
