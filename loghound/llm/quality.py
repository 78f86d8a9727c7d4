"""Quality classifier: a byte-level convolutional network in numpy (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghound.llm.common import empty_if_null, prepare, table
from loghound.llm.labelled import fit_sample, is_held_out

FILTERS = 8
WIDTH = 6
#: Places of a filter that one chunk pools over; the next chunk starts half a chunk later.
CHUNK = 64
HALF = CHUNK // 2
#: A byte counts as repeated if the 6 bytes from it stand also at one of these distances before it.
LAGS = range(2, 33)
SYMBOLS = 512
THRESHOLD = 0.7
EPOCHS = 14
SEED = 7
#: Places that are scored at once in a worker.
BLOCK = 1_000_000


def symbols(data: np.ndarray) -> np.ndarray:
    """One symbol of 0..511 for each byte: the byte, plus 256 where it starts a near repeat."""
    n = len(data)
    out = data.astype(np.int16)
    if n > 8:
        byte = data.astype(np.uint32)
        six = byte[:n - 5].copy()
        for k in range(1, 6):  # 32 bits stand for six bytes
            six *= np.uint32(0x01000193)
            six ^= byte[k:n - 5 + k]
        same = np.zeros(n - 5, dtype=bool)
        for lag in LAGS:
            if lag < n - 5:
                same[lag:] |= six[lag:] == six[:-lag]
        out[:n - 5][same] += 256
    return out


class ByteConvNet:
    """Filters of WIDTH symbols, rectified, max-pooled over overlapping chunks that cover the whole
    text; the mean and the maximum over chunks go to one logistic unit."""

    def __init__(self, filters: int = FILTERS, width: int = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.taps = rng.normal(0, 0.15, (width, SYMBOLS, filters)).astype(np.float32)
        self.bias = np.zeros(filters, dtype=np.float32)
        self.out = rng.normal(0, 0.1, 2 * filters).astype(np.float32)
        self.out_bias = np.float32(0)

    def _conv(self, s: np.ndarray) -> np.ndarray:
        """Filter outputs at every place of rows of symbols (last axis)."""
        width = len(self.taps)
        m = s.shape[-1] - width + 1
        z = self.taps[0].take(s[..., :m], axis=0)
        for j in range(1, width):
            z += self.taps[j].take(s[..., j:j + m], axis=0)
        return z

    def _halves(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """Rows of symbols, one for each half chunk, and the places in the last one."""
        width = len(self.taps)
        places = max(1, len(s) - width + 1)
        n = -(-places // HALF)
        s = np.concatenate([s, np.zeros(n * HALF + width - 1 - len(s), dtype=np.int16)])
        return np.lib.stride_tricks.sliding_window_view(s, HALF + width - 1)[::HALF], places - (n - 1) * HALF

    def chunk_features(self, data: bytes) -> np.ndarray:
        """Max-pooled activations of each chunk of a text; the chunks overlap by half and cover it whole."""
        rows, last = self._halves(symbols(np.frombuffer(data, dtype=np.uint8)))
        tops = []
        for a in range(0, len(rows), BLOCK // HALF):
            z = self._conv(rows[a:a + BLOCK // HALF])
            if a + len(z) == len(rows):
                z[-1, last:] = -np.inf
            tops.append(z.max(1))
        top = np.concatenate(tops)
        return np.maximum((np.maximum(top[:-1], top[1:]) if len(top) > 1 else top) + self.bias, 0)

    def score(self, data: bytes) -> float:
        """Probability of label 1; a text without bytes has no activation."""
        if not data:
            x = np.zeros(len(self.out), dtype=np.float32)
        else:
            c = self.chunk_features(data)
            x = np.concatenate([c.mean(0), c.max(0)])
        return float(1 / (1 + np.exp(-np.clip(x @ self.out + self.out_bias, -30, 30))))

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = SEED) -> None:
        """Adam on the log loss over all chunks of each text; the gradient of a chunk goes through its winning places."""
        rng = np.random.default_rng(seed)
        width, f = len(self.taps), len(self.bias)
        whole = [symbols(np.frombuffer(t, dtype=np.uint8)) for t in texts]
        params = [self.taps, self.bias, self.out]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        mb = vb = 0.0
        t = 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 64)):
                halves = [self._halves(whole[i]) for i in batch]
                n_half = np.array([len(r) for r, _ in halves])
                ends = np.cumsum(n_half)
                rows = np.concatenate([r for r, _ in halves])
                z = self._conv(rows)
                for end, (_, last) in zip(ends, halves):
                    z[end - 1, last:] = -np.inf
                arg, best = z.argmax(1), z.max(1)
                # a chunk is a half and the next one of the same text; a text of one half is one chunk
                opens = np.ones(len(rows), dtype=bool)
                opens[ends[n_half > 1] - 1] = False
                low = np.nonzero(opens)[0]
                n_of = np.maximum(n_half - 1, 1)
                of = np.repeat(np.arange(len(batch)), n_of)
                high = np.where(n_half[of] > 1, low + 1, low)
                cuts = np.concatenate([[0], np.cumsum(n_of)[:-1]])
                won = np.where(best[high] > best[low], high[:, None], low[:, None])
                top = np.maximum(best[high], best[low]) + self.bias
                act = np.maximum(top, 0)
                mean, most = np.add.reduceat(act, cuts) / n_of[:, None], np.maximum.reduceat(act, cuts)
                x = np.concatenate([mean, most], 1)
                p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.out_bias, -30, 30)))
                err = ((p - y[batch]) / len(batch)).astype(np.float32)
                gx = err[:, None] * self.out[None]
                g = gx[of, :f] / n_of[of, None] + gx[of, f:] * (act == most[of]) * (act > 0)
                g *= top > 0
                gt = np.zeros_like(self.taps)
                r, k = np.nonzero(g)
                half = won[r, k]
                place = arg[half, k]
                for j in range(width):
                    np.add.at(gt[j], (rows[half, place + j], k), g[r, k])
                grads = [gt, g.sum(0), x.T @ err + 1e-4 * self.out]
                t += 1
                for q, (param, grad) in enumerate(zip(params, grads)):
                    m[q] = 0.9 * m[q] + 0.1 * grad
                    v[q] = 0.999 * v[q] + 0.001 * grad * grad
                    param -= (rate * (m[q] / (1 - 0.9 ** t)) / (np.sqrt(v[q] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
                gb = float(err.sum())
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                self.out_bias = np.float32(self.out_bias - rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-8))


def fit_quality(docs: DataFrame, labels: DataFrame) -> ByteConvNet:
    """Fit on the bounded sample of :func:`fit_sample`; without labels every score is one half."""
    sample = fit_sample(docs, labels, "quality")
    net = ByteConvNet()
    if sample:
        net.fit([t.encode() for t, _ in sample], np.array([y for _, y in sample], dtype=np.float32))
    else:
        net.out[:] = 0
    return net


def score_quality(docs: DataFrame, net: ByteConvNet, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text; one narrow stage.

    Cases: a null text is empty; repeated rows give repeated rows; an empty
    table gives none; other columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"],
                                "score": [net.score(t.encode()) for t in pdf["text"]]})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"),
                    empty_if_null(F.col("text")).alias("text"))
    return (d.mapInPandas(run, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op7_byte_conv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
