"""Periodic runs of words by suffix trees with constant-time common extensions (operator 13)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghound.llm.common import empty_if_null, prepare, table

MIN_WORDS = 6
MIN_EXPONENT = 4
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_tree(s: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of ``s``, whose last symbol occurs nowhere else: (edges, start, end of each node's label).

    ``edges`` maps node * width + symbol to the child; ``width`` is above every symbol.
    """
    n = len(s)
    start, end, link = [0], [0], [0]
    edges: dict[int, int] = {}
    node = length = waiting = edge = 0
    for i, c in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = i
            key = node * width + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = start[child]
                span = (end[child] if end[child] < i + 1 else i + 1) - at
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[at + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                edges[key] = split
                edges[split * width + c] = split + 1
                edges[split * width + s[at + length]] = child
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                start[child] = at + length
                if last:
                    link[last] = split
                last = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return edges, start, end


class Extensions:
    """Longest common extensions of any two positions in constant time.

    An Euler tour of the suffix tree visits the leaves in the order of their
    suffixes; between two neighbouring leaves the shallowest node of the tour
    is their lowest common ancestor.  Only that entry of the tour is kept, and
    a sparse table over these answers the minimum between any two leaves.
    """

    def __init__(self, symbols: np.ndarray):
        """``symbols`` are positive; 0 is appended as the end and sorts first."""
        self.n = len(symbols)
        self.width = int(symbols.max()) + 1
        s = symbols.tolist() + [0]
        edges, self.start, self.end = suffix_tree(s, self.width)
        self.keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        self.child = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        order, low = self._tour(self.keys)
        self.rank = np.empty(self.n + 1, dtype=np.int64)
        self.rank[order] = np.arange(self.n + 1)
        self.table = [np.array(low, dtype=np.int32)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half = 1 << (len(self.table) - 1)
            row = self.table[-1]
            self.table.append(np.minimum(row[:-half], row[half:]))

    def _tour(self, keys: np.ndarray) -> tuple[list[int], list[int]]:
        """Suffixes in leaf order of a tour that takes children by ``keys``, and the depths between leaves."""
        by = np.argsort(keys, kind="stable")
        child = self.child[by].tolist()
        first = np.searchsorted(keys[by] // self.width, np.arange(len(self.start) + 1)).tolist()
        start, end, n = self.start, self.end, self.n + 1
        depth, above = [0] * len(start), [0] * len(start)
        order, low = [], []
        stack, after_leaf = [0], False
        while stack:
            u = stack.pop()
            if after_leaf:
                low.append(above[u])
                after_leaf = False
            a, b = first[u], first[u + 1]
            if a == b:
                order.append(n - depth[u])
                after_leaf = True
                continue
            d = depth[u]
            for v in child[a:b]:
                above[v] = d
                depth[v] = d + end[v] - start[v]
            stack += child[a:b][::-1]
        return order, low

    def inverse_rank(self) -> np.ndarray:
        """Ranks of the suffixes under the inverse order of the symbols; the end still sorts first."""
        node, symbol = self.keys // self.width, self.keys % self.width
        order, _ = self._tour(node * self.width + (self.width - symbol) % self.width)
        out = np.empty(self.n + 1, dtype=np.int64)
        out[order] = np.arange(self.n + 1)
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j (different positions)."""
        if not len(i):
            return np.zeros(0, dtype=np.int64)
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << int(k))])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each position the next one of smaller rank: the end of its longest Lyndon word."""
    out = [0] * len(rank)
    stack: list[int] = []
    ranks = rank.tolist()
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    for i in stack:
        out[i] = len(ranks)
    return np.array(out, dtype=np.int64)


def all_runs(symbols: np.ndarray) -> np.ndarray:
    """Every run of exponent 2 or more as rows (start, length, period).

    Each run has a root that is the longest Lyndon word at its position, under
    the order of the symbols or its inverse.  All such roots are extended to
    the right over the tree and to the left over the tree of the reversal.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), dtype=np.int64)
    forward = Extensions(symbols)
    here = np.arange(n, dtype=np.int64)
    ends = [_next_smaller(rank[:n]) for rank in (forward.rank, forward.inverse_rank())]
    roots = np.unique(np.concatenate([here * (n + 1) + e for e in ends]))
    i, j = roots // (n + 1), roots % (n + 1)
    period = j - i
    right = np.zeros(len(i), dtype=np.int64)
    inside = j < n
    right[inside] = forward.common(i[inside], j[inside])
    del forward
    backward = Extensions(symbols[::-1])
    left = np.zeros(len(i), dtype=np.int64)
    inside = i > 0
    left[inside] = backward.common(n - i[inside], n - j[inside])
    length = period + left + right
    keep = length >= 2 * period
    found = np.stack([i - left, length, period], 1)[keep]
    return np.unique(found, axis=0) if len(found) else found


def periodic_stretches(ids: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of words outside which no run of the asked size can lie.

    A run of period q and at least 4 q (3 q suffices) words repeats each of its
    word pairs q words before or behind.  So inside a stretch of m words every
    pair must stand again within m / min_exponent words; pairs that do not are
    cut out until nothing changes.  Exact: only places without a run go.
    """
    n = len(ids)
    if n < max(2, min_words):
        return []
    if min_exponent < 3:
        return [(0, n)]
    pair = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
    order = np.argsort(pair, kind="stable")
    same = pair[order[1:]] == pair[order[:-1]]
    gap = (order[1:] - order[:-1])[same]
    near = np.full(n - 1, n, dtype=np.int64)
    near[order[:-1][same]] = gap
    np.minimum.at(near, order[1:][same], gap)
    alive = near < n
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], alive.view(np.int8), [0]])))
        a, b = edge[::2], edge[1::2]
        words = b - a + 1
        # how near a pair must stand again: per stretch, and 0 between stretches
        allowed = np.zeros(2 * len(a) + 1, dtype=np.int64)
        allowed[1::2] = np.where(words >= min_words, words // min_exponent, 0)
        bounds = np.concatenate([[0], np.stack([a, b], 1).ravel(), [n - 1]])
        kept = alive & (near <= np.repeat(allowed, np.diff(bounds)))
        if (kept == alive).all():
            return [(int(x), int(y) + 1) for x, y in zip(a, b)]
        alive = kept


def word_runs(ids: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Runs of at least max(min_words, min_exponent * period) words, rows (start, length, period) by start, period.

    The stretches that can hold a run stand one after the other, parted by
    symbols of their own, in a single pair of suffix trees.
    """
    stretches = periodic_stretches(ids, min_words, min_exponent)
    if not stretches:
        return np.zeros((0, 3), dtype=np.int64)
    parts, places, part_at = [], [], 0
    base = int(ids.max()) + 2
    for k, (a, b) in enumerate(stretches):
        parts += [ids[a:b] + 1, [base + k]]
        places.append((part_at, a))
        part_at += b - a + 1
    dense = np.unique(np.concatenate(parts), return_inverse=True)[1] + 1
    found = all_runs(dense)
    found = found[found[:, 1] >= np.maximum(min_words, min_exponent * found[:, 2])]
    if len(found):
        at = np.array(places)
        of = np.searchsorted(at[:, 0], found[:, 0], side="right") - 1
        found[:, 0] += at[of, 1] - at[of, 0]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found


def repeat_tail(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Words of every tenth document (by crc32 of its id) repeat a piece from some word on; a null id changes nothing."""
    if doc_id is None or not len(ids):
        return ids
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % 10:
        return ids
    g, n = h // 10, len(ids)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return ids[at]


def runs_of_text(text: str, doc_id: int | None, rewrite: Callable | None, min_words: int,
                 min_exponent: int) -> tuple[list[dict], str]:
    """(runs, text without what any run holds after its first period) of one text."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at blank and \\x09-\\x0D only
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if rewrite is not None:
        ids = rewrite(ids, doc_id)
        names = list(number)
        words = [names[i] for i in ids.tolist()]
    runs = word_runs(ids, min_words, min_exponent)
    if len(runs):
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    rows = [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]
    return rows, b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, rewrite: Callable | None = None, min_words: int = MIN_WORDS,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed): the periodic runs of every whole text, one narrow stage.

    A run is a maximal stretch of words with smallest period q and at least
    max(min_words, min_exponent * q) words.  ``collapsed`` holds the words that
    no run holds after its first q words, joined by one blank.  ``rewrite``
    (word numbers, doc_id) may change the words first.

    Cases: a null or empty text, or one of white space, has no run and an
    empty ``collapsed``; a null doc_id stays null; repeated rows give repeated
    rows; an empty table gives none; other columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
            found = [runs_of_text(t, i, rewrite, min_words, min_exponent) for t, i in zip(pdf["text"], ids)]
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "runs": [f[0] for f in found],
                                "collapsed": [f[1] for f in found]})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_if_null(F.col("text")).alias("text"))
    return d.mapInPandas(run, f"doc_id long, runs {_RUNS}, collapsed string")


def op13_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = periodic_runs(table(spark, sf_dir, "documents"), repeat_tail)
    # runs come by start, then period: the first one of the greatest exponent stays
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
                    lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r)
                    .otherwise(top))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return (found.withColumn("_best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"),
                    F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
                    F.col("_best.period").alias("period"),
                    F.floor(F.expr("(1000 * _best.length) div _best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(F.concat_ws("", line).cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
