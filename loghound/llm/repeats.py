"""Removal of repeated byte strings by ranks of growing substrings at anchors (operator 4).

Minimiser anchors and hashes of two lengths stand in place of prefix doubling, see README.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loghound.llm.common import discard, prepare, stage, table
from loghound.llm.hashing import Rolling, byte_values, powers

#: Length of the strings that count, and of the first rank.
LENGTH = 100
FIRST = 32
#: Bytes that are ranked at once in a worker; longer texts go in overlapping pieces.
BLOCK_BYTES = 1_500_000
#: The first ranks are met in so many passes over the texts, a class of ranks each: the rows that are on disk
#: at once fall by this factor, the texts are read and ranked as often.
PASSES = 3
#: Order of rows without doc_id: after all others.
NO_ID = 2 ** 63 - 1


def _blocks(keys, texts, length: int):
    """Lists of (key, offset, bytes) of at most about BLOCK_BYTES; pieces of a text overlap by length - 1."""
    block, size = [], 0
    for key, t in zip(keys, texts):
        for a in range(0, max(1, len(t) - length + 1), BLOCK_BYTES):
            piece = t[a:a + BLOCK_BYTES + length - 1]
            if block and size + len(piece) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((key, a, piece))
            size += len(piece)
    if block:
        yield block


class Ranker:
    """Ranks of substrings of a block: equal strings, and no others, have equal 64-bit names."""

    def __init__(self, length: int = LENGTH, first: int = FIRST):
        self.length, self.first = length, first
        #: A window with its anchor beyond this offset holds as many bytes before the anchor, others
        #: hold ``length - reach`` bytes from the anchor on.
        self.reach = (length - first) // 2
        self.values = byte_values()
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def rolling(self, data: np.ndarray) -> Rolling:
        if len(self.up) <= len(data):
            self.up, self.down = powers(len(data))
        return Rolling(data, self.values, self.up, self.down)

    def grams(self, r: Rolling, anchor: np.ndarray, offset: np.ndarray) -> np.ndarray:
        before = offset > self.reach
        return r.of(np.where(before, anchor - self.reach, anchor),
                    np.where(before, anchor + self.first, anchor + self.length - self.reach))

    def anchors(self, block) -> tuple[np.ndarray, ...]:
        """For each run of windows with the same anchor and side: piece, start, windows, anchor offset,
        gram (rank of the bytes about the anchor that every window of that side holds), rank of all
        bytes that the run's windows cover.

        The anchor of a window is the place in it whose first rank is least,
        so equal windows have equal anchors, wherever they stand.
        """
        length, first = self.length, self.first
        data = np.frombuffer(b"".join(p for _, _, p in block), dtype=np.uint8)
        ends = np.cumsum([len(p) for _, _, p in block])
        starts = ends - [len(p) for _, _, p in block]
        none = np.zeros(0, dtype=np.int64)
        if len(data) < length:
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        r = self.rolling(data)
        at = np.arange(len(data) - first + 1)
        rank = r.of(at, at + first)
        low_bits = np.uint64(2 ** 28 - 1)
        least = (rank & ~low_bits) | at.astype(np.uint64)
        width, done = length - first + 1, 1
        while done < width:  # the least of growing ranges
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        anchor = (least & low_bits).astype(np.int64)
        piece = np.repeat(np.arange(len(block)), np.maximum(0, ends - starts - length + 1))
        counts = np.maximum(0, ends - starts - length + 1)
        p = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[piece]
        if not len(p):
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        a = anchor[p]
        side = a - p > self.reach
        new = np.nonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (side[1:] != side[:-1]) | (piece[1:] != piece[:-1])]))[0]
        windows = np.diff(np.append(new, len(p)))
        s, a = p[new], a[new]
        shape = ((a - s) << 8 | windows).astype(np.uint64)
        whole = r.of(s, s + windows - 1 + length) ^ (shape * np.uint64(0x9E3779B97F4A7C15))
        return piece[new], s - starts[piece[new]], windows, a - s, self.grams(r, a, a - s), whole


def _pack(start, windows, anchor):
    return start << 16 | windows << 8 | anchor


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """Byte spans covered by a ``length``-byte string that also starts earlier in the corpus.

    Not prefix doubling over all places: every window of ``length`` bytes is
    represented by its anchor, so about 2 / (length - first) of all places are
    ranked, by hashes of two lengths.
    1. Rank of the bytes about each anchor that all its windows of one side
       hold (66 for 100); Spark sorts (rank, rank of the longer range) pairs.
       A rank that is unique ends there.
    2. Where the longer range (all windows of the anchor, at least ``length``
       bytes) has an equal one earlier, all its bytes are repeated.
    3. Where only the first rank repeats, the ranks of each single window are
       compared in a last round, a row for each (rank of the first bytes, rank
       of the window).  No task holds all rows of a first rank.
    Copies inside one Arrow batch are settled before either shuffle, so a passage
    that a third of all documents hold is one row per batch.

    Returns doc_id (NO_ID for null), part, start, end; spans may overlap.
    """
    docs = docs.select("doc_id", "part", "data")
    met = [_first_ranks(docs, length, first, k) for k in range(PASSES)]
    left = [table_ for _, table_ in met]
    whole_spans = reduce(DataFrame.union, [spans for spans, _ in met])
    open_ = stage(reduce(DataFrame.union, left).groupBy("doc_id", "part").agg(F.collect_set("at").alias("ats")))
    discard(*left)

    def window_ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(length, first)
        for pdf in batches:
            held, size = [], 0
            for doc, part, data, ats in zip(pdf["doc_id"], pdf["part"], pdf["data"], pdf["ats"]):
                at = np.sort(np.array(ats, dtype=np.int64))
                s, n, anchor = at >> 16, (at >> 8) & 255, at & 255
                for a in range(0, max(1, len(data) - length + 1), BLOCK_BYTES):
                    here = (s >= a) & (s < a + BLOCK_BYTES)
                    if not here.any():
                        continue
                    r = ranker.rolling(np.frombuffer(data[a:a + BLOCK_BYTES + length - 1], dtype=np.uint8))
                    x, y, z = s[here] - a, n[here], (s + anchor)[here] - a
                    p = np.repeat(x, y) + np.arange(y.sum()) - np.repeat(np.cumsum(y) - y, y)
                    gram = np.repeat(ranker.grams(r, z, anchor[here]), y)
                    held.append((gram.view(np.int64), r.of(p, p + length).view(np.int64),
                                 np.full(len(p), doc), np.full(len(p), part), p + a))
                    size += len(p)
                    if size >= BLOCK_BYTES:
                        yield settle(held)
                        held, size = [], 0
            if held:
                yield settle(held)

    def settle(held: list) -> pd.DataFrame:
        gram, rank, doc, part, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, part, doc, rank, gram))
        gram, rank, doc, part, at = (x[order] for x in (gram, rank, doc, part, at))
        same = np.concatenate([[False], (gram[1:] == gram[:-1]) & (rank[1:] == rank[:-1])])
        head = np.nonzero(~same)[0][np.cumsum(~same) - 1]
        again = same & ((doc != doc[head]) | (part != part[head]) | (at != at[head]))
        gram = np.where(again, doc * np.int64(1_000_003) ^ part ^ at, gram)
        return pd.DataFrame({"gram": gram, "rank": rank, "doc_id": doc, "part": part, "at": at, "again": again})

    asked = (docs.join(open_, ["doc_id", "part"]).dropDuplicates(["doc_id", "part"])
             .mapInPandas(window_ranks, "gram long, rank long, doc_id long, part long, at long, again boolean"))
    later = _places(asked, "gram", "rank").where("again").select("doc_id", "part", F.col("at").alias("start"))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            doc, part, p = (pdf[c].to_numpy() for c in ("doc_id", "part", "start"))
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (p[1:] > p[:-1] + 1)])
            first_, last = np.nonzero(new)[0], np.append(np.nonzero(new)[0][1:], len(p)) - 1
            yield pd.DataFrame({"doc_id": doc[first_], "part": part[first_], "start": p[first_], "end": p[last] + length})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    window_spans = stage(later.repartition(n, "doc_id", "part").sortWithinPartitions("doc_id", "part", "start")
                         .mapInPandas(runs, "doc_id long, part long, start long, end long"))
    discard(open_)
    return whole_spans.union(window_spans)


def _places(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``again`` (also) set where an equal rank stands at an earlier place, and ``nth`` by place."""
    in_order = Window.partitionBy(*by).orderBy("doc_id", "part", "at")
    moved = reduce(Column.__or__, [F.col(c) != F.first(c).over(in_order) for c in ("doc_id", "part", "at")])
    return (rows.withColumn("_moved", moved).withColumn("nth", F.row_number().over(in_order))
            .withColumn("again", F.col("again") | F.col("_moved")).drop("_moved"))


def _first_ranks(docs: DataFrame, length: int, first: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Spans settled by the ranks of class ``k``, and the (doc_id, part, at) that they leave open."""
    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(length, first)
        for pdf in batches:
            rows = []
            keys = list(zip(pdf["doc_id"], pdf["part"]))
            for block in _blocks(keys, pdf["data"], length):
                piece, s, windows, anchor, gram, whole = ranker.anchors(block)
                mine = np.nonzero(gram % np.uint64(PASSES) == np.uint64(k))[0]
                piece, s, windows, anchor, gram, whole = (x[mine] for x in (piece, s, windows, anchor, gram, whole))
                doc = np.array([k[0] for k, _, _ in block], dtype=np.int64)[piece]
                part = np.array([k[1] for k, _, _ in block], dtype=np.int64)[piece]
                off = np.array([o for _, o, _ in block], dtype=np.int64)[piece]
                rows.append((doc, part, _pack(s + off, windows, anchor), gram.view(np.int64), whole.view(np.int64)))
            doc, part, at, gram, whole = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            if not len(doc):
                continue
            order = np.lexsort((at, part, doc, whole, gram))
            doc, part, at, gram, whole = (x[order] for x in (doc, part, at, gram, whole))
            same = np.concatenate([[False], (gram[1:] == gram[:-1]) & (whole[1:] == whole[:-1])])
            head = np.nonzero(~same)[0][np.cumsum(~same) - 1]
            again = same & ((doc != doc[head]) | (part != part[head]) | (at != at[head]))  # a repeated row is not later than itself
            # a settled row needs no meeting: it gets a key of its own
            gram = np.where(again, doc * np.int64(1_000_003) ^ part ^ at, gram)
            yield pd.DataFrame({"gram": gram, "whole": whole, "doc_id": doc, "part": part, "at": at, "again": again})

    rows = docs.mapInPandas(ranked, "gram long, whole long, doc_id long, part long, at long, again boolean")
    # one row of each pair is left besides the repeated ones
    seen = stage(_places(rows, "gram", "whole").where("again or nth = 1")
                 .select(F.expr("if(again, null, gram)").alias("gram"), "doc_id", "part", "at", "again"))
    start = F.shiftright("at", 16)
    windows = F.shiftright("at", 8).bitwiseAND(F.lit(255))
    whole_spans = stage(seen.where("again").select("doc_id", "part", start.alias("start"),
                                                   (start + windows - 1 + length).alias("end")))

    # a gram may stand in most documents: its pairs are counted map-side and joined, never held in one task
    pairs = seen.where("not again")
    shared = stage(pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    left = stage(pairs.join(shared, "gram").select("doc_id", "part", "at"))
    discard(seen, shared)
    return whole_spans, left


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, part, data): the UTF-8 bytes of each text; null texts are empty, null ids NO_ID.

    Rows that share a doc_id but not a text are parts of it, told apart by the
    64-bit hash of the text; a doc_id with one text has the one part 0.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.xxhash64(data).alias("hash"), data.alias("data"))
    several = stage(rows.groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
                    .where("low < high").select("doc_id", F.lit(True).alias("several")))
    return rows.join(several, "doc_id", "left").select("doc_id", F.expr("if(several, hash, 0L)").alias("part"), "data")


def remove_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """Documents without the bytes that a ``length``-byte string starting earlier covers.

    Earlier is: a smaller doc_id, or an earlier start in the same document.
    Strings never cross documents and are judged on the input.

    Cases: a null text is empty; a null doc_id comes after all others and stays
    null; rows that repeat doc_id and text are one document and each gets its
    result; texts that share a doc_id are told apart by a hash and ordered by
    it; an empty table gives no rows; other columns are not read.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).
    """
    d = keyed(docs)
    spans = (repeated_spans(d, length, first).groupBy("doc_id", "part")
             .agg(F.collect_set(F.struct("start", "end")).alias("spans")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, data, spans_ in zip(pdf["doc_id"], pdf["data"], pdf["spans"]):
                runs = merged([(s["start"], s["end"]) for s in spans_]) if spans_ is not None else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((doc, len(data), sum(b - a for a, b in runs), len(runs), b"".join(kept)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = d.join(spans, ["doc_id", "part"], "left").mapInPandas(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op4_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
