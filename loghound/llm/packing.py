"""Variable-capacity best-fit packing (operator 10)."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghound.llm.common import prepare, stage, table, word_count

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence of c tokens: FIXED + c + c * c / SQUARE (set-up, linear layers, attention).
FIXED = 32.0
SQUARE = 16384.0
#: Pieces that are packed together on average.
SHARD_ROWS = 30000
#: Equal rows that one array numbers.
COPIES_AT_ONCE = 10000


def sequence_cost(capacity: int, fixed: float = FIXED, square: float = SQUARE) -> float:
    return fixed + capacity + capacity * capacity / square


def pack_lengths(lengths: np.ndarray, capacities=CAPACITIES, fixed: float = FIXED,
                 square: float = SQUARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity of its bin) for each length.

    Items go in falling order into the open bin that they fill best.  Where
    none has room, a bin is opened at the permitted length whose cost for each
    token that it can be expected to hold is least: the item and what smaller
    items are left.  At the end each bin is downsized to the smallest
    permitted length that holds its contents.
    """
    caps = sorted(capacities)
    cost = {c: sequence_cost(c, fixed, square) for c in caps}
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    behind = np.concatenate([np.cumsum(falling[::-1])[::-1], [0]])  # tokens from each place on
    rising = falling[::-1]
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    room: list[tuple[int, int]] = []  # (free tokens, bin), ascending
    size, used = [], []
    for at, (i, length) in enumerate(zip(order.tolist(), falling.tolist())):
        k = bisect_left(room, (length, -1))
        if k < len(room):
            _, b = room.pop(k)
        else:
            def rate(c):
                small = n - int(np.searchsorted(rising, c - length, side="right"))  # first item that fits beside
                return cost[c] / (length + min(c - length, int(behind[max(at + 1, small)])))
            b = len(size)
            size.append(min((c for c in caps if c >= length), key=rate))
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        if size[b] > used[b]:
            insort(room, (size[b] - used[b], b))
    final = np.array([caps[bisect_left(caps, u)] for u in used], dtype=np.int64)
    return bins, offsets, final[bins] if n else np.zeros(0, dtype=np.int64)


def pack(docs: DataFrame, capacities=CAPACITIES, fixed: float = FIXED, square: float = SQUARE,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack whole documents into training sequences of several permitted lengths.

    Needs ``doc_id`` and ``text``; a token is a word.  A document longer than
    the longest sequence is cut into full sequences and a rest.  Pieces are
    dealt by a hash of doc_id, text, copy and piece to shards of about
    ``shard_rows`` pieces; a shard is packed in one task, so memory stays
    bounded at any size and the loss against one global packing is below one
    open bin of each length per shard.  The packing does not depend on the
    order or the files of the rows.

    Cases: a text that is null or has no words gets one row without a bin
    (``bin_id`` and ``capacity`` null, 0 tokens); repeated rows are packed as
    often as they occur; an empty table gives no rows; other columns are not
    read.

    Returns doc_id, piece, start_token, n_tokens, bin_id, capacity, bin_offset.
    """
    longest = max(capacities)
    cut = F.greatest(F.lit(0), F.ceil(F.col("size") / longest) - 1)
    same = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"),
                        word_count(F.col("text")).alias("size"))
            .groupBy("doc_id", "hash", "size").agg(F.count(F.lit(1)).alias("n")))
    # equal rows are told apart by a number, in two steps: no array of all of them is made
    copies = (same.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES_AT_ONCE})")).alias("_lot"))
              .select("doc_id", "hash", "size", F.explode(F.expr(
                  f"sequence(_lot * {COPIES_AT_ONCE}, least(n, (_lot + 1) * {COPIES_AT_ONCE}) - 1)")).alias("copy")))
    pieces = stage(copies
                   .select("*", F.explode(F.sequence(F.lit(0).cast("long"), cut.cast("long"))).alias("piece"))
                   .withColumn("start_token", F.col("piece") * longest)
                   .withColumn("n_tokens", F.least(F.lit(longest), F.col("size") - F.col("start_token"))))
    shards = max(1, -(-pieces.count() // shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "hash", "copy"], ascending=[False, True, True, True, True])
        b, o, c = pack_lengths(pdf["n_tokens"].to_numpy(), capacities, fixed, square)
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "piece": pdf["piece"].to_numpy(),
                             "start_token": pdf["start_token"].to_numpy(), "n_tokens": pdf["n_tokens"].to_numpy(),
                             "bin_id": (shard << 32) + b, "capacity": c, "bin_offset": o})

    schema = "doc_id long, piece long, start_token long, n_tokens long, bin_id long, capacity long, bin_offset long"
    full = (pieces.where("n_tokens > 0")
            .withColumn("shard", F.pmod(F.xxhash64("doc_id", "hash", "copy", "piece"), F.lit(shards)).cast("long"))
            .groupBy("shard").applyInPandas(run, schema))
    none = pieces.where("n_tokens <= 0").select(
        "doc_id", "piece", "start_token", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("long").alias("capacity"), F.lit(None).cast("long").alias("bin_offset"))
    return full.union(none)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(table(spark, sf_dir, "documents"))
