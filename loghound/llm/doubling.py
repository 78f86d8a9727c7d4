"""Prefix doubling over all places of a corpus: position rank pairs at growing offsets, sorted and reranked by Spark.

The query of operator 4 does not use it, as its shuffles hold a row for every
byte (figures in README); it gives the same spans and tests that query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghound.llm.common import discard, stage

#: Bytes that make the first rank: as an integer they are their own exact rank.
START = 8
#: Bytes whose places are made at once in a worker.
BLOCK_BYTES = 500_000
PLACE = ("doc_id", "part", "at")


def _first_pairs(docs: DataFrame, low: int) -> DataFrame:
    """(doc_id, part, at, rank, second): the first START bytes at each place and those that end ``low`` bytes on."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, part, data in zip(pdf["doc_id"], pdf["part"], pdf["data"]):
                for a in range(0, len(data) - low + 1, BLOCK_BYTES):
                    piece = np.frombuffer(data[a:a + BLOCK_BYTES + low - 1], dtype=np.uint8)
                    names = np.zeros(len(piece) - START + 1, dtype=np.uint64)
                    for j in range(START):
                        names = names << np.uint64(8) | piece[j:j + len(names)]
                    n = len(piece) - low + 1
                    yield pd.DataFrame({"doc_id": doc, "part": part, "at": np.arange(a, a + n),
                                        "rank": names[:n].view(np.int64),
                                        "second": names[low - START:low - START + n].view(np.int64)})

    return (docs.select("doc_id", "part", "data")
            .mapInPandas(run, "doc_id long, part long, at long, rank long, second long"))


def _rerank(pairs: DataFrame) -> DataFrame:
    """(doc_id, part, at, rank): pairs that stand once are gone, the others are named in their sorted order."""
    pairs = stage(pairs)
    names = stage(pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
                  .orderBy("rank", "second").withColumn("name", F.monotonically_increasing_id()))
    named = stage(pairs.join(names, ["rank", "second"]).select(*PLACE, F.col("name").alias("rank")))
    discard(pairs, names)
    return named


def doubled_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """Byte spans covered by a ``length``-byte string that also starts earlier, by prefix doubling.

    ``docs`` holds (doc_id, part, data), see ``repeats.keyed``.  A place whose
    string is unique so far can neither begin nor end a repeated longer one
    that is made of it, so it leaves; the others go on with twice the length
    until the threshold is reached, the last offset overlapping.

    Cases: repeated rows count once; a text shorter than ``length`` has no
    spans; an empty table gives no rows.  ``length`` is at least 2 * START.

    Returns doc_id, part, start, end; spans may overlap.
    """
    if length < 2 * START:
        raise ValueError(f"length must be at least {2 * START}")
    docs = docs.dropDuplicates(["doc_id", "part"])
    size = 2 * START
    ranks = _rerank(_first_pairs(docs, size))
    while size < length:
        step = min(size, length - size)
        second = ranks.select("doc_id", "part", (F.col("at") - step).alias("at"), F.col("rank").alias("second"))
        longer = _rerank(ranks.join(second, list(PLACE)))
        discard(ranks)
        ranks, size = longer, size + step
    first = ranks.groupBy("rank").agg(F.min(F.struct(*PLACE)).alias("first"))
    later = (ranks.join(first, "rank").where(F.struct(*PLACE) != F.col("first"))
             .select("doc_id", "part", F.col("at").alias("start"), (F.col("at") + length).alias("end")))
    out = stage(later)
    discard(ranks)
    return out
