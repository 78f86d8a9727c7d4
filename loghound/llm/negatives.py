"""Hard-negative mining over Strassen products of anchor-candidate tiles (operator 11)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loghound.llm.common import prepare, stage, table

POSITIVES = 5
NEGATIVES = 3
#: A negative scores between these shares (in hundredths) of its positive's score.
LOWEST, HIGHEST = 50, 95
TILE_ROWS = 4096
ANCHOR_ROWS = 1024
#: Strassen's recursion ends where a side is at most this long.
LEAF = 32
#: Lengths are compared by steps of 1 / NORM_STEPS powers of two; their number is bounded by the width of a double.
NORM_STEPS = 8
_HITS = "anchor_id long, vec_id long, score long"
_WINDOWS = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two small tiles: through float64 only where every partial sum is an exact integer."""
    if a.dtype != object and a.size and b.size:
        most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
        if most < 2.0 ** 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(a: np.ndarray) -> np.ndarray:
    """Zero padding to an even number of rows and columns."""
    rows, cols = a.shape[0] % 2, a.shape[1] % 2
    return np.pad(a, ((0, rows), (0, cols))) if rows or cols else a


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` by Strassen's seven products of quarter tiles, exact in the integers of the tiles."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    h, w, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b12, b21, b22 = b[:w, :c], b[:w, c:], b[w:, :c], b[w:, c:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * c), dtype=m1.dtype)
    out[:h, :c] = m1 + m4 - m5 + m7
    out[:h, c:] = m3 + m5
    out[h:, :c] = m2 + m4
    out[h:, c:] = m1 - m2 + m3 + m6
    return out[:n, :m]


def _tile(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def tile_scores(anchors: list, candidates: list) -> np.ndarray:
    """Integer inner products of two lists of vectors; missing components count as 0.

    Scores that could leave 64 bits are made with Python integers and clipped
    to 63 bits and a sign.
    """
    dim = max([1] + [len(v) for v in anchors] + [len(v) for v in candidates])
    a, b = _tile(anchors, dim), _tile(candidates, dim).T
    most = max(abs(int(a.min())), int(a.max())) * max(abs(int(b.min())), int(b.max())) * dim
    if most < 2 ** 62:
        return strassen(a, b)
    return np.clip(strassen(a.astype(object), b.astype(object)), 1 - 2 ** 63, 2 ** 63 - 1).astype(np.int64)


def window_of(score: int) -> tuple[int, int]:
    """The least and the greatest integer score inside the window of a positive."""
    return -((-LOWEST * score) // 100), (HIGHEST * score) // 100


def _first(order_scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        low = np.partition(order_scores, len(ids) - k)[len(ids) - k]
        keep = np.nonzero(order_scores >= low)[0]
        return keep[np.lexsort((ids[keep], -order_scores[keep]))[:k]]
    return np.lexsort((ids, -order_scores))[:k]


def positives_of_tile(anchors: pd.DataFrame, tile: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per anchor the heap of its ``k`` best other rows in one tile of its own label."""
    out = []
    if len(anchors) and len(tile):
        scores = tile_scores(anchors["v"].tolist(), tile["v"].tolist())
        ids = tile["vec_id"].to_numpy()
        for i, anchor in enumerate(anchors["vec_id"].to_numpy()):
            other = np.nonzero(ids != anchor)[0]
            best = other[_first(scores[i, other], ids[other], k)]
            out.append(pd.DataFrame({"anchor_id": anchor, "vec_id": ids[best], "score": scores[i, best]}))
    return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "vec_id": [], "score": []}).astype("int64")


def windows_of_tile(anchors: pd.DataFrame, tile: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per (anchor, positive) the heap of its ``k`` best negatives in one tile.

    The scores of an anchor are sorted once; each window is then a slice.
    """
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    out = []
    if len(anchors) and len(tile):
        scores = tile_scores(anchors["v"].tolist(), tile["v"].tolist())
        ids, labels = tile["vec_id"].to_numpy(), tile["label"].to_numpy()
        for i, (anchor, label, pos) in enumerate(zip(anchors["vec_id"], anchors["label"], anchors["positives"])):
            windows = [(p["vec_id"], p["score"], *window_of(int(p["score"]))) for p in pos]
            low, high = min(w[2] for w in windows), max(w[3] for w in windows)
            at = np.nonzero((scores[i] >= low) & (scores[i] <= high) & (labels != label))[0]
            at = at[np.lexsort((ids[at], scores[i, at]))]
            s = scores[i, at]
            for pid, ps, lo, hi in windows:
                a, b = np.searchsorted(s, lo, "left"), np.searchsorted(s, hi, "right")
                if a >= b:
                    continue
                # all ties of the k-th best score of the slice are looked at
                part = at[np.searchsorted(s, s[max(a, b - k)], "left"):b]
                part = part[np.lexsort((ids[part], -scores[i, part]))[:k]]
                out += [(anchor, pid, ps, ids[j], scores[i, j]) for j in part]
    return pd.DataFrame(out, columns=names).astype("int64")


def mining_rows(embeddings: DataFrame, scale: float = 256.0, relabel_every: int = 7, classes: int = 10) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component, labels of every seventh id moved by one.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part.  A component beyond 64 bits takes the nearest
    long.  An id that repeats counts once, with its least (label, vector).
    """
    ok = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()
          & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    label = F.col("label").cast("long")
    return (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                              F.col("embedding").cast("array<double>").alias("e"))
            .where(F.coalesce(ok, F.lit(False)))
            .select("vec_id", F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % classes)
                    .otherwise(F.col("label")).alias("label"),
                    F.transform("e", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"))
            .groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_row"))
            .select("vec_id", "_row.label", "_row.v"))


def _norm_step(norm: Column) -> Column:
    """A length as a step on a logarithmic scale; anything below 1 is step 0."""
    return F.floor(F.log2(F.greatest(norm, F.lit(1.0))) * NORM_STEPS).cast("int")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   tile_rows: int = TILE_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Hard negatives of every (anchor, positive).

    ``rows`` has vec_id (unique), label and v.  Two rounds of tile products:

    1. Candidates meet only anchors of their own label, tile by tile; each
       (anchor, tile) gives a heap of at most ``positives`` rows and the heaps
       of an anchor merge into its positives.
    2. Rows lie in tiles by falling length.  An anchor is dealt to the tiles
       whose longest row can still reach the least score of its windows
       (length times length bounds the product); a tile goes only to the
       anchor blocks that were dealt to it.  Each (anchor, positive, tile)
       gives a heap of at most ``negatives`` rows, and these merge.

    A task holds one tile of about ``tile_rows`` rows and one block of about
    ``anchor_rows`` anchors, whatever share one label has.

    Cases: ties go to the smaller vec_id; fewer rows than asked give fewer
    rows; a positive with a negative score has an empty window; vectors of
    different length count missing components as 0; an empty table, or one
    without anchors, gives no rows; more columns are not read.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    flat = stage(rows.select("vec_id", "label", "v", norm.alias("norm"), is_anchor.alias("is_anchor")))
    n = flat.count()
    tiles = max(1, math.ceil(n / tile_rows))

    # round 1: within each label, tiles and blocks by a hash of the id
    sizes = flat.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("n_anchor"))
    sizes = sizes.where("n_anchor > 0").select(
        "label", F.ceil(F.col("n") / tile_rows).cast("int").alias("slots"),
        F.ceil(F.col("n_anchor") / anchor_rows).cast("int").alias("blocks"))
    dealt = flat.join(sizes, "label")
    own_slot = F.pmod(F.xxhash64("vec_id"), F.col("slots")).cast("int").alias("slot")
    own_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    keys = ["label", "slot", "block"]
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name)
    left = dealt.where("is_anchor").select("vec_id", "v", "label", every("slots", "slot"), own_block)
    right = dealt.select("vec_id", "v", "label", own_slot, every("blocks", "block"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both come from one table
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda a, b: positives_of_tile(a, b, positives), _HITS)
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    merged = (near.withColumn("_at", best).where(F.col("_at") <= positives).groupBy("anchor_id")
              .agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"),
                   F.min(F.when(F.col("score") >= 0, F.col("score"))).alias("least")))
    # least length of a candidate that can reach the lowest window; null: no window is open
    anchors = stage(flat.where("is_anchor").join(merged.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
                    .where("least IS NOT NULL")
                    .select("vec_id", "label", "v", "positives",
                            F.when(F.col("norm") > 0, F.col("least") * (LOWEST / 100) / F.col("norm"))
                            .otherwise(F.lit(0.0)).alias("reach")))

    # round 2: tiles by falling length
    blocks = max(1, math.ceil(anchors.count() / anchor_rows))
    tiled = stage(flat.select("vec_id", "label", "v", "norm")
                  .repartitionByRange(tiles, F.desc("norm"), "vec_id").withColumn("slot", F.spark_partition_id()))
    # for each step of length the last tile that holds such a row: bounded by the steps of a double
    last = (tiled.groupBy(_norm_step(F.col("norm")).alias("step")).agg(F.max("slot").alias("slot"))
            .withColumn("slot", F.max("slot").over(Window.orderBy(F.desc("step")))))
    ends = sorted((r["step"], r["slot"]) for r in last.collect())
    # rounding in `reach` stays within one step, so one step less is asked for
    wanted = _norm_step(F.col("reach")) - 1
    until = F.coalesce(F.lit(None).cast("int"), *[F.when(F.lit(step) >= wanted, F.lit(slot)) for step, slot in ends])
    blocked = stage(anchors.repartitionByRange(blocks, "reach", "vec_id").withColumn("block", F.spark_partition_id())
                    .withColumn("_until", until).where("_until IS NOT NULL"))
    left = blocked.select("vec_id", "label", "v", "positives", "block",
                          F.explode(F.sequence(F.lit(0), F.col("_until"))).alias("slot"))
    pairs = (blocked.groupBy("block").agg(F.max("_until").alias("_until"))
             .select("block", F.explode(F.sequence(F.lit(0), F.col("_until"))).alias("slot")))
    right = tiled.drop("norm").join(pairs, "slot")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    keys = ["slot", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda a, b: windows_of_tile(a, b, negatives), _WINDOWS)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id")
                               .orderBy(F.desc("negative_score"), "negative_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))


def op11_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return hard_negatives(mining_rows(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
