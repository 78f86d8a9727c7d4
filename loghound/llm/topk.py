"""Exact top-k inner products by norm-bucketed retrieval (operator 2)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loghound.llm.common import prepare, stage, table

K = 5
BUCKET_ROWS = 4096
QUERY_ROWS = 1024
#: Coordinates that coordinate pruning looks at.
FOCUS = 4
#: Local cosine threshold from which coordinates prune better than length alone.
COORD_FROM = 0.75
_HITS = "query_id long, vec_id long, score long"


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, through float64 where these are exact."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), dtype=np.int64)
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if most < 2.0 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    big = q.astype(object) @ x.astype(object).T
    return np.clip(big, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _matrix(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:
        low = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.nonzero(scores >= low)[0]
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_bucket(queries: pd.DataFrame, bucket: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The k best candidates of one length bucket for each query that it can still serve.

    ``theta`` is the score that a query already has k times.  Its local
    cosine threshold is ``theta / (|query| * longest vector)``: above 1 the
    bucket is skipped; where it is high, the candidates must lie in the
    feasible range of the query's largest coordinates; else only their length
    must be enough.  What is left is verified by integer products.
    """
    if not len(queries) or not len(bucket):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    dim = max(max(map(len, queries["v"])), max(map(len, bucket["v"])))
    q, x = _matrix(queries["v"].tolist(), dim), _matrix(bucket["v"].tolist(), dim)
    qid, xid = queries["vec_id"].to_numpy(), bucket["vec_id"].to_numpy()
    theta = queries["theta"].to_numpy(dtype=float)
    qn, xn = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((x.astype(float) ** 2).sum(1))
    order = np.argsort(-xn, kind="stable")
    x, xid, xn = x[order], xid[order], xn[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(qn * xn[0] > 0, theta / (qn * xn[0]), np.where(theta > 0, np.inf, -np.inf))
    out = []

    def add(i, at, scores):
        at, scores = at[xid[at] != qid[i]], scores[xid[at] != qid[i]]
        best = _best(xid[at], scores, k)
        out.append((np.full(len(best), qid[i]), xid[at][best], scores[best]))

    slack = 1e-9
    coord = np.nonzero((local >= COORD_FROM) & (local <= 1 + slack))[0]
    if len(coord):
        unit = x / np.maximum(xn, 1e-300)[:, None]
        for i in coord:
            long_enough = np.searchsorted(-xn, -(theta[i] / qn[i]) * (1 - slack), side="right")
            keep = np.arange(long_enough)
            uq, t = q[i] / qn[i], min(1.0, local[i])
            for f in np.argsort(-np.abs(uq))[:FOCUS]:
                spread = math.sqrt(max(0.0, (1 - t * t) * (1 - uq[f] ** 2)))
                mid = uq[f] * t
                low = -1.0 if uq[f] < -t else mid - spread
                high = 1.0 if uq[f] > t else mid + spread
                keep = keep[(unit[keep, f] >= low - 1e-7) & (unit[keep, f] <= high + 1e-7)]
            if len(keep):
                add(i, keep, _products(q[i:i + 1], x[keep])[0])
    # length pruning: queries in the order of the prefix they need, a block product each
    by_length = np.nonzero(local < COORD_FROM)[0]
    need = np.where(theta[by_length] > 0, np.searchsorted(
        -xn, -np.divide(theta[by_length], qn[by_length], out=np.zeros(len(by_length)),
                        where=qn[by_length] > 0) * (1 - slack), side="right"), len(xn))
    for a in range(0, len(by_length), 64):
        part = np.argsort(need, kind="stable")[a:a + 64]
        most = int(need[part].max()) if len(part) else 0
        if most:
            scores = _products(q[by_length[part]], x[:most])
            for r, j in enumerate(part):
                add(by_length[j], np.arange(need[j]), scores[r, :need[j]])
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    a, b, c = (np.concatenate(z) for z in zip(*out))
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})


def quantized(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; rows with a null id, a null vector or a
    null or non-finite component take no part, equal rows count once."""
    ok = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall(
        "e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                              F.col("embedding").cast("array<double>").alias("e"))
            .where(F.coalesce(ok, F.lit(False)))
            .select("vec_id", F.transform("e", lambda x: F.floor(F.lit(scale) * x)).alias("v")).distinct())


def top_products(vectors: DataFrame, is_query: Column, k: int = K,
                 bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` highest integer inner products of every query with all rows but its own.

    ``vectors`` has vec_id and v.  Rows are sorted by length into buckets of
    about ``bucket_rows``; queries go in blocks of about ``query_rows``.  The
    longest bucket gives each query a first threshold, then every (bucket,
    block) pair is one small group that prunes by its local thresholds.  No
    task holds more than a bucket and a block, and the rows that move are
    ``queries * buckets + rows * blocks``.

    Cases: ties go to the smaller vec_id; fewer candidates than ``k`` give
    fewer rows; vectors of different length count missing components as 0; an
    empty vector scores 0; an empty table gives no rows.

    Returns query_id, rank, vec_id, score.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    flat = stage(vectors.select("vec_id", "v", norm.alias("norm"), is_query.alias("is_query")))
    n, n_query = flat.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    buckets, blocks = max(1, math.ceil(n / bucket_rows)), max(1, math.ceil(n_query / query_rows))
    by_length = stage(flat.repartitionByRange(buckets, F.desc("norm"), "vec_id")
                      .withColumn("bucket", F.spark_partition_id()))
    queries = by_length.where("is_query").select(
        "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def run(left, right, keys):
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both come from one table
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            lambda a, b: search_bucket(a, b, k), _HITS)

    first = stage(run(queries.withColumn("theta", F.lit(float("-inf"))),
                      by_length.where("bucket = 0").select("vec_id", "v", all_blocks), ["block"]))
    kth = (first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
           .where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("low").cast("double").alias("theta")))
    hits = first
    if buckets > 1:
        ready = queries.join(kth, "vec_id", "left").fillna(float("-inf"), ["theta"])
        later = F.explode(F.sequence(F.lit(1), F.lit(buckets - 1))).alias("bucket")
        hits = first.union(run(ready.select("vec_id", "v", "theta", "block", later),
                               by_length.where("bucket > 0").select("vec_id", "v", "bucket", all_blocks),
                               ["bucket", "block"]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (hits.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op2_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return top_products(quantized(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
