import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghound.llm import topk


@pytest.mark.parametrize("kind", ["even", "lengths", "ties"])
def test_against_brute_force(spark, kind):
    rng = random.Random(3)
    scale = {"even": lambda: 1.0, "lengths": lambda: 10 ** rng.uniform(-2, 2), "ties": lambda: 1.0}[kind]
    rows = []
    for i in range(300):
        s = scale()
        v = [s * rng.gauss(0, 1) for _ in range(8)] if kind != "ties" else [float(rng.randint(0, 1)) for _ in range(8)]
        rows.append((i, v))
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8),
             (0, rows[0][1]), (304, []), (350, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(
        topk.quantized(df), F.col("vec_id") % 50 == 0, bucket_rows=60, query_rows=4).collect()}
    good = {i: np.array([np.floor(256 * x) for x in v] + [0.0] * (8 - len(v))) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 50 == 0:
            best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_products(topk.quantized(df), F.col("vec_id") % 50 == 0).count() == 0
