import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghound.llm import negatives


def brute(rows, positives=5, count=3):
    """rows: {id: (label, ints)} -> set of result rows, straight from the contract."""
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, v) in rows.items():
        if a % 50:
            continue
        scored = [(score(v, w), i, other) for i, (other, w) in rows.items() if i != a]
        mine = sorted((-s, i) for s, i, other in scored if other == label)[:positives]
        for neg, pid in mine:
            ps = -neg
            hard = sorted((-s, i) for s, i, other in scored
                          if other != label and 50 * ps <= 100 * s <= 95 * ps)[:count]
            out |= {(a, pid, r + 1, i, ps, -s) for r, (s, i) in enumerate(hard)}
    return out


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 9), (33, 64, 70), (130, 65, 37), (64, 64, 64)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    n, k, m = shape
    for top in (300, 2 ** 30):
        a, b = rng.integers(-top, top, (n, k)), rng.integers(-top, top, (k, m))
        assert (negatives.strassen(a, b, leaf=4) == a @ b).all()


def test_scores_beyond_64_bits_are_clipped():
    big = 2 ** 62
    assert negatives.tile_scores([[big, big]], [[4, 4], [-4, -4], [1, -1]]).tolist() == [[2 ** 63 - 1, 1 - 2 ** 63, 0]]


def test_window_bounds():
    for s in range(-200, 400):
        low, high = negatives.window_of(s)
        assert [x for x in range(-500, 500) if 50 * s <= 100 * x <= 95 * s] == list(range(low, high + 1))


@pytest.mark.parametrize("kind", ["even", "lengths", "ties", "hot", "far"])
def test_against_brute_force(spark, kind):
    rng = random.Random(4)
    rows = []
    for i in range(420):
        scale = 10 ** rng.uniform(-2, 1) if kind == "lengths" else 1.0
        v = [float(rng.randint(0, 1)) for _ in range(8)] if kind == "ties" else \
            [scale * rng.gauss(0.6 if kind != "far" else 0, 1) for _ in range(8)]
        rows.append((i, v, 3 if kind == "hot" and i % 3 else rng.randint(0, 4), "x"))
    good = {i: (v, y) for i, v, y, _ in rows}
    rows += [(1000, None, 1, None), (1001, [1.0, None], 1, None), (1002, [float("nan")] * 8, 2, None),
             (1003, [float("inf")] * 8, 2, None), (None, [1.0] * 8, 1, None), (1004, [1.0] * 8, None, None),
             (50, rows[50][1], rows[50][2], "again"), (1050, [0.5] * 3, 1, None), (1100, [], 1, None)]
    good[1050], good[1100] = ([0.5] * 3, 1), ([], 1)
    want = {}
    for i, (v, y) in good.items():
        y = (y + 1) % 10 if i % 7 == 0 else y
        want[i] = (y, [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, slot string")
    got = negatives.hard_negatives(negatives.mining_rows(df), F.col("vec_id") % 50 == 0, tile_rows=64, anchor_rows=3)
    got = [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
           for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(want)


def test_an_id_with_two_rows_counts_once(spark):
    df = spark.createDataFrame([(50, [1.0], 2), (50, [2.0], 1), (51, [1.0], 1), (52, [0.75], 3)],
                               "vec_id long, embedding array<float>, label int")
    got = negatives.hard_negatives(negatives.mining_rows(df), F.col("vec_id") % 50 == 0).collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id, r.positive_score) for r in got] == [(50, 51, 52, 512 * 256)]


def test_empty_and_without_anchors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 1)], [(50, [1.0], 1)]):
        df = spark.createDataFrame(rows, schema)
        assert negatives.hard_negatives(negatives.mining_rows(df), F.col("vec_id") % 50 == 0).count() == 0
