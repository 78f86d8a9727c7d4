"""The packing against a plain best fit, and its independence of row order and files."""

import random
from bisect import bisect_left

from pyspark.sql import functions as F

from loghound.llm import packing


def rows_of(df):
    return sorted(map(tuple, packing.pack(df, shard_rows=50).collect()), key=repr)


def test_packing_does_not_depend_on_order_or_files(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(60)]), " ".join("w" * rnd.randrange(0, 400))) for _ in range(120)]
    rows += [(7, "same text here")] * 80
    schema = "doc_id long, text string"
    one = rows_of(spark.createDataFrame(rows, schema).coalesce(1))
    rnd.shuffle(rows)
    assert rows_of(spark.createDataFrame(rows, schema).repartition(7)) == one
    assert sum(r[0] == 7 and r[3] == 3 for r in one) >= 80


def test_many_equal_rows_are_numbered_in_lots(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES_AT_ONCE", 4)
    df = spark.range(23).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    assert packing.pack(df).count() == 23


def test_best_fit_against_scanning_all_bins():
    rnd = random.Random(3)
    for _ in range(20):
        lengths = [rnd.randrange(1, 300) for _ in range(60)]
        caps = (100, 200, 300)
        bins, offsets, capacity = packing.pack_lengths(packing.np.array(lengths), caps)
        order = sorted(range(60), key=lambda i: -lengths[i])
        used, size = [], []
        for at, i in enumerate(order):
            fits = [(size[b] - used[b], b) for b in range(len(used)) if size[b] - used[b] >= lengths[i]]
            if fits:
                b = min(fits)[1]
            else:
                def rate(c):
                    more = sum(lengths[j] for j in order[at + 1:] if lengths[j] <= c - lengths[i])
                    return packing.sequence_cost(c) / (lengths[i] + min(c - lengths[i], more))
                size.append(min((c for c in caps if c >= lengths[i]), key=rate))
                used.append(0)
                b = len(used) - 1
            assert (bins[i], offsets[i]) == (b, used[b])
            used[b] += lengths[i]
        assert [int(c) for c in capacity] == [caps[bisect_left(caps, used[b])] for b in bins]
