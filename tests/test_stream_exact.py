import random

import pytest
from pyspark.sql import functions as F

from loghound.operators import windows as win
from loghound.streaming import exact

END = 10 ** 7


@pytest.fixture(scope="module")
def state_store(spark):
    exact.use_state_store(spark)
    return spark


def arrivals(seed, n, late):
    """Files of events (ip, ts_s): roughly in order, a line at most ``late`` seconds behind the newest one before it."""
    rng = random.Random(seed)
    times = sorted(rng.choice([rng.randint(0, 4000), 1000 + rng.randint(0, 60)]) for _ in range(n))
    rows = [(f"198.51.100.{rng.choice([1, 1, 1, 2, 3, 4, 5, 6])}", t, t + rng.randint(0, late)) for t in times]
    rows.sort(key=lambda r: r[2])
    size = n // 4
    return [[r[:2] for r in rows[i:i + size]] for i in range(0, n, size)]


def run_stream(spark, tmp_path, files, make):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    schema = "ip string, ts_s bigint"
    # the last file only moves the watermark behind everything
    for i, rows in enumerate(files + [[("192.0.2.255", END)], [("192.0.2.255", END + 10 ** 6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"f{i}"))
        [part] = (tmp_path / f"f{i}").glob("*.parquet")
        (src / f"{i:02d}.parquet").write_bytes(part.read_bytes())
        query = (make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
                 .writeStream.outputMode("append").format("parquet").option("path", str(out))
                 .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        query.awaitTermination(240)
        assert query.exception() is None
    return spark.read.parquet(str(out))


def test_sliding_counts_equal_the_batch(state_store, tmp_path):
    spark = state_store
    files = arrivals(1, 400, late=200)
    got = run_stream(spark, tmp_path, files, lambda df: exact.stream_sliding_counts(df, ["ip"], 300, "300 seconds"))
    batch = win.sliding_counts(spark.createDataFrame([r for f in files for r in f], "ip string, ts_s bigint"), ["ip"], 300)
    rows = sorted(tuple(r) for r in got.filter(F.col("sec") < END).select("ip", "sec", "n", "prev").collect())
    assert rows == sorted(tuple(r) for r in batch.select("ip", "sec", "n", "prev").collect())


def test_trailing_failures_equal_the_batch(state_store, tmp_path):
    spark = state_store
    files = arrivals(2, 200, late=100)
    got = run_stream(spark, tmp_path, files, lambda df: exact.stream_trailing_failures(df, 600, "200 seconds"))
    batch = win.trailing_failures(spark.createDataFrame([r for f in files for r in f], "ip string, ts_s bigint"), 600)
    rows = sorted(tuple(r) for r in got.filter(F.col("ts_s") < END).select("ts_s", "w_failures", "w_ips").collect())
    assert rows == sorted(tuple(r) for r in batch.select("ts_s", "w_failures", "w_ips").collect())
