import tempfile

from loghound.streaming.alerts import start


def test_stream_alerts(spark):
    src = tempfile.mkdtemp(prefix="lh-src-")
    out = tempfile.mkdtemp(prefix="lh-out-")
    ck = tempfile.mkdtemp(prefix="lh-ck-")
    lines = []
    for i in range(120):
        lines.append(f'198.51.100.9 - - [01/Aug/2025:10:00:{i % 60:02d} +0000] "GET /x{i} HTTP/1.1" 200 10')
    for i in range(3):
        lines.append(f'198.51.100.10 - - [01/Aug/2025:10:01:0{i} +0000] "GET /missing HTTP/1.1" 404 10')
    with open(f"{src}/part-1.log", "w") as f:
        f.write("\n".join(lines) + "\n")
    for q in start(spark, src, out, ck, available_now=True):
        q.awaitTermination(120)
    high = spark.read.parquet(f"{out}/high_frequency")
    errs = spark.read.parquet(f"{out}/client_errors")
    assert high.filter("ip = '198.51.100.9'").count() > 0
    assert errs.filter("ip = '198.51.100.10' AND status = 404 AND n = 3").count() > 0
