import random

import pytest
from pyspark.sql import functions as F

from loghound.operators.report import write_detections
from loghound.plans.report_job import analyse
from loghound.sources.text import ordered_lines, read_log_lines


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    src = tmp_path / "logs"
    src.mkdir()
    want = []
    for name in ("a.log", "b.log", "c.log", "d.log"):
        lines = [f"{name} line {i} " + "x" * rng.randint(0, 60) for i in range(rng.choice([1, 300, 900]))]
        (src / name).write_text("\n".join(lines) + "\n")
        want += lines
    (src / "empty.log").write_text("")
    return str(src), want


@pytest.mark.parametrize("split", ["1000", "7001", "128m"])
@pytest.mark.parametrize("broadcast", [10 ** 6, 0])
def test_line_order_does_not_depend_on_splits(spark, folder, split, broadcast):
    src, want = folder
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = ordered_lines(read_log_lines(spark, src), broadcast).select("ord", "value").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.ord, r.value) for r in got) == list(enumerate(want))


DETS = "ip string, ts_s bigint, ord bigint, reason string"


def test_a_second_run_of_a_day_replaces_that_day_only(spark, tmp_path):
    path, day = str(tmp_path / "dets"), 86400
    first = [("198.51.100.1", 10 * day + 5, 1, "a"), ("198.51.100.1", 11 * day, 2, "a"), ("198.51.100.2", None, 3, "a")]
    write_detections(spark.createDataFrame(first, DETS), path)
    write_detections(spark.createDataFrame([("198.51.100.9", 11 * day + 9, 7, "b")], DETS), path)
    got = {(r.ord, r.reason, str(r.log_date)) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "a", "1970-01-11"), (7, "b", "1970-01-12"), (3, "a", "unknown")}
    write_detections(spark.createDataFrame([], DETS), path)  # a run without a day changes nothing
    assert spark.read.parquet(path).count() == 3


def test_files_to_report(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    at = "[01/Aug/2025:10:00:0{} +0000]"
    attack = f'203.0.113.5 - - {at.format(1)} "GET /q?a=1%27%20union%20select%20x-- HTTP/1.1" 200 5'
    (src / "1.log").write_text(attack + "\n# comment\n")
    (src / "2.log").write_text(f'10.0.0.1 - - {at.format(2)} "GET /read?f=../../etc/group HTTP/1.1" 200 5\nnoise\n')
    blocks = spark.createDataFrame([("203.0.113.0", "203.0.113.255", "AA")], "start_ip string, end_ip string, code string")
    names = spark.createDataFrame([("AA", "Aland")], "code string, name string")
    out = str(tmp_path / "out")
    analyse(spark, [str(src / "1.log"), str(src / "2.log")], out, blocks=blocks, names=names)
    assert spark.read.parquet(f"{out}/stats").first().asDict() == {
        "total": 4, "parsed": 2, "failed": 2, "parsed_pct": 50.0, "failed_pct": 50.0, "log_types": "access_log"}
    rows = spark.read.parquet(f"{out}/ranked").collect()
    assert {(r.ip, r.country) for r in rows} == {("203.0.113.5", "Aland"), ("10.0.0.1", "プライベートIP")}
    text = [r.value for r in spark.read.text(f"{out}/ranked_text").collect()]
    assert text[0].startswith("203.0.113.5 ") and "SQLインジェクション" in text[0]
    assert {r.reason for r in spark.read.parquet(f"{out}/rejects").collect()} == {"comment", "format"}
    assert spark.read.parquet(f"{out}/detections").filter(F.col("log_date") == "2025-08-01").count() >= 2
    assert {r.verdict for r in spark.read.parquet(f"{out}/files").collect()} == {"ok"}
