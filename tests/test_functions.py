from pyspark.sql import functions as F

from loghound.functions.decode import decode_levels, url_decode_once
from loghound.functions.net import ip_class, ip_to_long
from loghound.functions.priority import priority_label, priority_of


def test_lenient_decode(spark):
    df = spark.createDataFrame([("a+b%2Fc%41%zz%4",), ("%252e%252e%252f",), ("plain",)], "u string")
    out = df.select(url_decode_once(F.col("u")).alias("d"), decode_levels(F.col("u")).alias("lv")).collect()
    assert out[0].d == "a+b/cA%zz%4"
    assert out[1].lv == ["%252e%252e%252f", "%2e%2e%2f", "../"]
    assert out[2].lv == ["plain"]


def test_priority(spark):
    reasons = ["SQLインジェクション攻撃の可能性", "認証失敗 - ブルートフォースの可能性 (3回試行)", "高頻度アクセス (100回/5分)",
               "ディレクトリトラバーサル攻撃の可能性 (1回)", "不正なCONNECTメソッド使用", "機密ファイル探索"]
    df = spark.createDataFrame([(r,) for r in reasons], "r string")
    got = [(x.p, x.l) for x in df.select(priority_of(F.col("r")).alias("p"),
                                         priority_label(priority_of(F.col("r"))).alias("l")).collect()]
    assert got == [(10, "[高]"), (8, "[高]"), (7, "[中]"), (5, "[中]"), (1, "[低]"), (8, "[高]")]


def test_ip(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("8.8.8.8",), ("300.1.1.1",), ("172.20.0.1",)], "ip string")
    got = [(r.c, r.n) for r in df.select(ip_class(F.col("ip")).alias("c"), ip_to_long(F.col("ip")).alias("n")).collect()]
    assert got == [("private", 167838211), ("public", 134744072), ("invalid", None), ("private", 2886991873)]
