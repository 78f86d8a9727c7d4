import random
import re
import time

from pyspark.sql import functions as F

from loghound.functions.decode import decode_levels
from loghound.functions.priority import SHELL_PRIORITY_TABLE
from loghound.operators import shell_merge as M
from loghound.operators.patterns import (SQL_REGEX_DETAILED, SQL_REGEX_EXTRA, SQL_REGEX_FAST, TRAVERSAL_REGEX_DETAILED,
                                         TRAVERSAL_REGEX_EXTRA, TRAVERSAL_REGEX_FAST)
from loghound.operators.signatures import _alternation, gated_match, required_literals

SCHEMA = ("ip string, ts_s long, ord long, seq int, kind string, number int, reason string, count long, "
          "threat_level string, log_source string")


def det(ip, ts, ord_, kind, count=1, number=None, source="access_log", reason=None, seq=1):
    return (ip, ts, ord_, seq, kind, number, reason or kind, count, "MEDIUM", source)


def merged_one_by_one(rows):
    """The rule, detection after detection, for one client."""
    prio = dict(SHELL_PRIORITY_TABLE)
    text, best, sources = None, 0, []
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        reason = r[4]
        p = prio.get(re.sub(r" \[(CRITICAL|HIGH|MEDIUM|LOW)\]$", "", reason), 1)
        if text is None:
            text, best, sources = reason, p, [r[9]]
        elif reason not in text:
            text, best = (f"{reason} + {text}", p) if p > best else (f"{text} + {reason}", best)
            sources.append(r[9])
    return text, best, set(sources)


def test_merge_against_the_rule(spark):
    rng = random.Random(6)
    kinds = [t for t, _ in SHELL_PRIORITY_TABLE] + ["WAF攻撃ブロック - ModSecurity検出 [HIGH]", "アクセス制御違反 [MEDIUM]"]
    rows, n = [], 0
    for c in range(40):
        own = rng.sample(kinds, rng.randint(1, 8))
        for _ in range(rng.randint(1, 30)):
            k = rng.choice(own)
            n += 1
            rows.append(det(f"198.51.100.{c}", rng.randint(0, 50), n, k, rng.randint(1, 9),
                            source="error_log" if "[" in k else "access_log", seq=rng.randint(1, 5)))
    got = {r.ip: r for r in M.shell_verdicts(spark.createDataFrame(rows, SCHEMA), "access_log").collect()}
    assert len(got) == 40
    for ip, r in got.items():
        mine = [x for x in rows if x[0] == ip]
        text, prio, sources = merged_one_by_one(mine)
        assert (r.reason, r.priority, r["count"], r.detections) == (text, prio, max(x[7] for x in mine), len(mine))
        assert r.integrated == (len(sources) == 2)
        assert r.source == (M.BOTH_SOURCES if len(sources) == 2 else
                            M.ERROR_SOURCE if sources == {"error_log"} else "access_log検出")


def test_running_numbers_are_one_kind(spark):
    rows = [det("198.51.100.1", i, i, M.TRAVERSAL_REASON, number=i + 1, seq=4) for i in range(7)]
    rows.append(det("198.51.100.1", 3, 99, M.SQL_REASON, seq=3))
    r = M.shell_verdicts(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.reason == f"{M.SQL_REASON} + {M.TRAVERSAL_REASON} (高リスク・7回)" and r.detections == 8


def test_ranking_order_and_display(spark):
    rows = [det("198.51.100.9", 1, 1, "高頻度アクセス", 120),
            det("198.51.100.8", 1, 2, "高頻度アクセス", 120), det("198.51.100.8", 1, 3, "アクセス制御違反 [MEDIUM]", source="error_log"),
            det("198.51.100.10", 1, 4, "高頻度アクセス", 120),
            det("198.51.100.7", 1, 5, "大量の400系エラー - スキャン/攻撃の可能性"), det("198.51.100.7", 2, 6, "タイムアウト攻撃"),
            det("198.51.100.7", 2, 7, "不正リクエスト攻撃"), det("198.51.100.7", 2, 8, "コンテンツネゴシエーション攻撃")]
    out = M.ranked(M.shell_ranking(M.shell_verdicts(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert [r.ip for r in out] == ["198.51.100.8", "198.51.100.10", "198.51.100.9", "198.51.100.7"]
    assert out[0].rank_priority == 8 and out[0].label == "[高]" and out[0].reason_text.endswith(f"[{M.BOTH_SOURCES}]")
    text = out[3].reason_text.removeprefix("[中] ")
    assert text.endswith("... [混在ログ検出]") and len(text) == 59  # 55 with the source, three dots and a blank


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.shell_verdicts(none).count() == 0 and M.shell_summary(none).count() == 0


def test_first_step_is_a_hash_aggregate(spark):
    df = spark.createDataFrame([det("198.51.100.1", 1, 1, "x")], SCHEMA)
    plan = M.kinds_of_clients(df)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_gate_changes_nothing(spark):
    rng = random.Random(8)
    lists = [SQL_REGEX_FAST, SQL_REGEX_DETAILED + SQL_REGEX_EXTRA, TRAVERSAL_REGEX_FAST,
             TRAVERSAL_REGEX_DETAILED + TRAVERSAL_REGEX_EXTRA]
    parts = [lit for p in lists for lit in required_literals(p)] + ["union", "select", " ", "=", "(", ")", "etc", "1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(1500)] + ["", "/index.html"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in lists:
        r = df.select(gated_match(F.col("t"), patterns).alias("a"), F.col("t").rlike(_alternation(patterns)).alias("b"))
        assert r.filter("a <> b").count() == 0 and 0 < r.filter("a").count() < len(texts)


def test_levels_of_a_long_url_take_one_look_each(spark):
    deep = "%" + "25" * 40 + "41"
    got = spark.createDataFrame([("a%2541",), ("a",), ("%zz",), (deep,)], "u string").select(
        decode_levels(F.col("u")).alias("l")).collect()
    assert got[0].l == ["a%2541", "a%41", "aA"] and got[1].l == ["a"] and got[2].l == ["%zz"]
    assert len(got[3].l) == 42 and got[3].l[-1] == "A"
    df = spark.createDataFrame([("x" * 32000 + "%20",)], "u string").select(F.size(decode_levels(F.col("u"))).alias("n"))
    df.collect()  # compiled
    t = time.time()
    assert df.first().n == 2
    assert time.time() - t < 2
