from loghound.operators import shell_rules
from loghound.operators import windows as win


def _req(spark, rows):
    return spark.createDataFrame(rows, "ip string, ts_s bigint, ord bigint, status int")


def test_high_frequency_edges(spark):
    # 99 requests in 300 s: nothing; the 100th inside the window fires with 100
    rows = [("1.1.1.1", 1000 + i * 3, i, 200) for i in range(99)]
    assert win.high_frequency(_req(spark, rows)).count() == 0
    rows.append(("1.1.1.1", 1000 + 98 * 3, 99, 200))
    hits = win.high_frequency(_req(spark, rows)).collect()
    assert [h["count"] for h in hits] == [100]
    # second 301 after the first request drops it from the window
    far = [("2.2.2.2", 0, 0, 200)] + [("2.2.2.2", 301, i, 200) for i in range(1, 100)]
    assert win.high_frequency(_req(spark, far)).count() == 0


def test_sliding_counts_bucket_halo(spark):
    # events straddling an hour bucket boundary see their full look-back
    rows = [("a", 3599 - i, i, 404) for i in range(5)] + [("a", 3601, 10, 404)]
    counts = {r["sec"]: r["prev"] for r in win.sliding_counts(_req(spark, rows), ["ip"]).collect()}
    assert counts[3601] == 5


def test_client_error_thresholds(spark):
    rows = [("3.3.3.3", 100 + i, i, 404) for i in range(3)]
    hits = win.client_errors(_req(spark, rows)).collect()
    assert [h["reason"] for h in hits] == ["リソース探索/偵察活動 (3回/5分)"]
    mixed = [("4.4.4.4", 100 + i, i, 404 if i % 2 else 403) for i in range(5)]
    last = sorted(win.client_errors(_req(spark, mixed)).collect(), key=lambda r: r["ord"])[-1]
    assert last["reason"] == "複合的な400系エラー攻撃 (2種類・5回/5分)"
    assert win.client_errors(_req(spark, [("5.5.5.5", 1, 0, 429), ("5.5.5.5", 2, 1, 429)])).count() == 1


def test_running_rank(spark):
    rows = [("a", 7200 * (i % 3), i, 200) for i in range(9)]
    ranked = win.running_rank(_req(spark, rows), ["ip"], "n").collect()
    assert sorted(r["n"] for r in ranked) == list(range(1, 10))


def test_running_rank_without_time(spark):
    # rows without time come first, by line; one second holds many rows
    rows = [("a", None, i * 5000, 200) for i in range(4)] + [("a", 7, 30000 - i, 200) for i in range(4)]
    ranked = win.running_rank(_req(spark, rows), ["ip"], "n").orderBy("ord").collect()
    assert [r["n"] for r in ranked] == list(range(1, 9))


def _shell(spark, rows):
    found = shell_rules.shell_client_errors(_req(spark, rows)).orderBy("ord").collect()
    return [(r["ord"], r["count"], r["reason"]) for r in found]


def test_shell_client_errors(spark):
    rows = [("1.0.0.1", 100 + i, i, 404) for i in range(10)]
    found = _shell(spark, rows)
    assert found[0] == (4, 5, "大量の400系エラー - リソース探索/偵察活動")
    assert found[-1] == (9, 10, "リソース探索/偵察活動")
    # 300 s back counts, 301 s back does not
    assert _shell(spark, [("1.0.0.2", t, t, 401) for t in (0, 1, 300)])[0][1] == 3
    assert _shell(spark, [("1.0.0.2", t, t, 401) for t in (0, 1, 301)]) == []
    # a second kind, an instant status, a line without time
    rows = [("1.0.0.3", None, 0, 404), ("1.0.0.3", 5, 1, 410), ("1.0.0.3", None, 2, 408)]
    assert _shell(spark, rows) == [(1, 3, "複合的な400系エラー攻撃"), (2, 1, "不完全なHTTPリクエスト")]
    assert _shell(spark, [("1.0.0.4", 5, 1, 200)]) == []


def test_client_error_classes(spark):
    rows = [("a", 5, 1, 404), ("a", 1, 2, 410), ("b", 1, 3, 418), ("c", 1, 4, 429), ("c", 2, 5, 429)]
    got = {r["ip"]: (r["total"], r["kinds"], r["dominant"], r["reason"])
           for r in shell_rules.client_error_classes(_req(spark, rows)).collect()}
    assert got == {"a": (2, 2, 410, "複合的な400系エラー攻撃"), "b": (1, 1, 418, "スキャン/攻撃の可能性"),
                   "c": (2, 1, 429, "レート制限回避試行")}
