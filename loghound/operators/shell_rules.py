"""Rules of profiles fast/detailed: error-log groups (D19) with the
access-control counter (W11), whose reasons carry their level tag
(`` [CRITICAL]`` ...), and the 4xx rules (W6) with their classes (W7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import windows as win

# --- fixed values: error-log rule groups, profiles fast/detailed, in test order ---
# (level, reason, regexes on the lower-cased message)
SHELL_ERROR_RULES = [
    ("CRITICAL", "バッファオーバーフロー攻撃の可能性", ["buffer overflow", "stack overflow", "heap corruption"]),
    ("CRITICAL", "メモリ攻撃 - システム不安定化の可能性", ["memory allocation failed", "segmentation fault", "core dumped"]),
    ("CRITICAL", "メモリ破壊攻撃の可能性", ["double free", "use after free", "null pointer dereference"]),
    ("CRITICAL", "コード実行攻撃の可能性", ["format string vulnerability", "integer overflow"]),
    ("HIGH", "WAF攻撃ブロック - ModSecurity検出", ["modsecurity.*denied", "modsecurity.*blocked"]),
    ("HIGH", "権限拒否 - 権限昇格攻撃の可能性", ["permission denied"]),
    ("HIGH", "不正なスクリプト実行試行", ["script not found"]),
    ("HIGH", "SSL/TLS攻撃の可能性", ["ssl handshake failed", "certificate verification failed", "cipher negotiation failed"]),
    ("HIGH", "認証失敗 - ブルートフォースの可能性", ["authentication failure"]),
    ("HIGH", "不正なリクエスト - プロトコル攻撃の可能性", ["invalid request", "malformed request", "protocol error"]),
    ("HIGH", "競合状態攻撃の可能性", ["race condition"]),
    ("MEDIUM", "アクセス制御違反", ["client denied by server configuration"]),
    ("MEDIUM", "アクセス制御違反", ["client denied", "ah01630.*client denied"]),
    ("MEDIUM", "存在しないファイルへのアクセス - 偵察の可能性", ["file does not exist"]),
    ("MEDIUM", "不正なURI - 攻撃の可能性", ["invalid uri"]),
    ("MEDIUM", "リクエスト失敗 - HTTP攻撃の可能性", ["request failed.*error reading the headers"]),
    ("MEDIUM", "アクセス制御違反", ["access forbidden by rule"]),
    ("MEDIUM", "接続異常 - DoS攻撃の可能性", ["connection reset", "timeout"]),
    ("MEDIUM", "大容量リクエスト攻撃の可能性", ["request entity too large", "uri too long"]),
    ("MEDIUM", "レート制限違反 - DoS攻撃の可能性", ["too many requests"]),
    ("MEDIUM", "不正なHTTPメソッド/メディアタイプ攻撃", ["method not allowed", "unsupported media type"]),
    ("MEDIUM", "error_log異常パターン検出", ["directory index forbidden", "options execcgi is off",
                                          "premature end of script headers", "malformed header from script"]),
]
LOW_REASON = ("LOW", "error_log異常パターン検出")
ACCESS_CONTROL_GROUP = 11
ACCESS_CONTROL_MIN = 10
# status -> attack type of a 4xx status
STATUS_ATTACKS = {
    400: "不正リクエスト攻撃",
    401: "認証失敗 - ブルートフォースの可能性",
    403: "アクセス制御回避試行",
    404: "リソース探索/偵察活動",
    405: "HTTPメソッド攻撃",
    406: "コンテンツネゴシエーション攻撃",
    408: "不完全なHTTPリクエスト",
    409: "競合状態攻撃",
    410: "削除済みリソース探索",
    413: "ペイロード攻撃",
    414: "URI長攻撃",
    415: "メディアタイプ攻撃",
    429: "レート制限回避試行",
}
# status -> errors of one client in the window; INSTANT_STATUS fires at once
STATUS_MINIMUM = {404: 10, 401: 3, 403: 3, 400: 3}
INSTANT_STATUS = 408
SHELL_BULK_MIN = 5
COMPOSITE_4XX = "複合的な400系エラー攻撃"
BULK_4XX_PREFIX = "大量の400系エラー - "
UNCLASSED_4XX = "スキャン/攻撃の可能性"
# --- end of fixed values ---


def rule_regex(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def rule_index(message: Column) -> Column:
    low = F.lower(message)
    terms = [F.when(low.rlike(rule_regex(pats)), F.lit(i)) for i, (_l, _r, pats) in enumerate(SHELL_ERROR_RULES)]
    return F.coalesce(*terms, F.lit(len(SHELL_ERROR_RULES)))


def error_rules(requests: DataFrame) -> DataFrame:
    """The error-log lines with the place of their rule: ip, ts_s, ord, rule."""
    return requests.filter(F.col("log_type").isin("error_log", "nginx_error_log")).select(
        "ip", "ts_s", "ord", rule_index(F.coalesce(F.col("message"), F.lit(""))).alias("rule"))


def shell_error_detections(requests: DataFrame) -> DataFrame:
    """D19 + W11: one detection per error-log line (access-control violations
    only from the 10th per client on, with the running count)."""
    return error_detections(error_rules(requests))


def error_detections(err: DataFrame) -> DataFrame:
    """D19 + W11 from the lines of :func:`error_rules`."""
    levels = F.array(*[F.lit(r[0]) for r in SHELL_ERROR_RULES], F.lit(LOW_REASON[0]))
    reasons = F.array(*[F.lit(r[1]) for r in SHELL_ERROR_RULES], F.lit(LOW_REASON[1]))
    idx = F.col("rule") + 1
    plain = err.filter(F.col("rule") != ACCESS_CONTROL_GROUP).select(
        "ip", "ts_s", "ord", F.try_element_at(levels, idx).alias("threat_level"),
        F.concat(F.try_element_at(reasons, idx), F.lit(" ["), F.try_element_at(levels, idx), F.lit("]")).alias("reason"),
        F.lit(1).cast("bigint").alias("count"))
    acl = win.running_rank(err.filter(F.col("rule") == ACCESS_CONTROL_GROUP), ["ip"], "n").filter(
        F.col("n") >= ACCESS_CONTROL_MIN).select(
        "ip", "ts_s", "ord", F.lit("MEDIUM").alias("threat_level"),
        F.format_string(SHELL_ERROR_RULES[ACCESS_CONTROL_GROUP][1] + " (%d回) [MEDIUM]", F.col("n")).alias("reason"),
        F.col("n").cast("bigint").alias("count"))
    return plain.unionByName(acl)


def _per_status(status: Column, values: dict, default) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status.cast("int")), F.lit(default))


def shell_client_errors(requests: DataFrame, width: int = win.SLIDING_WINDOW_SECONDS) -> DataFrame:
    """The first rule that a 4xx line meets.

    1. an incomplete request (408) at once, with the client's running 408 count;
    2. the status' own minimum within ``width`` seconds;
    3. a second kind of 4xx error of the client so far, with its running total;
    4. SHELL_BULK_MIN errors of any kind within ``width`` seconds, named by
       the class of the client (W7; one kind only, or rule 3 had fired).

    Lines without time count in the running numbers and meet rule 1 only.
    """
    e4 = requests.filter(F.col("status").between(400, 499)).select("ip", "status", "ts_s", "ord")
    firsts = e4.groupBy("ip", "status").agg(F.min(win.order_key()).alias("first"))
    # at most 100 statuses a client; the first error of its second kind
    second = firsts.groupBy("ip").agg(F.sort_array(F.collect_list("first")).alias("f")).select(
        "ip", F.get("f", F.lit(1)).alias("second"))
    ranked = win.running_rank(win.running_rank(e4, ["ip", "status"], "c_status"), ["ip"], "c_total")
    by_status = win.sliding_counts(e4, ["ip", "status"], width).select(
        "ip", "status", F.col("sec").alias("ts_s"), F.col("prev").alias("_p1"))
    total = win.sliding_counts(e4, ["ip"], width).select("ip", F.col("sec").alias("ts_s"), F.col("prev").alias("_p2"))
    lines = (ranked.join(by_status, ["ip", "status", "ts_s"], "left").join(total, ["ip", "ts_s"], "left")
             .join(second, "ip")
             .withColumn("w_status", F.col("_p1") + F.row_number().over(
                 W.partitionBy("ip", "status", "ts_s").orderBy("ord")))
             .withColumn("w_total", F.col("_p2") + F.row_number().over(W.partitionBy("ip", "ts_s").orderBy("ord"))))
    st = F.col("status")
    attack = _per_status(st, STATUS_ATTACKS, UNCLASSED_4XX)
    rules = [
        (st == INSTANT_STATUS, F.lit(STATUS_ATTACKS[INSTANT_STATUS]), F.col("c_status")),
        (F.col("w_status") >= _per_status(st, STATUS_MINIMUM, None), attack, F.col("w_status")),
        (F.col("ts_s").isNotNull() & (win.order_key() >= F.col("second")), F.lit(COMPOSITE_4XX), F.col("c_total")),
        (F.col("w_total") >= SHELL_BULK_MIN, F.concat(F.lit(BULK_4XX_PREFIX), attack), F.col("w_total")),
    ]
    found = F.coalesce(*[F.when(test, F.struct(reason.alias("reason"), n.cast("bigint").alias("count")))
                         for test, reason, n in rules])
    return (lines.withColumn("_found", found).filter(F.col("_found").isNotNull())
            .select("ip", "ts_s", "ord", "status", "_found.count", "_found.reason"))


def client_error_classes(requests: DataFrame) -> DataFrame:
    """Per client its 4xx errors, their kinds, the most frequent status
    (the earlier one of equals) and the class that follows from them."""
    e4 = requests.filter(F.col("status").between(400, 499)).select("ip", "status", "ts_s", "ord")
    per = e4.groupBy("ip", "status").agg(F.count(F.lit(1)).alias("n"), F.min(win.order_key()).alias("first"))
    out = per.groupBy("ip").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"),
                                F.min_by("status", F.struct(-F.col("n"), F.col("first"))).alias("dominant"))
    return out.withColumn("reason", F.when(F.col("kinds") >= 2, F.lit(COMPOSITE_4XX)).otherwise(
        _per_status(F.col("dominant"), STATUS_ATTACKS, UNCLASSED_4XX)))
