"""Threat priority of a reason text.

The keyword rules are data: a list of ``(priority, clauses)`` where a reason
matches when every clause has one contained keyword; the first matching rule
wins and unmatched reasons get 1.  The same list is compiled into one
``CASE WHEN`` column (JVM-side, inside codegen) and into a small dimension
table for joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: keyword priority rules, profile core, in evaluation order ---
CORE_PRIORITY_RULES = [
    (10, [["PHPUnit RCE攻撃"]]),
    (10, [["SQLインジェクション"]]),
    (10, [["シェルインジェクション攻撃"]]),
    (10, [["複合シェルインジェクション攻撃"]]),
    (9, [["分散型ブルートフォース攻撃"]]),
    (9, [["WAF攻撃ブロック"]]),
    (8, [["認証失敗"], ["ブルートフォース"]]),
    (8, [["複合的な400系エラー"]]),
    (7, [["高頻度アクセス"]]),
    (7, [["大量の400系エラー"]]),
    (6, [["不正リクエスト攻撃"]]),
    (6, [["アクセス制御回避"]]),
    (6, [["リソース探索", "偵察"]]),
    (8, [["機密ファイル探索", "情報収集攻撃"]]),
    (7, [["WebDAV不正アクセス"]]),
    (6, [["404エラー"]]),
    (5, [["権限拒否", "権限昇格"]]),
    (5, [["ディレクトリトラバーサル"]]),
    (4, [["HTTPメソッド攻撃"]]),
    (4, [["ペイロード攻撃"]]),
    (4, [["URI長攻撃"]]),
    (3, [["レート制限回避"]]),
    (3, [["SSL/TLS攻撃"]]),
]

# --- fixed values: keyword priority rules of the report label, profile fast/detailed ---
SHELL_LABEL_RULES = [
    (10, [["SQLインジェクション"]]),
    (9, [["WAF攻撃ブロック"]]),
    (8, [["認証失敗"], ["ブルートフォース"]]),
    (8, [["複合的な400系エラー"]]),
    (7, [["高頻度アクセス"]]),
    (7, [["大量の400系エラー"]]),
    (6, [["不正リクエスト攻撃"]]),
    (6, [["アクセス制御回避"]]),
    (6, [["リソース探索", "偵察"]]),
    (6, [["404エラー"]]),
    (5, [["権限拒否", "権限昇格"]]),
    (5, [["ディレクトリトラバーサル"]]),
    (4, [["HTTPメソッド攻撃"]]),
    (4, [["ペイロード攻撃"]]),
    (4, [["URI長攻撃"]]),
    (3, [["レート制限回避"]]),
    (3, [["SSL/TLS攻撃"]]),
]

# --- fixed values: exact reason -> priority table, profile fast/detailed (default 1) ---
SHELL_PRIORITY_TABLE = [
    ("SQLインジェクション攻撃の可能性", 10),
    ("WAF攻撃ブロック - ModSecurity", 9),
    ("繰り返される認証失敗 - ブルートフォースの可能性", 8),
    ("認証失敗 - ブルートフォースの可能性", 8),
    ("複合的な400系エラー攻撃", 8),
    ("高頻度アクセス", 7),
    ("大量の400系エラー - スキャン/攻撃の可能性", 7),
    ("大量の400系エラー - 複合的な400系エラー攻撃", 7),
    ("大量の400系エラー - 不正リクエスト攻撃", 6),
    ("大量の400系エラー - アクセス制御回避試行", 6),
    ("大量の400系エラー - リソース探索/偵察活動", 6),
    ("複数の404エラー - 偵察の可能性", 6),
    ("存在しないファイルへのアクセス - 偵察の可能性", 6),
    ("リソース探索/偵察活動", 6),
    ("不正リクエスト攻撃", 5),
    ("アクセス制御回避試行", 5),
    ("権限拒否 - 権限昇格攻撃の可能性", 5),
    ("不正なスクリプト実行試行", 5),
    ("HTTPメソッド攻撃", 4),
    ("ペイロード攻撃", 4),
    ("URI長攻撃", 4),
    ("不正なURI - 攻撃の可能性", 4),
    ("リクエスト失敗 - HTTP攻撃の可能性", 4),
    ("レート制限回避試行", 3),
    ("タイムアウト攻撃", 3),
    ("競合状態攻撃", 3),
    ("コンテンツネゴシエーション攻撃", 3),
    ("メディアタイプ攻撃", 3),
    ("削除済みリソース探索", 3),
    ("SSL/TLS攻撃の可能性", 3),
    ("アクセス制御違反", 3),
    ("error_log異常パターン検出", 2),
]

# --- fixed values: priority labels ---
LABEL_HIGH, LABEL_MEDIUM, LABEL_LOW = "[高]", "[中]", "[低]"


def _rule_matches(reason: Column, clauses) -> Column:
    cond = None
    for alts in clauses:
        any_of = None
        for kw in alts:
            t = reason.contains(kw)
            any_of = t if any_of is None else (any_of | t)
        cond = any_of if cond is None else (cond & any_of)
    return cond


def priority_of(reason: Column, rules=CORE_PRIORITY_RULES) -> Column:
    """F8: first matching keyword rule, default 1."""
    out = F.lit(1)
    for prio, clauses in reversed(rules):
        out = F.when(_rule_matches(reason, clauses), F.lit(prio)).otherwise(out)
    return out


def priority_label(priority: Column) -> Column:
    """``[高]`` from 8, ``[中]`` from 5, else ``[低]``."""
    return (F.when(priority >= 8, F.lit(LABEL_HIGH))
            .when(priority >= 5, F.lit(LABEL_MEDIUM))
            .otherwise(F.lit(LABEL_LOW)))


def shell_priority_table(spark: SparkSession) -> DataFrame:
    """J3 dimension: exact reason -> priority (32 rows, fixed size)."""
    return spark.createDataFrame(SHELL_PRIORITY_TABLE, "reason_key string, priority int")
