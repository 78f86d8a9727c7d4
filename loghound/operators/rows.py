"""Row-level detectors of profile core (D9-D19) as Column predicates.

Each detector is a ``(seq, condition, reason)`` triple; ``seq`` is its place
in the per-line evaluation order, which fixes "first recorded" for the
verdict.  All of them are evaluated in the same projection as the signatures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: row detector vocabulary and reasons, profile core ---
SENSITIVE_FILE_MARKS = [".env", ".git/", "config.json", "docker-compose", ".yml", ".yaml",
                        "/.aws/", "/.ssh/", "/backup", ".bak", ".backup"]
WEBDAV_METHODS = ["PROPFIND", "PROPPATCH", "MKCOL", "COPY", "MOVE", "LOCK", "UNLOCK"]
DEPRECATED_TLS_MARKS = ["SSLv3", "SSLv2", "TLSv1 "]
REASON_CONNECT = "不正なCONNECTメソッド使用"
REASON_EMPTY = "空のHTTPリクエスト"
REASON_INCOMPLETE = "不完全なHTTPリクエスト"
REASON_NON_HTTP = "非HTTPプロトコル使用"
REASON_SENSITIVE = "機密ファイル探索"
REASON_PHPUNIT = "PHPUnit RCE攻撃"
REASON_WEBDAV = "WebDAV不正アクセス試行"
REASON_JSONRPC = "JSON-RPC攻撃試行"
REASON_OLD_TLS = "非推奨SSL/TLSプロトコル使用"
# error-log phrases (lower case) -> reason, in the order the reference tests them;
# "auth" marks the phrases that feed the per-client failure counter
ERROR_PHRASES_LEGACY = [
    ("modsecurity", "WAF攻撃ブロック - ModSecurity検出", False),
    ("denied", "error_log異常パターン検出", False),
    ("file does not exist", "存在しないファイルへのアクセス - 偵察の可能性", False),
    ("permission denied", "権限拒否 - 権限昇格攻撃の可能性", False),
    ("script not found", "不正なスクリプト実行試行", False),
    ("invalid uri", "不正なURI - 攻撃の可能性", False),
    ("request failed", "リクエスト失敗 - HTTP攻撃の可能性", False),
    ("ssl handshake failed", "SSL/TLS攻撃の可能性", False),
    ("client denied by server configuration", "アクセス制御違反", False),
    ("access forbidden", "error_log異常パターン検出", False),
    ("authentication failure", "認証失敗 - ブルートフォースの可能性", False),
    ("user not found", "認証失敗 - 無効ユーザー試行", True),
    ("user .* not found", "認証失敗 - 無効ユーザー試行", True),
    ("invalid user", "認証失敗 - 無効ユーザー", False),
    ("login failed", "認証失敗 - ログイン失敗", False),
    ("invalid request", "error_log異常パターン検出", False),
]
BRUTE_FORCE_REASON = "認証失敗 - ブルートフォースの可能性"
DISTRIBUTED_REASON = "分散型ブルートフォース攻撃の可能性"
# --- end of fixed values ---

# Build decision: the generic "denied" goes after the two specific denied
# phrases, so "permission denied" and "client denied ..." get their reasons.
_SPECIFIC_FIRST = ["modsecurity", "file does not exist", "permission denied", "script not found",
                   "invalid uri", "request failed", "ssl handshake failed",
                   "client denied by server configuration", "denied", "access forbidden",
                   "authentication failure", "user not found", "user .* not found", "invalid user",
                   "login failed", "invalid request"]
ERROR_PHRASES = sorted(ERROR_PHRASES_LEGACY, key=lambda p: _SPECIFIC_FIRST.index(p[0]))


def _any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def error_phrase_index(message: Column, legacy_order: bool = False) -> Column:
    """Index (into the phrase list in use) of the first matching phrase."""
    phrases = ERROR_PHRASES_LEGACY if legacy_order else ERROR_PHRASES
    low = F.lower(message)
    terms = []
    for i, (p, _r, _a) in enumerate(phrases):
        cond = (low.contains("user") & low.contains("not found")) if p == "user .* not found" else low.contains(p)
        terms.append(F.when(cond, F.lit(i)))
    return F.coalesce(*terms)


def row_detectors(legacy_order: bool = False):
    """``[(seq, condition, reason, accumulating)]`` for D9-D17 and the
    non-counting part of D18 (evaluated on parsed request columns)."""
    m = F.col("method")
    url = F.coalesce(F.col("url"), F.lit(""))
    st = F.coalesce(F.col("status"), F.lit(0))
    line = F.col("value")
    return [
        (6, m == "CONNECT", REASON_CONNECT, False),
        (7, m.isin("EMPTY", "SSL_EMPTY"), REASON_EMPTY, False),
        (8, m.isin("INCOMPLETE", "SSL_INCOMPLETE"), REASON_INCOMPLETE, False),
        (9, m.startswith("NON_HTTP:"), REASON_NON_HTTP, False),
        (10, _any(url, SENSITIVE_FILE_MARKS), REASON_SENSITIVE, True),
        (11, url.contains("phpunit") & url.contains("eval-stdin.php"), REASON_PHPUNIT, True),
        (12, m.isin(*WEBDAV_METHODS) & (st >= 400), REASON_WEBDAV, False),
        (13, m.startswith("JSON") & (st >= 400), REASON_JSONRPC, False),
        (14, _any(line, DEPRECATED_TLS_MARKS), REASON_OLD_TLS, False),
    ]
