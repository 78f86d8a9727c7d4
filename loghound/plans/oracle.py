"""DuckDB reference SQL for the registered queries.

The oracle does not parse log text: it derives the *expected* request
records straight from ``events`` (the same mapping the Spark source renders
into lines) and evaluates the rules with plain SQL (windows, ordered
aggregates, CASE chains generated from the same signature tables).  A match
therefore checks the Spark parser and the Spark operators together.
"""

from __future__ import annotations

from ..operators import windows as win
from ..operators.patterns import (COMPLEX_SHELL_REASON, SHELL_SIGNATURES, SQL_SIGNATURES, TRAVERSAL_REASON,
                                  TRAVERSAL_SIGNATURES, shell_reason, sql_reason)
from ..operators.rows import (BRUTE_FORCE_REASON, DEPRECATED_TLS_MARKS, DISTRIBUTED_REASON, ERROR_PHRASES,
                              SENSITIVE_FILE_MARKS, WEBDAV_METHODS, row_detectors)
from ..operators.signatures import GUARD_WORDS, PAGE_SQL_WORDS, PAGE_SUFFIXES
from ..functions.priority import CORE_PRIORITY_RULES
from ..sources import synthetic as syn


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def _pick(values, expr: str) -> str:
    return f"{_list(values)}[({expr}) % {len(values)} + 1]"


def base_ctes() -> str:
    """``wl`` (structured records) and ``req`` (expected parse result)."""
    return f"""
wl AS (
  SELECT event_id AS ord,
         CAST({syn.BASE_TS} + event_id // 10 AS BIGINT) AS ts_s,
         '203.0.113.' || CAST(CASE WHEN user_id % 3 = 0 THEN user_id % 6 ELSE user_id % 40 END AS VARCHAR) AS ip,
         CASE WHEN event_type = 'error' THEN 'error_log'
              WHEN event_id % 5 = 0 THEN 'ssl_request_log'
              WHEN event_id % 7 = 0 THEN 'timestamp_first_access_log'
              ELSE 'access_log' END AS kind,
         {_pick(syn.STATUSES, 'event_id')} AS status0,
         {_pick(syn.METHODS, 'event_id')} AS method0,
         {_pick(syn.URLS, 'event_id')} AS url0,
         {_pick(syn.ERROR_MESSAGES, 'event_id')} AS message0,
         CASE WHEN event_id % 11 = 0 THEN 'admin' END AS username0,
         {_pick(syn.TLS_PROTOCOLS, 'event_id')} AS proto0,
         {_pick(syn.TLS_CIPHERS, 'event_id')} AS cipher0,
         {_pick(syn.JSON_METHODS, 'event_id')} AS json0,
         CAST(floor(value * 100) AS BIGINT) AS size0
  FROM events
),
req AS (
  SELECT ord, ts_s, ip, kind AS log_type,
    CASE WHEN kind = 'error_log' THEN 'ERROR_LOG'
         WHEN kind = 'ssl_request_log' THEN
           CASE method0 WHEN 'EMPTY' THEN 'SSL_EMPTY' WHEN 'INCOMPLETE' THEN 'SSL_INCOMPLETE'
                        WHEN 'POST' THEN 'JSON:' || json0 ELSE method0 END
         ELSE method0 END AS method,
    CASE WHEN kind = 'error_log' THEN message0
         WHEN method0 = 'EMPTY' THEN ''
         WHEN method0 = 'INCOMPLETE' THEN '-'
         WHEN kind = 'ssl_request_log' AND method0 = 'POST'
           THEN '{{"id":' || CAST(event_id_mod3 AS VARCHAR) || ',"method":"' || json0 || '"}}'
         ELSE url0 END AS url,
    CASE WHEN kind = 'error_log' THEN 500 ELSE status0 END AS status,
    CASE WHEN kind IN ('access_log', 'timestamp_first_access_log') THEN size0 END AS size,
    CASE WHEN kind = 'access_log' THEN username0 END AS username,
    CASE WHEN kind = 'ssl_request_log' THEN proto0 END AS tls_protocol,
    CASE WHEN kind = 'error_log' THEN 'error' END AS level,
    CASE WHEN kind = 'error_log' THEN NULL
         WHEN method0 = 'EMPTY' THEN '' WHEN method0 = 'INCOMPLETE' THEN '-'
         WHEN kind = 'ssl_request_log' AND method0 = 'POST'
           THEN '{{\\"id\\":' || CAST(event_id_mod3 AS VARCHAR) || ',\\"method\\":\\"' || json0 || '\\"}}'
         ELSE method0 || ' ' || url0 || ' HTTP/1.1' END AS request
  FROM (SELECT *, ord % 3 AS event_id_mod3 FROM wl)
)"""


def _contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def _cnf(text: str, clauses, unless=()) -> str:
    parts = ["(" + " OR ".join(f"contains({text}, {q(t)})" for t in alts) + ")" for alts in clauses]
    parts += [f"NOT contains({text}, {q(u)})" for u in unless]
    return "(" + " AND ".join(parts) + ")"


def signature_cte() -> str:
    """``sig``: per request the first SQL hit, shell hit count / high-risk
    count / first shell hit, first traversal hit (profile core)."""
    lv = []
    for lvl in (0, 1):
        raw = f"l{lvl}"
        low = f"lo{lvl}"
        guard = f"(log_type = 'error_log' AND {_contains_any(raw, GUARD_WORDS)})"
        ok_sql = f"(NOT {guard})"
        ok_sh = f"(NOT {guard})"
        page_only = f"({_contains_any(raw, PAGE_SUFFIXES)} AND NOT {_contains_any(raw, PAGE_SQL_WORDS)})"
        sql_cases = []
        for i, s in enumerate(SQL_SIGNATURES):
            pred = _cnf(low, s[2], s[3])
            if s[0] == "SQL-004":
                pred = f"({pred} AND NOT {page_only})"
            sql_cases.append(f"WHEN {pred} THEN {i}")
        sh_terms = [f"CAST({_cnf(low, s[2])} AS INTEGER)" for s in SHELL_SIGNATURES]
        sh_high = [f"CAST({_cnf(low, s[2])} AS INTEGER)" for s in SHELL_SIGNATURES if s[4]]
        sh_first = [f"WHEN {_cnf(low, s[2])} THEN {lvl * 1000 + i}" for i, s in enumerate(SHELL_SIGNATURES)]
        trv_cases = [f"WHEN contains({low}, {q(s[2])}) THEN {i}" for i, s in enumerate(TRAVERSAL_SIGNATURES)]
        lv.append(dict(
            sql=f"CASE WHEN {ok_sql} THEN (CASE {' '.join(sql_cases)} END) END",
            n_sh=f"CASE WHEN {ok_sh} THEN ({' + '.join(sh_terms)}) ELSE 0 END",
            hi_sh=f"CASE WHEN {ok_sh} THEN ({' + '.join(sh_high)}) ELSE 0 END",
            first_sh=f"CASE WHEN {ok_sh} THEN (CASE {' '.join(sh_first)} END) END",
            trv=f"CASE {' '.join(trv_cases)} END",
        ))
    return f"""
lev AS (
  SELECT *, l0 AS _x, lower(l0) AS lo0, lower(l1) AS lo1 FROM (
    SELECT *, coalesce(url, '') AS l0, url_decode(coalesce(url, '')) AS l1 FROM req)
),
sig AS (
  SELECT *,
    coalesce({lv[0]['sql']}, {lv[1]['sql']}) AS sql_hit,
    ({lv[0]['n_sh']}) + ({lv[1]['n_sh']}) AS n_shell,
    ({lv[0]['hi_sh']}) + ({lv[1]['hi_sh']}) AS shell_high,
    coalesce({lv[0]['first_sh']}, {lv[1]['first_sh']}) AS first_shell,
    coalesce({lv[0]['trv']}, {lv[1]['trv']}) AS trv_hit
  FROM lev
)"""


def _reason_of(idx: str, reasons) -> str:
    return f"{_list(reasons)}[{idx} + 1]"


def detections_cte() -> str:
    """``det``: the detections of profile core that shape a verdict
    (the first shell hit of a line stands for all its individual hits)."""
    sqlr = [sql_reason(s[4]) for s in SQL_SIGNATURES]
    sqlc = [s[0] for s in SQL_SIGNATURES]
    shr = [shell_reason(s[3]) for s in SHELL_SIGNATURES]
    trv_suffix = [s[3] for s in TRAVERSAL_SIGNATURES]
    rows_sql = []
    conds = {
        6: "method = 'CONNECT'",
        7: "method IN ('EMPTY', 'SSL_EMPTY')",
        8: "method IN ('INCOMPLETE', 'SSL_INCOMPLETE')",
        9: "starts_with(method, 'NON_HTTP:')",
        10: _contains_any("coalesce(url, '')", SENSITIVE_FILE_MARKS),
        11: "(contains(coalesce(url, ''), 'phpunit') AND contains(coalesce(url, ''), 'eval-stdin.php'))",
        12: f"(method IN ({', '.join(q(m) for m in WEBDAV_METHODS)}) AND coalesce(status, 0) >= 400)",
        13: "(starts_with(method, 'JSON') AND coalesce(status, 0) >= 400)",
        14: "(log_type = 'ssl_request_log' AND (tls_protocol IN ('SSLv3', 'SSLv2', 'TLSv1')))",
    }
    assert len(DEPRECATED_TLS_MARKS) == 3
    for seq, _c, reason, acc in row_detectors():
        rows_sql.append(f"SELECT ip, ts_s, ord, {seq} AS seq, 0 AS sub, {q(reason)} AS reason, 1 AS count, "
                        f"{str(acc).upper()} AS acc FROM sig WHERE {conds[seq]}")
    ph_cases = []
    for i, (p, _r, _a) in enumerate(ERROR_PHRASES):
        cond = ("(contains(lower(url), 'user') AND contains(lower(url), 'not found'))" if p == "user .* not found"
                else f"contains(lower(url), {q(p)})")
        ph_cases.append(f"WHEN {cond} THEN {i}")
    ph_reasons = [p[1] for p in ERROR_PHRASES]
    ph_auth = [str(p[2]).lower() for p in ERROR_PHRASES]
    return f"""
sqlhit AS (
  SELECT ip, ts_s, ord, 3 AS seq, 0 AS sub, {_reason_of('sql_hit', sqlr)} AS reason,
         {_reason_of('sql_hit', sqlc)} AS reason_code, 1 AS count, FALSE AS acc
  FROM sig WHERE sql_hit IS NOT NULL
),
shellhit AS (
  SELECT ip, ts_s, ord, 4 AS seq, first_shell AS sub, {_reason_of('first_shell % 1000', shr)} AS reason,
         1 AS count, FALSE AS acc, n_shell, shell_high
  FROM sig WHERE n_shell > 0
),
complexhit AS (
  SELECT ip, ts_s, ord, 4 AS seq, 9999 AS sub,
         {q(COMPLEX_SHELL_REASON)} || ' (' || CAST(n_shell AS VARCHAR) || 'パターン検出)' AS reason,
         n_shell AS count, FALSE AS acc
  FROM sig WHERE n_shell >= 3 OR shell_high >= 2
),
trvhit AS (
  SELECT ip, ts_s, ord, 5 AS seq, 0 AS sub, n,
         {q(TRAVERSAL_REASON)} || ' (' ||
         CASE WHEN suffix <> '' THEN suffix || CASE WHEN n >= {win.TRAVERSAL_THRESHOLD} THEN '・高リスク' ELSE '' END || '・'
              ELSE CASE WHEN n >= {win.TRAVERSAL_THRESHOLD} THEN '高リスク・' ELSE '' END END
         || CAST(n AS VARCHAR) || '回)' AS reason, 1 AS count, FALSE AS acc
  FROM (SELECT *, {_list(trv_suffix)}[trv_hit + 1] AS suffix,
               row_number() OVER (PARTITION BY ip ORDER BY ts_s, ord) AS n
        FROM sig WHERE trv_hit IS NOT NULL)
),
rowhit AS ({' UNION ALL '.join(rows_sql)}),
errph AS (
  SELECT *, {_list(ph_reasons)}[ph + 1] AS ph_reason, {'[' + ', '.join(ph_auth) + ']'}[ph + 1] AS ph_auth
  FROM (SELECT ip, ts_s, ord, CASE {' '.join(ph_cases)} END AS ph FROM sig WHERE method = 'ERROR_LOG')
  WHERE ph IS NOT NULL
),
errplain AS (
  SELECT ip, ts_s, ord, 15 AS seq, 0 AS sub, ph_reason AS reason, 1 AS count, FALSE AS acc
  FROM errph WHERE NOT ph_auth
),
authrank AS (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_s, ord) AS n FROM errph WHERE ph_auth
),
authhit AS (
  SELECT ip, ts_s, ord, 15 AS seq, 0 AS sub,
         CASE WHEN n >= {win.AUTH_FAILURE_THRESHOLD}
              THEN {q(BRUTE_FORCE_REASON)} || ' (' || CAST(n AS VARCHAR) || '回試行)' ELSE ph_reason END AS reason,
         n AS count, FALSE AS acc
  FROM authrank
),
authwin AS (
  SELECT a.ord, count(*) AS w_failures, count(DISTINCT b.ip) AS w_ips
  FROM (SELECT ord, ts_s FROM errph WHERE ph_auth) a
  JOIN (SELECT ip, ts_s FROM errph WHERE ph_auth) b ON b.ts_s BETWEEN a.ts_s - {win.DISTRIBUTED_WINDOW_SECONDS} AND a.ts_s
  GROUP BY a.ord
),
disthit AS (
  SELECT a.ip, a.ts_s, a.ord, 15 AS seq, 1 AS sub,
         {q(DISTRIBUTED_REASON)} || ' (' || CAST(w.w_ips AS VARCHAR) || ' IP、' || CAST(w.w_failures AS VARCHAR) || '回試行)' AS reason,
         a.n AS count, FALSE AS acc
  FROM authrank a JOIN authwin w ON w.ord = a.ord
  WHERE a.n < {win.AUTH_FAILURE_THRESHOLD} AND w.w_failures >= {win.DISTRIBUTED_MIN_FAILURES}
    AND w.w_ips >= {win.DISTRIBUTED_MIN_IPS}
),
hf AS (
  SELECT ip, ts_s, ord, 1 AS seq, 0 AS sub,
         {q(win.HIGH_FREQ_REASON)} || ' (' || CAST(cnt AS VARCHAR) || '回/5分)' AS reason, cnt AS count, FALSE AS acc
  FROM (SELECT ip, ts_s, ord,
          coalesce(count(*) OVER (PARTITION BY ip ORDER BY ts_s RANGE BETWEEN {win.SLIDING_WINDOW_SECONDS} PRECEDING AND 1 PRECEDING), 0)
          + row_number() OVER (PARTITION BY ip, ts_s ORDER BY ord) AS cnt
        FROM req WHERE ts_s IS NOT NULL)
  WHERE cnt >= {win.HIGH_FREQ_THRESHOLD}
),
{client_errors_ctes()},
det AS (
  SELECT ip, ts_s, ord, seq, sub, reason, count, acc FROM sqlhit
  UNION ALL SELECT ip, ts_s, ord, seq, sub, reason, count, acc FROM shellhit
  UNION ALL SELECT ip, ts_s, ord, seq, sub, reason, count, acc FROM complexhit
  UNION ALL SELECT ip, ts_s, ord, seq, sub, reason, count, acc FROM trvhit
  UNION ALL SELECT ip, ts_s, ord, seq, sub, reason, count, acc FROM rowhit
  UNION ALL SELECT ip, ts_s, ord, seq, sub, reason, count, acc FROM errplain
  UNION ALL SELECT ip, ts_s, ord, seq, sub, reason, count, acc FROM authhit
  UNION ALL SELECT ip, ts_s, ord, seq, sub, reason, count, acc FROM disthit
  UNION ALL SELECT ip, ts_s, ord, seq, sub, reason, count, acc FROM hf
  UNION ALL SELECT ip, ts_s, ord, 2 AS seq, 0 AS sub, reason, count, FALSE AS acc FROM e4hit
)"""


def client_errors_ctes() -> str:
    w = win.SLIDING_WINDOW_SECONDS
    status_reason = "'大量の' || CAST(status AS VARCHAR) || 'エラー - スキャン/攻撃の可能性 (' || CAST(n_status AS VARCHAR) || '回/5分)'"
    thr = str(win.OTHER_4XX_THRESHOLD)
    for code, t, text in reversed(win.STATUS_RULES_CORE):
        status_reason = (f"CASE WHEN status = {code} THEN {q(text)} || ' (' || CAST(n_status AS VARCHAR) || '回/5分)' "
                         f"ELSE {status_reason} END")
        thr = f"CASE WHEN status = {code} THEN {t} ELSE {thr} END"
    return f"""
e4 AS (SELECT ip, status, ts_s, ord FROM req WHERE status BETWEEN 400 AND 499 AND ts_s IS NOT NULL),
e4c AS (
  SELECT *,
    coalesce(count(*) OVER (PARTITION BY ip, status ORDER BY ts_s RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING), 0)
      + row_number() OVER (PARTITION BY ip, status, ts_s ORDER BY ord) AS n_status,
    coalesce(count(*) OVER (PARTITION BY ip ORDER BY ts_s RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING), 0)
      + row_number() OVER (PARTITION BY ip, ts_s ORDER BY ord) AS n_total
  FROM e4
),
e4first AS (SELECT ip, status, min(ts_s * 100000000 + ord) AS fk FROM e4 GROUP BY ip, status),
e4t AS (
  SELECT c.*, (SELECT count(*) FROM e4first f WHERE f.ip = c.ip AND f.fk <= c.ts_s * 100000000 + c.ord) AS types
  FROM e4c c
),
e4hit AS (
  SELECT ip, ts_s, ord, status, greatest(n_status, 1) AS count,
    CASE WHEN n_total >= {win.MIXED_4XX_MIN_TOTAL} AND types >= {win.MIXED_4XX_MIN_TYPES}
           THEN {q(win.MIXED_4XX_REASON)} || ' (' || CAST(types AS VARCHAR) || '種類・' || CAST(n_total AS VARCHAR) || '回/5分)'
         WHEN n_status >= ({thr}) THEN {status_reason}
         WHEN n_total >= {win.BULK_4XX_MIN_TOTAL}
           THEN {q(win.BULK_4XX_REASON)} || ' (' || CAST(n_total AS VARCHAR) || '回/5分)'
    END AS reason
  FROM e4t
  WHERE (n_total >= {win.MIXED_4XX_MIN_TOTAL} AND types >= {win.MIXED_4XX_MIN_TYPES})
     OR n_status >= ({thr}) OR n_total >= {win.BULK_4XX_MIN_TOTAL}
)"""


def priority_sql(col: str) -> str:
    out = "1"
    for prio, clauses in reversed(CORE_PRIORITY_RULES):
        cond = " AND ".join("(" + " OR ".join(f"contains({col}, {q(k)})" for k in alts) + ")" for alts in clauses)
        out = f"CASE WHEN {cond} THEN {prio} ELSE {out} END"
    return out


def verdicts_cte() -> str:
    sev = " OR ".join(f"contains(reason, {q(m)})" for m in ["高リスク", "SQLインジェクション", "複合シェルインジェクション攻撃"])
    never = " OR ".join(f"contains(reason, {q(m)})" for m in ["認証失敗", "ブルートフォース"])
    return f"""
vmain AS (
  SELECT ip, CAST(max(count) AS BIGINT) AS count,
         coalesce(last(reason ORDER BY ts_s, ord, seq, sub) FILTER (WHERE ({sev}) AND NOT ({never})),
                  first(reason ORDER BY ts_s, ord, seq, sub)) AS reason,
         min(ts_s) AS first_s, max(ts_s) AS last_s
  FROM det WHERE NOT acc GROUP BY ip
),
vacc AS (
  SELECT ip, CAST(sum(count) AS BIGINT) AS count, reason, min(ts_s) AS first_s, max(ts_s) AS last_s
  FROM det WHERE acc GROUP BY ip, reason
),
verdict AS (
  SELECT ip, count, reason, {priority_sql('reason')} AS priority, first_s, last_s
  FROM (SELECT * FROM vmain UNION ALL SELECT * FROM vacc)
)"""


def with_all(select: str, parts=("base", "sig", "det", "verdict")) -> str:
    ctes = [base_ctes()]
    if "sig" in parts:
        ctes.append(signature_cte())
    if "det" in parts:
        ctes.append(detections_cte())
    if "verdict" in parts:
        ctes.append(verdicts_cte())
    return "WITH " + ",".join(ctes) + "\n" + select
