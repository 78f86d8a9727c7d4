"""Registered queries of profiles fast/detailed and their DuckDB SQL, written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.priority import SHELL_PRIORITY_TABLE
from ..operators import shell_merge as merge
from ..operators import windows as win
from ..operators.parse import requests_only
from ..operators.shell_rules import ACCESS_CONTROL_GROUP, ACCESS_CONTROL_MIN, SHELL_ERROR_RULES
from . import oracle as O
from .materialize import materialize


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import parsed
    # several queries read the list: it is written once, like the list of profile core
    return materialize(merge.shell_detections(requests_only(parsed(spark, sf_dir)), keep=materialize), "shell-detections")


def _big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def q_shell_detections(spark, sf_dir):
    return _detections(spark, sf_dir).select("ip", *_big("ts_s", "ord", "seq", "count"), "reason", "threat_level",
                                             "log_source")


def q_detailed_detections(spark, sf_dir):
    from .queries import parsed
    d = merge.profile_detections(requests_only(parsed(spark, sf_dir)), detailed=True)
    return d.select("ip", *_big("ts_s", "ord", "seq", "count"), "reason")


def q_shell_verdicts(spark, sf_dir):
    v = merge.shell_verdicts(_detections(spark, sf_dir))
    return v.select("ip", "reason", "source", *_big("count", "priority", "detections", "first_s", "last_s"), "integrated")


def q_shell_ranking(spark, sf_dir):
    r = merge.shell_ranking(merge.shell_verdicts(_detections(spark, sf_dir)))
    return r.select("ip", *_big("count", "rank_priority"), "label", "count_text", "reason_text")


def q_shell_summary(spark, sf_dir):
    s = merge.shell_summary(_detections(spark, sf_dir))
    return s.select("kind", *_big("ips", "detections", "priority"), "label")


QUERIES = {
    "shell_detections": q_shell_detections,
    "detailed_detections": q_detailed_detections,
    "shell_verdicts": q_shell_verdicts,
    "shell_ranking": q_shell_ranking,
    "shell_summary": q_shell_summary,
}


def _profile_cte(detailed: bool) -> str:
    """prof: hits of the regular expressions with the client's running traversal number."""
    from .queries import _profile_sql
    mark = merge.DETAILED_MARK
    sql_text = O.q(f"{merge.SQL_REASON} ({mark})" if detailed else merge.SQL_REASON)
    head = O.q(merge.TRAVERSAL_REASON + " (" + (mark + "・" if detailed else ""))
    return f"""
hit AS (SELECT h.*, r.ts_s FROM ({_profile_sql(detailed)}) h JOIN req r ON r.ord = h.ord WHERE r.ts_s IS NOT NULL),
trvn AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_s, ord) AS n FROM hit WHERE trv_rx),
prof AS (
  SELECT ip, ts_s, ord, 3 AS seq, {sql_text} AS kind, NULL::BIGINT AS number, {sql_text} AS reason, 1 AS count FROM hit WHERE sql_rx
  UNION ALL
  SELECT ip, ts_s, ord, 4, {O.q(merge.TRAVERSAL_REASON + (f' ({mark})' if detailed else ''))}, n,
         {head} || CASE WHEN n >= {merge.RISK_HIGH_FROM} THEN {O.q(merge.RISK_HIGH)} ELSE {O.q(merge.RISK_MEDIUM)} END
         || '・' || n || '回)', 1 FROM trvn)"""


def _detections_cte() -> str:
    from .queries import _shell_4xx_sql, _shell_error_sql
    acl = SHELL_ERROR_RULES[ACCESS_CONTROL_GROUP][1]
    hf = O.q(win.HIGH_FREQ_REASON)
    w = win.SLIDING_WINDOW_SECONDS
    return f"""{_profile_cte(False)},
often AS (
  SELECT ip, ts_s, ord, n FROM (
    SELECT ip, ts_s, ord,
           count(*) OVER (PARTITION BY ip ORDER BY ts_s RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)
           + row_number() OVER (PARTITION BY ip, ts_s ORDER BY ord) AS n
    FROM req WHERE ts_s IS NOT NULL AND log_type <> 'error_log') WHERE n >= {win.HIGH_FREQ_THRESHOLD}),
acc AS (
  SELECT ip, ts_s, ord, 1 AS seq, {hf} AS kind, NULL::BIGINT AS number, {hf} AS reason, n AS count FROM often
  UNION ALL SELECT ip, ts_s, ord, 2, reason, NULL::BIGINT, reason, count FROM four
  UNION ALL SELECT * FROM prof),
err AS (
  SELECT e.ip, r.ts_s, e.ord, 5 AS seq,
         CASE WHEN e.count >= {ACCESS_CONTROL_MIN} THEN {O.q(acl + ' [MEDIUM]')} ELSE e.reason END AS kind,
         CASE WHEN e.count >= {ACCESS_CONTROL_MIN} THEN e.count END AS number, e.reason, e.count
  FROM ({_shell_error_sql()}) e JOIN req r ON r.ord = e.ord),
sdet AS (
  SELECT *, 'access_log' AS log_source FROM acc UNION ALL SELECT *, 'error_log' FROM err),
sdet2 AS (
  SELECT *, CASE WHEN contains(reason, '[CRITICAL]') THEN 'CRITICAL' WHEN contains(reason, '[HIGH]') THEN 'HIGH'
                 WHEN contains(reason, '[LOW]') THEN 'LOW' ELSE 'MEDIUM' END AS threat_level FROM sdet)""".replace(
        "FROM four", f"FROM ({_shell_4xx_sql().replace('FROM req WHERE', 'FROM req WHERE log_type <> ' + O.q('error_log') + ' AND')})")


def _verdicts_cte() -> str:
    """The merge one detection after the other: each step is a row of a recursive table."""
    acl = SHELL_ERROR_RULES[ACCESS_CONTROL_GROUP][1]
    cases = " ".join(f"WHEN {O.q(t)} THEN {p}" for t, p in SHELL_PRIORITY_TABLE)
    # the shown text of a kind is that of its last detection: the running number only grows
    return f"""
kinds AS (
  SELECT ip, kind, log_source, count(*) AS n, max(count) AS count, min(ts_s) AS first_s, max(ts_s) AS last_s,
         min((coalesce(ts_s, 0), ord, seq)) AS first, max(number) AS number,
         arg_max(reason, coalesce(number, 0)) AS last_text
  FROM sdet2 GROUP BY ip, kind, log_source),
named AS (
  SELECT *, CASE WHEN number IS NULL THEN kind WHEN kind = {O.q(acl + ' [MEDIUM]')}
                 THEN {O.q(acl + ' (')} || number || '回) [MEDIUM]' ELSE last_text END AS text FROM kinds),
ordered AS (
  SELECT *, CASE regexp_replace(text, ' \\[(CRITICAL|HIGH|MEDIUM|LOW)\\]$', '') {cases} ELSE 1 END AS prio,
         row_number() OVER (PARTITION BY ip ORDER BY first) AS place FROM named),
steps AS (
  SELECT ip, place, text, prio, log_source = 'access_log' AS acc, log_source = 'error_log' AS err
  FROM ordered WHERE place = 1
  UNION ALL
  SELECT s.ip, o.place,
         CASE WHEN contains(s.text, o.text) THEN s.text
              WHEN o.prio > s.prio THEN o.text || ' + ' || s.text ELSE s.text || ' + ' || o.text END,
         CASE WHEN contains(s.text, o.text) THEN s.prio ELSE greatest(s.prio, o.prio) END,
         s.acc OR (NOT contains(s.text, o.text) AND o.log_source = 'access_log'),
         s.err OR (NOT contains(s.text, o.text) AND o.log_source = 'error_log')
  FROM steps s JOIN ordered o ON o.ip = s.ip AND o.place = s.place + 1),
merged AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY ip ORDER BY place DESC) = 1),
sv AS (
  SELECT m.ip, m.text AS reason,
         CASE WHEN m.acc AND m.err THEN {O.q(merge.BOTH_SOURCES)} WHEN m.err THEN {O.q(merge.ERROR_SOURCE)}
              ELSE {O.q(merge.SOURCE_OF_LOG['mixed_access_primary'])} END AS source,
         k.count, m.prio AS priority, k.n AS detections, k.first_s, k.last_s, m.acc AND m.err AS integrated
  FROM merged m JOIN (SELECT ip, max(count) AS count, sum(n) AS n, min(first_s) AS first_s, max(last_s) AS last_s
                      FROM kinds GROUP BY ip) k ON k.ip = m.ip)"""


def oracle_sql() -> dict[str, str]:
    def label(col):
        return f"CASE WHEN {col} >= 8 THEN '[高]' WHEN {col} >= 5 THEN '[中]' ELSE '[低]' END"

    base = "WITH RECURSIVE " + O.base_ctes()
    dets = f"{base},{_detections_cte()}"
    verd = f"{dets},{_verdicts_cte()}"
    whole = "reason || ' [' || source || ']'"
    room = "(55 - length(source) - 2)"
    return {
        "shell_detections": f"""{dets} SELECT ip, CAST(ts_s AS BIGINT) AS ts_s, CAST(ord AS BIGINT) AS ord,
            CAST(seq AS BIGINT) AS seq, CAST(count AS BIGINT) AS count, reason, threat_level, log_source FROM sdet2""",
        "detailed_detections": f"""{base},{_profile_cte(True)} SELECT ip, CAST(ts_s AS BIGINT) AS ts_s,
            CAST(ord AS BIGINT) AS ord, CAST(seq AS BIGINT) AS seq, CAST(count AS BIGINT) AS count, reason FROM prof""",
        "shell_verdicts": f"""{verd} SELECT ip, reason, source, CAST(count AS BIGINT) AS count,
            CAST(priority AS BIGINT) AS priority, CAST(detections AS BIGINT) AS detections,
            CAST(first_s AS BIGINT) AS first_s, CAST(last_s AS BIGINT) AS last_s, integrated FROM sv""",
        "shell_ranking": f"""{verd}, r AS (SELECT *, priority + CASE WHEN integrated THEN 1 ELSE 0 END AS rp FROM sv)
            SELECT ip, CAST(count AS BIGINT) AS count, CAST(rp AS BIGINT) AS rank_priority, {label('rp')} AS label,
            CASE WHEN count > 0 THEN count || '回' ELSE '-' END AS count_text,
            {label('rp')} || ' ' || CASE WHEN length({whole}) <= 58 THEN {whole}
              WHEN length(reason) > {room} THEN left(reason, {room}) || '... [' || source || ']'
              ELSE {whole} END AS reason_text FROM r""",
        "shell_summary": f"""{verd} SELECT kind, CAST(count(*) AS BIGINT) AS ips, CAST(sum(n) AS BIGINT) AS detections,
            CAST(max(prio) AS BIGINT) AS priority, {label('max(prio)')} AS label FROM ordered GROUP BY kind""",
    }
