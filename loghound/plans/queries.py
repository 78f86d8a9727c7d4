"""Registered queries (Spark side) and their DuckDB oracle SQL.

Every query reads the driver's ``events`` table (rendered into log lines,
parsed, detected) so its work grows with the table.  Integer outputs are
``bigint`` on both sides so schemas compare equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import url_decode_once
from ..functions.net import ip_class, ip_to_long
from ..functions.priority import priority_label
from ..operators import windows as win
from ..operators.parse import requests_only
from . import core, file_queries, inputs, shell_queries
from .materialize import materialize
from . import oracle as O

_PARSED: dict = {}


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed requests of ``sf_dir``, written once per session and reused."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PARSED:
        _PARSED[key] = inputs.parsed(spark, sf_dir)
    return _PARSED[key]


def _big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def q_parse_requests(spark, sf_dir):
    p = requests_only(parsed(spark, sf_dir))
    return p.select(*_big("ord"), "log_type", "ip", *_big("ts_s"), "method", "url", *_big("status", "size"),
                    "username", "tls_protocol", "level")


def q_log_type_counts(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy("log_type").agg(F.count(F.lit(1)).alias("lines"))


def q_parse_stats(spark, sf_dir):
    from ..operators.report import parse_stats
    return parse_stats(parsed(spark, sf_dir))


def q_url_decode(spark, sf_dir):
    p = requests_only(parsed(spark, sf_dir)).select("url").distinct()
    return p.select("url", url_decode_once(F.col("url")).alias("decoded"))


def q_high_frequency(spark, sf_dir):
    h = win.high_frequency(requests_only(parsed(spark, sf_dir)))
    return h.select("ip", *_big("ts_s", "ord", "count"), "reason")


def q_client_errors(spark, sf_dir):
    e = win.client_errors(requests_only(parsed(spark, sf_dir)))
    return e.select("ip", *_big("ts_s", "ord", "status", "count"), "reason")


_DETS: dict = {}


def _dets(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DETS:
        # The detection list is a product of its own; writing it once lets
        # verdicts, summaries and reports read it instead of re-deriving it
        _DETS[key] = materialize(core.detections(parsed(spark, sf_dir)), "detections")
    return _DETS[key]


def q_sql_injection(spark, sf_dir):
    d = _dets(spark, sf_dir).filter(F.col("seq") == 3)
    return d.select("ip", *_big("ord"), "reason_code", "reason")


def q_shell_injection(spark, sf_dir):
    d = _dets(spark, sf_dir).filter(F.col("seq") == 4)
    per_line = d.groupBy("ip", "ord").agg(
        F.count_if(F.col("sub") < 9999).alias("n_shell"),
        F.min("sub").alias("first_shell"),
        F.max(F.when(F.col("sub") == 9999, F.col("reason"))).alias("complex_reason"))
    return per_line.select("ip", *_big("ord", "n_shell", "first_shell"), "complex_reason")


def q_traversal(spark, sf_dir):
    d = _dets(spark, sf_dir).filter(F.col("seq") == 5)
    return d.select("ip", *_big("ord"), "reason")


def q_row_detectors(spark, sf_dir):
    d = _dets(spark, sf_dir).filter(F.col("seq").between(6, 14))
    return d.select("ip", *_big("ord", "seq"), "reason", "accumulate")


def q_error_rules(spark, sf_dir):
    d = _dets(spark, sf_dir).filter(F.col("seq") == 15)
    return d.select("ip", *_big("ord", "sub", "count"), "reason")


def q_verdicts(spark, sf_dir):
    v = core.verdicts(_dets(spark, sf_dir))
    return v.select("ip", *_big("count"), "reason", *_big("priority"), "label",
                    F.col("first_ts_s").cast("bigint").alias("first_s"),
                    F.unix_timestamp("last_seen").cast("bigint").alias("last_s"))


def q_threat_summary(spark, sf_dir):
    v = core.verdicts(_dets(spark, sf_dir))
    return v.groupBy("reason", "priority").agg(F.count(F.lit(1)).alias("ips")).select(
        "reason", *_big("priority"), "ips")


def q_threat_types(spark, sf_dir):
    return core.threat_types(_dets(spark, sf_dir)).select("reason_code", *_big("priority", "rows", "ips"))


def q_label_counts(spark, sf_dir):
    v = core.verdicts(_dets(spark, sf_dir))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ip").alias("ips"))


def q_ip_classes(spark, sf_dir):
    p = requests_only(parsed(spark, sf_dir)).select("ip").distinct()
    return p.select("ip", ip_class(F.col("ip")).alias("ip_class"), ip_to_long(F.col("ip")).alias("ip_num"))


def q_report_lines(spark, sf_dir):
    from ..operators.report import report_lines
    v = core.verdicts(_dets(spark, sf_dir))
    return report_lines(v).select("ip", "count_text", "reason_text", "country")


def q_fast_profile_hits(spark, sf_dir):
    from ..operators.signatures import shell_profile_hits
    h = shell_profile_hits(requests_only(parsed(spark, sf_dir)), detailed=False)
    return h.filter(F.col("sql_rx") | F.col("trv_rx")).select("ip", *_big("ord"), "sql_rx", "trv_rx")


def q_detailed_profile_hits(spark, sf_dir):
    from ..operators.signatures import shell_profile_hits
    h = shell_profile_hits(requests_only(parsed(spark, sf_dir)), detailed=True)
    return h.filter(F.col("sql_rx") | F.col("trv_rx")).select("ip", *_big("ord"), "sql_rx", "trv_rx")


def q_shell_error_rules(spark, sf_dir):
    from ..operators.shell_rules import shell_error_detections
    d = shell_error_detections(requests_only(parsed(spark, sf_dir)))
    return d.select("ip", *_big("ord", "count"), "threat_level", "reason")


def q_shell_4xx(spark, sf_dir):
    from ..operators.shell_rules import shell_client_errors
    d = shell_client_errors(requests_only(parsed(spark, sf_dir)))
    return d.select("ip", *_big("ts_s", "ord", "status", "count"), "reason")


def q_dominant_4xx(spark, sf_dir):
    from ..operators.shell_rules import client_error_classes
    d = client_error_classes(requests_only(parsed(spark, sf_dir)))
    return d.select("ip", *_big("total", "kinds", "dominant"), "reason")


def _client_addresses(spark, sf_dir):
    """Addresses of several kinds, one per event."""
    uid, kind = F.col("user_id"), F.col("event_id") % 6
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.when(kind == 0, F.concat(F.lit("10.0.0."), (uid % 256).cast("string")))
        .when(kind == 1, F.concat(F.lit("203.0.113."), (uid % 320).cast("string")))
        .when(kind == 2, F.concat(F.lit("2001:db8::"), F.lower(F.hex(uid % 1000))))
        .when(kind == 3, F.concat(F.lit("198.51."), (uid % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string")))
        .when(kind == 4, F.lit("unknown"))
        .otherwise(F.concat(F.lit("192.0.2."), (uid % 256).cast("string"))).alias("ip"))


def _nation_blocks(spark, sf_dir):
    """Address blocks of the nations: nested and overlapping ones, of both families."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k"))

    def block(start, end):
        return n.select(F.concat(*start).alias("start_ip"), F.concat(*end).alias("end_ip"), F.col("k").cast("string").alias("code"))

    def text(c):
        return c.cast("string")

    k = F.col("k")
    return (block([F.lit("203.0.113."), text(k * 10)], [F.lit("203.0.113."), text(F.least(k * 10 + 14, F.lit(255)))])
            .unionByName(block([F.lit("198.51."), text(k * 8), F.lit(".0")], [F.lit("198.51."), text(k * 8 + 30), F.lit(".255")]))
            .unionByName(block([F.lit("2001:db8::"), F.lower(F.hex(k * 32))], [F.lit("2001:db8::"), F.lower(F.hex(k * 32 + 40))])))


def q_ip_country(spark, sf_dir):
    from ..operators.geo import ip_country
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return ip_country(_client_addresses(spark, sf_dir), _nation_blocks(spark, sf_dir), names)


QUERIES = {
    "ip_country": q_ip_country,
    "parse_requests": q_parse_requests,
    "log_type_counts": q_log_type_counts,
    "parse_stats": q_parse_stats,
    "url_decode": q_url_decode,
    "high_frequency": q_high_frequency,
    "client_errors": q_client_errors,
    "sql_injection": q_sql_injection,
    "shell_injection": q_shell_injection,
    "traversal": q_traversal,
    "row_detectors": q_row_detectors,
    "error_rules": q_error_rules,
    "verdicts": q_verdicts,
    "threat_summary": q_threat_summary,
    "threat_types": q_threat_types,
    "label_counts": q_label_counts,
    "ip_classes": q_ip_classes,
    "report_lines": q_report_lines,
    "fast_profile_hits": q_fast_profile_hits,
    "detailed_profile_hits": q_detailed_profile_hits,
    "shell_error_rules": q_shell_error_rules,
    "shell_4xx": q_shell_4xx,
    "dominant_4xx": q_dominant_4xx,
    **shell_queries.QUERIES,
    **file_queries.QUERIES,
}


def _label(col: str) -> str:
    return f"CASE WHEN {col} >= 8 THEN '[高]' WHEN {col} >= 5 THEN '[中]' ELSE '[低]' END"


def _profile_sql(detailed: bool) -> str:
    from ..operators.patterns import (SQL_REGEX_DETAILED, SQL_REGEX_EXTRA, SQL_REGEX_FAST, TRAVERSAL_REGEX_DETAILED,
                                      TRAVERSAL_REGEX_EXTRA, TRAVERSAL_REGEX_FAST)
    from ..operators.signatures import _alternation
    if detailed:
        sql_rx, trv_rx = (_alternation(SQL_REGEX_DETAILED + SQL_REGEX_EXTRA),
                          _alternation(TRAVERSAL_REGEX_DETAILED + TRAVERSAL_REGEX_EXTRA))
        lv = "list_distinct([r0, r1, r2, r3])"
        dec = ("SELECT *, lower(url_decode(r2)) AS r3 FROM (SELECT *, lower(url_decode(r1)) AS r2 FROM "
               "(SELECT *, lower(url_decode(r0)) AS r1 FROM (SELECT *, lower(coalesce(request, url, '')) AS r0 FROM req)))")
    else:
        sql_rx, trv_rx = _alternation(SQL_REGEX_FAST), _alternation(TRAVERSAL_REGEX_FAST)
        lv = "[r0, r1]"
        dec = "SELECT *, lower(url_decode(r0)) AS r1 FROM (SELECT *, lower(coalesce(request, url, '')) AS r0 FROM req)"
    return f"""SELECT ip, CAST(ord AS BIGINT) AS ord, sql_rx, trv_rx FROM (
        SELECT ip, ord, list_bool_or(list_transform({lv}, lambda x: regexp_matches(x, {O.q(sql_rx)}))) AS sql_rx,
               list_bool_or(list_transform({lv}, lambda x: regexp_matches(x, {O.q(trv_rx)}))) AS trv_rx
        FROM ({dec}) WHERE log_type NOT IN ('error_log', 'nginx_error_log')) WHERE sql_rx OR trv_rx"""


def _shell_error_sql() -> str:
    from ..operators.shell_rules import ACCESS_CONTROL_GROUP, ACCESS_CONTROL_MIN, LOW_REASON, SHELL_ERROR_RULES, rule_regex
    cases = " ".join(f"WHEN regexp_matches(lower(coalesce(url, '')), {O.q(rule_regex(p))}) THEN {i}"
                     for i, (_l, _r, p) in enumerate(SHELL_ERROR_RULES))
    levels = O._list([r[0] for r in SHELL_ERROR_RULES] + [LOW_REASON[0]])
    reasons = O._list([r[1] for r in SHELL_ERROR_RULES] + [LOW_REASON[1]])
    acl = O.q(SHELL_ERROR_RULES[ACCESS_CONTROL_GROUP][1])
    return f"""SELECT ip, CAST(ord AS BIGINT) AS ord, CAST(count AS BIGINT) AS count, threat_level, reason FROM (
        SELECT ip, ord, 1 AS count, {levels}[rule + 1] AS threat_level,
               {reasons}[rule + 1] || ' [' || {levels}[rule + 1] || ']' AS reason
        FROM (SELECT *, CASE {cases} ELSE {len(SHELL_ERROR_RULES)} END AS rule FROM req WHERE log_type = 'error_log')
        WHERE rule <> {ACCESS_CONTROL_GROUP}
        UNION ALL
        SELECT ip, ord, n AS count, 'MEDIUM' AS threat_level, {acl} || ' (' || CAST(n AS VARCHAR) || '回) [MEDIUM]' AS reason
        FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_s, ord) AS n
              FROM (SELECT *, CASE {cases} ELSE {len(SHELL_ERROR_RULES)} END AS rule FROM req WHERE log_type = 'error_log')
              WHERE rule = {ACCESS_CONTROL_GROUP})
        WHERE n >= {ACCESS_CONTROL_MIN})"""


def _attack_sql(col: str) -> str:
    from ..operators.shell_rules import STATUS_ATTACKS, UNCLASSED_4XX
    cases = " ".join(f"WHEN {s} THEN {O.q(t)}" for s, t in STATUS_ATTACKS.items())
    return f"CASE {col} {cases} ELSE {O.q(UNCLASSED_4XX)} END"


def _shell_4xx_sql() -> str:
    """Counts by ranges and running sums over the plain lines; the first rule met wins."""
    from ..operators.shell_rules import BULK_4XX_PREFIX, COMPOSITE_4XX, INSTANT_STATUS, SHELL_BULK_MIN, STATUS_MINIMUM
    own = " OR ".join(f"(status = {s} AND w_status >= {n})" for s, n in STATUS_MINIMUM.items())
    earlier = f"RANGE BETWEEN {win.SLIDING_WINDOW_SECONDS} PRECEDING AND 1 PRECEDING"
    return f"""SELECT ip, CAST(ts_s AS BIGINT) AS ts_s, CAST(ord AS BIGINT) AS ord, CAST(status AS BIGINT) AS status,
            CAST(CASE rule WHEN 1 THEN c_status WHEN 2 THEN w_status WHEN 3 THEN c_total ELSE w_total END AS BIGINT) AS count,
            CASE WHEN rule IN (1, 2) THEN {_attack_sql('status')} WHEN rule = 3 THEN {O.q(COMPOSITE_4XX)}
                 ELSE {O.q(BULK_4XX_PREFIX)} || {_attack_sql('status')} END AS reason
        FROM (SELECT *, CASE WHEN status = {INSTANT_STATUS} THEN 1 WHEN ts_s IS NULL THEN NULL WHEN {own} THEN 2
                             WHEN kinds >= 2 THEN 3 WHEN w_total >= {SHELL_BULK_MIN} THEN 4 END AS rule
              FROM (SELECT *, sum(CASE WHEN c_status = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ip ORDER BY c_total) AS kinds
                    FROM (SELECT ip, status, ts_s, ord,
                            row_number() OVER (PARTITION BY ip, status ORDER BY coalesce(ts_s, 0), ord) AS c_status,
                            row_number() OVER (PARTITION BY ip ORDER BY coalesce(ts_s, 0), ord) AS c_total,
                            count(*) OVER (PARTITION BY ip, status ORDER BY ts_s {earlier})
                              + row_number() OVER (PARTITION BY ip, status, ts_s ORDER BY ord) AS w_status,
                            count(*) OVER (PARTITION BY ip ORDER BY ts_s {earlier})
                              + row_number() OVER (PARTITION BY ip, ts_s ORDER BY ord) AS w_total
                          FROM req WHERE status BETWEEN 400 AND 499)))
        WHERE rule IS NOT NULL"""


def _dominant_4xx_sql() -> str:
    from ..operators.shell_rules import COMPOSITE_4XX
    return f"""SELECT ip, CAST(total AS BIGINT) AS total, CAST(kinds AS BIGINT) AS kinds, CAST(status AS BIGINT) AS dominant,
            CASE WHEN kinds >= 2 THEN {O.q(COMPOSITE_4XX)} ELSE {_attack_sql('status')} END AS reason
        FROM (SELECT *, sum(n) OVER (PARTITION BY ip) AS total, count(*) OVER (PARTITION BY ip) AS kinds,
                     row_number() OVER (PARTITION BY ip ORDER BY n DESC, first_t) AS place
              FROM (SELECT ip, status, count(*) AS n, min(coalesce(ts_s, 0) * 100000000 + ord) AS first_t
                    FROM req WHERE status BETWEEN 400 AND 499 GROUP BY ip, status))
        WHERE place = 1"""


def _threat_types_sql() -> str:
    from ..operators.patterns import SHELL_SIGNATURES, TRAVERSAL_SIGNATURES
    severe = " OR ".join(f"contains(reason, {O.q(m)})" for m in core.SEVERE_MARKS)
    never = " OR ".join(f"contains(reason, {O.q(m)})" for m in core.NEVER_REPLACING_MARKS)
    shell, trv = O._list([x[0] for x in SHELL_SIGNATURES]), O._list([x[0] for x in TRAVERSAL_SIGNATURES])
    cols = "ip, ts_s, ord, seq, sub, reason, acc"

    def chosen(col):
        order = "ORDER BY ts_s, ord, seq, sub"
        return (f"coalesce(last({col} {order}) FILTER (WHERE ({severe}) AND NOT ({never})), first({col} {order})) AS {col}")

    coded = f"""SELECT {cols}, reason_code AS code FROM sqlhit
        UNION ALL SELECT {cols}, {shell}[sub % 1000 + 1] FROM shellhit
        UNION ALL SELECT {cols}, 'SHL-COMPLEX' FROM complexhit
        UNION ALL SELECT t.ip, t.ts_s, t.ord, t.seq, t.sub, t.reason, t.acc, {trv}[s.trv_hit + 1] FROM trvhit t JOIN sig s ON s.ord = t.ord
        UNION ALL SELECT {cols}, printf('ROW-%02d', seq) FROM rowhit
        UNION ALL SELECT e.ip, e.ts_s, e.ord, e.seq, e.sub, e.reason, e.acc, printf('ERR-%02d', p.ph)
          FROM (SELECT * FROM errplain UNION ALL SELECT * FROM authhit) e JOIN errph p ON p.ord = e.ord
        UNION ALL SELECT {cols}, 'ERR-DIST' FROM disthit
        UNION ALL SELECT {cols}, 'HIGH-FREQ' FROM hf
        UNION ALL SELECT ip, ts_s, ord, 2, 0, reason, FALSE, 'HTTP-' || status FROM e4hit"""
    return f"""SELECT code AS reason_code, CAST(priority AS BIGINT) AS priority, count(*) AS rows, count(DISTINCT ip) AS ips
        FROM (SELECT ip, code, {O.priority_sql('reason')} AS priority FROM (
          SELECT ip, {chosen('reason')}, {chosen('code')} FROM ({coded}) WHERE NOT acc GROUP BY ip
          UNION ALL SELECT ip, reason, min(code) FROM ({coded}) WHERE acc GROUP BY ip, reason))
        GROUP BY code, priority"""


def _ip_country_sql() -> str:
    """By numbers: the place of an address within its net, and the blocks as ranges of such places."""
    from ..operators.geo import PRIVATE_LABEL, UNKNOWN_LABEL
    return f"""WITH a AS (
          SELECT DISTINCT CASE event_id % 6 WHEN 0 THEN '10.0.0.' || (user_id % 256) WHEN 1 THEN '203.0.113.' || (user_id % 320)
              WHEN 2 THEN '2001:db8::' || lower(to_hex(user_id % 1000)) WHEN 3 THEN '198.51.' || (user_id % 256) || '.' || (event_id % 256)
              WHEN 4 THEN 'unknown' ELSE '192.0.2.' || (user_id % 256) END AS ip,
            event_id % 6 AS kind,
            CASE event_id % 6 WHEN 1 THEN CASE WHEN user_id % 320 < 256 THEN user_id % 320 END WHEN 2 THEN user_id % 1000
              WHEN 3 THEN user_id % 256 END AS at
          FROM events),
        b AS (
          SELECT 1 AS kind, n_nationkey AS k, n_nationkey * 10 AS lo, least(n_nationkey * 10 + 14, 255) AS hi, n_name FROM nation
          UNION ALL SELECT 2, n_nationkey, n_nationkey * 32, n_nationkey * 32 + 40, n_name FROM nation
          UNION ALL SELECT 3, n_nationkey, n_nationkey * 8, n_nationkey * 8 + 30, n_name FROM nation)
        SELECT a.ip, CASE WHEN a.kind = 0 THEN {O.q(PRIVATE_LABEL)} ELSE coalesce(
            (SELECT arg_max(b.n_name, b.lo) FROM b WHERE b.kind = a.kind AND a.at BETWEEN b.lo AND b.hi),
            {O.q(UNKNOWN_LABEL)}) END AS country FROM a"""


def oracle_sql() -> dict[str, str]:
    W = O.with_all
    return {
        "ip_country": _ip_country_sql(),
        "parse_requests": W("""SELECT CAST(ord AS BIGINT) AS ord, log_type, ip, CAST(ts_s AS BIGINT) AS ts_s, method, url,
            CAST(status AS BIGINT) AS status, CAST(size AS BIGINT) AS size, username, tls_protocol, level FROM req""",
                            ("base",)),
        "log_type_counts": W("SELECT log_type, count(*) AS lines FROM req GROUP BY log_type", ("base",)),
        "parse_stats": W("""SELECT count(*) AS total, count(*) AS parsed, CAST(0 AS BIGINT) AS failed,
            CAST(100.0 AS DOUBLE) AS parsed_pct, CAST(0.0 AS DOUBLE) AS failed_pct,
            array_to_string(list_filter(['access_log', 'error_log', 'ssl_request_log'],
                                        lambda t: list_contains(list(DISTINCT log_type), t)), ', ') AS log_types
            FROM req""", ("base",)),
        "url_decode": W("SELECT DISTINCT url, url_decode(url) AS decoded FROM req", ("base",)),
        "high_frequency": W("SELECT ip, CAST(ts_s AS BIGINT) AS ts_s, CAST(ord AS BIGINT) AS ord, "
                            "CAST(count AS BIGINT) AS count, reason FROM hf"),
        "client_errors": W("SELECT ip, CAST(ts_s AS BIGINT) AS ts_s, CAST(ord AS BIGINT) AS ord, "
                           "CAST(status AS BIGINT) AS status, CAST(count AS BIGINT) AS count, reason FROM e4hit"),
        "sql_injection": W("SELECT ip, CAST(ord AS BIGINT) AS ord, reason_code, reason FROM sqlhit"),
        "shell_injection": W("""SELECT s.ip, CAST(s.ord AS BIGINT) AS ord, CAST(s.n_shell AS BIGINT) AS n_shell,
            CAST(s.sub AS BIGINT) AS first_shell, c.reason AS complex_reason
            FROM shellhit s LEFT JOIN complexhit c ON s.ord = c.ord"""),
        "traversal": W("SELECT ip, CAST(ord AS BIGINT) AS ord, reason FROM trvhit"),
        "row_detectors": W("SELECT ip, CAST(ord AS BIGINT) AS ord, CAST(seq AS BIGINT) AS seq, reason, "
                           "acc AS accumulate FROM rowhit"),
        "error_rules": W("""SELECT ip, CAST(ord AS BIGINT) AS ord, CAST(sub AS BIGINT) AS sub, CAST(count AS BIGINT) AS count, reason
            FROM (SELECT * FROM errplain UNION ALL SELECT * FROM authhit UNION ALL SELECT * FROM disthit)"""),
        "verdicts": W(f"""SELECT ip, count, reason, CAST(priority AS BIGINT) AS priority, {_label('priority')} AS label,
            CAST(first_s AS BIGINT) AS first_s, CAST(last_s AS BIGINT) AS last_s FROM verdict"""),
        "threat_summary": W("SELECT reason, CAST(priority AS BIGINT) AS priority, count(*) AS ips "
                            "FROM verdict GROUP BY reason, priority"),
        "threat_types": W(_threat_types_sql()),
        "label_counts": W(f"SELECT {_label('priority')} AS label, count(*) AS rows, count(DISTINCT ip) AS ips "
                          f"FROM verdict GROUP BY 1"),
        "report_lines": W(f"""SELECT ip, CASE WHEN count > 0 THEN CAST(count AS VARCHAR) || '回' ELSE '-' END AS count_text,
            CASE WHEN length(lbl || ' ' || reason) > 58 THEN left(lbl || ' ' || reason, 55) || '...'
                 ELSE lbl || ' ' || reason END AS reason_text, 'N/A' AS country
            FROM (SELECT *, {_label('priority')} AS lbl FROM verdict)"""),
        "fast_profile_hits": W(_profile_sql(False), ("base",)),
        "detailed_profile_hits": W(_profile_sql(True), ("base",)),
        "shell_error_rules": W(_shell_error_sql(), ("base",)),
        "shell_4xx": W(_shell_4xx_sql(), ("base",)),
        "dominant_4xx": W(_dominant_4xx_sql(), ("base",)),
        **shell_queries.oracle_sql(),
        **file_queries.oracle_sql(),
        "ip_classes": W("""SELECT DISTINCT ip,
            CASE WHEN split_part(ip, '.', 1) = '10' OR (split_part(ip, '.', 1) = '192' AND split_part(ip, '.', 2) = '168')
                   OR (split_part(ip, '.', 1) = '172' AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31)
                   OR split_part(ip, '.', 1) = '127' OR (split_part(ip, '.', 1) = '169' AND split_part(ip, '.', 2) = '254')
                   OR split_part(ip, '.', 1) = '224' THEN 'private' ELSE 'public' END AS ip_class,
            CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
              + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS ip_num
            FROM req""", ("base",)),
    }
