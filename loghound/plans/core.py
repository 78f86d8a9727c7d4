"""Profile ``core``: detections, verdicts and summary as one lazy plan.

Stages (``explain`` shows them as such):

1. scan + parse + signature/row detectors: one narrow projection per line
   producing an array of detection structs, exploded once (only hits leave
   the stage).
2. counters that depend on history (W1, W2-W5, W8, W9, W10) via the
   skew-safe primitives of :mod:`loghound.operators.windows`.
3. verdict per client (A1) and accumulating verdicts (A2): hash aggregates
   over packed order numbers, so a hot client is combined before the shuffle,
   and one join for the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.priority import priority_label, priority_of
from ..operators import windows as win
from ..operators.parse import requests_only
from ..operators.patterns import COMPLEX_SHELL_REASON, TRAVERSAL_REASON, shell_reason, sql_reason
from ..operators.rows import (BRUTE_FORCE_REASON, DISTRIBUTED_REASON, ERROR_PHRASES, ERROR_PHRASES_LEGACY,
                              error_phrase_index, row_detectors)
from ..operators.rules import LEVEL_STEP, RuleSet, default_rules, text_array
from ..operators.signatures import core_signature_hits
from .materialize import materialize

# --- fixed values: reasons that replace an earlier verdict reason ---
SEVERE_MARKS = ["高リスク", "SQLインジェクション", "複合シェルインジェクション攻撃"]
NEVER_REPLACING_MARKS = ["認証失敗", "ブルートフォース"]
# --- end of fixed values ---

DETECTION_COLUMNS = ["ip", "ts_s", "ord", "seq", "sub", "reason_code", "reason", "count", "accumulate", "log_source"]

_DET = "struct<seq:int,sub:int,code:string,reason:string,count:int,acc:boolean,kind:string>"


def _det(seq, sub, code, reason, count=1, acc=False, kind="plain") -> Column:
    return F.struct(F.lit(seq).cast("int").alias("seq"), F.lit(sub).cast("int").alias("sub"),
                    F.lit(code).cast("string").alias("code") if isinstance(code, str) else code.alias("code"),
                    (F.lit(reason) if isinstance(reason, str) else reason).cast("string").alias("reason"),
                    (F.lit(count) if isinstance(count, int) else count).cast("int").alias("count"),
                    F.lit(acc).alias("acc"), F.lit(kind).alias("kind"))


def line_detections(requests: DataFrame, legacy_order: bool = False, rules: RuleSet | None = None) -> DataFrame:
    """All detections that need no history, plus placeholders for the
    traversal (W8) and authentication (W9) counters, exploded to rows.

    ``rules`` replaces the built-in signatures (``rules_of`` a table)."""
    rules = rules or default_rules()
    hits = core_signature_hits(requests, rules)
    sql_reasons = text_array([sql_reason(s.suffix) for s in rules.sql])
    sql_codes = text_array([s.id for s in rules.sql])
    sh_reasons = text_array([shell_reason(s.suffix) for s in rules.shell])
    sh_codes = text_array([s.id for s in rules.shell])
    trv_codes = text_array([s.id for s in rules.traversal])
    trv_suffixes = text_array([s.suffix for s in rules.traversal])
    phrases = ERROR_PHRASES_LEGACY if legacy_order else ERROR_PHRASES
    ph_reasons = text_array([p[1] for p in phrases])
    ph_auth = F.array(*[F.lit(p[2]) for p in phrases])

    sql_i = F.col("sql_hit")
    trv_i = F.col("trv_hit")
    n_shell = F.size("shell_hits")
    is_error = F.col("method") == "ERROR_LOG"
    ph = F.col("_phrase")
    ph_is_auth = F.coalesce(F.try_element_at(ph_auth, ph + 1), F.lit(False))

    fixed = [
        F.when(sql_i.isNotNull(), _det(3, 0, F.try_element_at(sql_codes, sql_i + 1), F.try_element_at(sql_reasons, sql_i + 1))),
        F.when((n_shell >= 3) | (F.col("shell_high") >= 2),
               _det(4, 9999, "SHL-COMPLEX",
                    F.format_string(COMPLEX_SHELL_REASON + " (%dパターン検出)", n_shell), n_shell)),
        F.when(trv_i.isNotNull(), _det(5, 0, F.try_element_at(trv_codes, trv_i + 1),
                                        F.try_element_at(trv_suffixes, trv_i + 1),
                                        1, False, "trv")),
    ]
    for seq, cond, reason, acc in row_detectors():
        fixed.append(F.when(cond, _det(seq, 0, f"ROW-{seq:02d}", reason, 1, acc)))
    fixed.append(F.when(is_error & ph.isNotNull(),
                        _det(15, 0, F.format_string("ERR-%02d", ph), F.try_element_at(ph_reasons, ph + 1), 1, False,
                             F.when(ph_is_auth, F.lit("auth")).otherwise(F.lit("plain")))))
    shell_dets = F.transform("shell_hits", lambda h: _det(
        4, h, F.try_element_at(sh_codes, (h % LEVEL_STEP) + 1), F.try_element_at(sh_reasons, (h % LEVEL_STEP) + 1)))
    with_phrase = hits.withColumn("_phrase", F.when(is_error, error_phrase_index(F.col("url"), legacy_order)))
    arr = F.concat(F.array_compact(F.array(*fixed[:2])), shell_dets, F.array_compact(F.array(*fixed[2:])))
    exploded = with_phrase.select("ip", "ts_s", "ord", "log_type", F.explode(arr).alias("d"))
    return exploded.select("ip", "ts_s", "ord", "log_type", "d.*")


def _numbered(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Running number ``n`` per client, going on from ``before`` (ip, n) where it is given."""
    ranked = win.running_rank(rows, ["ip"], "n")
    if before is None:
        return ranked
    start = before.select("ip", F.col("n").alias("_start"))
    return ranked.join(start, "ip", "left").withColumn(
        "n", (F.col("n") + F.coalesce("_start", F.lit(0))).cast("int")).drop("_start")


def traversal_detections(trv: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """W8 + D6 reason: running traversal count per client."""
    ranked = _numbered(trv, before)
    suffix = F.col("reason")
    high = F.col("n") >= win.TRAVERSAL_THRESHOLD
    label = (F.when(suffix != "", F.concat(suffix, F.when(high, F.lit("・高リスク")).otherwise(F.lit("")), F.lit("・")))
             .otherwise(F.when(high, F.lit("高リスク・")).otherwise(F.lit(""))))
    reason = F.concat(F.lit(TRAVERSAL_REASON + " ("), label, F.col("n").cast("string"), F.lit("回)"))
    return ranked.withColumn("reason", reason).withColumn("count", F.lit(1))


def _failure_reasons(ranked: DataFrame) -> DataFrame:
    """The reason of a failure by the running number of its client."""
    return ranked.withColumn(
        "reason", F.when(F.col("n") >= win.AUTH_FAILURE_THRESHOLD,
                         F.format_string(BRUTE_FORCE_REASON + " (%d回試行)", F.col("n"))).otherwise(F.col("reason"))
    ).withColumn("count", F.col("n"))


def failure_detections(auth: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """W9 alone: the failures of each client with their running number."""
    return _failure_reasons(_numbered(auth, before))


def _auth(auth: DataFrame) -> DataFrame:
    """W9 + W10: running failure count per client and the distributed check."""
    ranked = _numbered(auth, None)
    base = _failure_reasons(ranked)
    seconds = win.trailing_failures(auth)
    fired = (ranked.filter((F.col("n") < win.AUTH_FAILURE_THRESHOLD) & F.col("ts_s").isNotNull())
             .join(seconds, "ts_s")
             .filter((F.col("w_failures") >= win.DISTRIBUTED_MIN_FAILURES)
                     & (F.col("w_ips") >= win.DISTRIBUTED_MIN_IPS))
             .withColumn("reason", F.format_string(DISTRIBUTED_REASON + " (%d IP、%d回試行)",
                                                   F.col("w_ips"), F.col("w_failures")))
             .withColumn("count", F.col("n"))
             .withColumn("sub", F.lit(1))
             .withColumn("code", F.lit("ERR-DIST"))
             .drop("w_failures", "w_ips"))
    return base.drop("n").unionByName(fired.drop("n"))


def detections(parsed: DataFrame, legacy_order: bool = False, cut_lineage: bool = True,
               rules: RuleSet | None = None) -> DataFrame:
    """Every detection of profile core, one row each.

    The per-line detections (signature matching is the CPU-heavy part) are
    computed in one pass; with ``cut_lineage`` they are written once to the
    checkpoint folder, so the traversal / authentication / distributed
    branches read the (small) hit table instead of re-matching every line.
    """
    req = requests_only(parsed)
    lines = line_detections(req, legacy_order, rules)
    if cut_lineage:
        lines = materialize(lines, "line-detections")
    plain = lines.filter(F.col("kind") == "plain").drop("kind")
    trv = traversal_detections(lines.filter(F.col("kind") == "trv").drop("kind"))
    auth = _auth(lines.filter(F.col("kind") == "auth").drop("kind"))
    hf = win.high_frequency(req).select(
        "ip", "ts_s", "ord", F.lit(None).cast("string").alias("log_type"), F.lit(1).alias("seq"),
        F.lit(0).alias("sub"), F.lit("HIGH-FREQ").alias("code"), "reason", "count", F.lit(False).alias("acc"))
    e4 = win.client_errors(req).select(
        "ip", "ts_s", "ord", F.lit(None).cast("string").alias("log_type"), F.lit(2).alias("seq"),
        F.lit(0).alias("sub"), F.format_string("HTTP-%d", F.col("status")).alias("code"), "reason", "count",
        F.lit(False).alias("acc"))
    cols = ["ip", "ts_s", "ord", "log_type", "seq", "sub", "code", "reason", "count", "acc"]
    allrows = (plain.select(*cols).unionByName(trv.select(*cols)).unionByName(auth.select(*cols))
               .unionByName(hf).unionByName(e4))
    return allrows.select(
        "ip", "ts_s", "ord", "seq", "sub", F.col("code").alias("reason_code"), "reason",
        F.col("count").cast("int").alias("count"), F.col("acc").alias("accumulate"),
        F.when(F.col("seq") == 15, F.lit("error_log")).otherwise(F.lit("access_log")).alias("log_source"))


def _severe(reason: Column) -> Column:
    sev = None
    for m in SEVERE_MARKS:
        sev = reason.contains(m) if sev is None else (sev | reason.contains(m))
    for m in NEVER_REPLACING_MARKS:
        sev = sev & ~reason.contains(m)
    return sev


def verdict_parts(dets: DataFrame) -> DataFrame:
    """A1 + A2 in two phases: one row per (ip, acc), ``acc`` the accumulating reason or NULL.

    1. Hash aggregates over numbers: the order of a detection is packed into
       one number, so its least and greatest need no sort.
    2. One equality join on (ip, order) fetches reason and code of the one
       detection that counts: the last severe one, else the first.

    Columns ip, acc, count, first (order of the first detection), pick (order
    of the one that counts), severe, reason, reason_code, first_s, last_s.
    """
    keyed = dets.withColumn("pick", win.packed_order(sub=True)).withColumn(
        "acc", F.when(F.col("accumulate"), F.col("reason"))).withColumn("_severe", _severe(F.col("reason")))
    severe = F.max(F.when(F.col("_severe") & ~F.col("accumulate"), F.col("pick")))
    ends = keyed.groupBy("ip", "acc", "accumulate").agg(
        F.max("count").alias("_max"), F.sum("count").alias("_sum"), F.min("pick").alias("first"), severe.alias("_last"),
        F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))
    chosen = ends.select(
        "ip", "acc", F.when(F.col("accumulate"), F.col("_sum")).otherwise(F.col("_max")).cast("bigint").alias("count"),
        "first", F.coalesce("_last", "first").alias("pick"), F.col("_last").isNotNull().alias("severe"), "first_s", "last_s")
    texts = keyed.select("ip", "pick", F.coalesce("acc", F.lit("")).alias("_acc"), "reason", "reason_code")
    return (chosen.withColumn("_acc", F.coalesce("acc", F.lit(""))).join(texts, ["ip", "pick", "_acc"])
            .dropDuplicates(["ip", "pick", "_acc"]).drop("_acc"))


def verdict_rows(parts: DataFrame) -> DataFrame:
    """A10 + F8/F9: the verdict table of :func:`verdict_parts`, with priority, label and times."""
    prio = priority_of(F.col("reason"))
    seconds = F.lit("10000000000000000000000000").cast("decimal(38,0)")
    rest = F.pmod(F.col("first"), seconds)
    return parts.select(
        "ip", "count", "reason", "reason_code", prio.alias("priority"), priority_label(prio).alias("label"),
        F.timestamp_seconds("first_s").alias("first_seen"), F.timestamp_seconds("last_s").alias("last_seen"),
        ((F.col("first") - rest) / seconds).cast("bigint").alias("first_ts_s"),
        F.floor(rest / F.lit(1000000)).cast("bigint").alias("first_ord"))


def verdicts(dets: DataFrame) -> DataFrame:
    """A1 + A2 + A10 + F8/F9: one row per client (plus one per accumulating
    reason), with priority, label and event-time first/last seen."""
    return verdict_rows(verdict_parts(dets))


def threat_types(dets: DataFrame) -> DataFrame:
    """A4: per reason code of the verdicts its priority, rows and clients; no running number splits a type."""
    return verdicts(dets).groupBy("reason_code", "priority").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("ip").alias("ips"))
