"""Profiles fast/detailed from requests to ranked verdicts.

Access and error detections come together as one list (U2).  The merge (A3)
is in two steps that both combine before the shuffle:

1. per (client, kind of reason): first place, highest running number, highest
   count, number of detections.  All buffers are numbers, so this is a hash
   aggregate, and a client with a third of all lines is a few rows after it.
2. per client: its kinds, at most as many as there are rules, are put in the
   order of their first detection and folded into one text.

Reasons that differ by their running number only are one kind; its text is
written from the highest number.  So the text of a client is bounded by the
rules and not by its lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.priority import priority_label, shell_priority_table
from ..functions.text import count_display, threat_level_tag
from . import windows as win
from .shell_rules import (ACCESS_CONTROL_GROUP, ACCESS_CONTROL_MIN, SHELL_ERROR_RULES, error_detections, error_rules,
                          shell_client_errors)
from .signatures import shell_profile_hits

# --- fixed values: reasons and labels of profiles fast/detailed ---
SQL_REASON = "SQLインジェクション攻撃の可能性"
TRAVERSAL_REASON = "ディレクトリトラバーサル攻撃の可能性"
DETAILED_MARK = "詳細検出"
RISK_MEDIUM, RISK_HIGH = "中リスク", "高リスク"
RISK_HIGH_FROM = 5
JOINED_BY = " + "
BOTH_SOURCES = "統合検出: access_log+error_log"
ERROR_SOURCE = "error_log検出"
SOURCE_OF_LOG = {
    "ssl_request_log": "SSL request log検出",
    "ssl_access_log": "SSL request log検出",
    "access_log": "access_log検出",
    "mixed_access_primary": "混在ログ検出",
    "mixed_error_primary": "混在ログ検出",
}
OTHER_SOURCE = "ログ検出"
# --- end of fixed values ---

ERROR_LOGS = ("error_log", "nginx_error_log")


def _traversal_text(detailed: Column, n: Column) -> Column:
    risk = F.when(n >= RISK_HIGH_FROM, F.lit(RISK_HIGH)).otherwise(F.lit(RISK_MEDIUM))
    mark = F.when(detailed, F.lit(DETAILED_MARK + "・")).otherwise(F.lit(""))
    return F.concat(F.lit(TRAVERSAL_REASON + " ("), mark, risk, F.lit("・"), n.cast("string"), F.lit("回)"))


def as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def profile_detections(requests: DataFrame, detailed: bool, keep: Callable[[DataFrame, str], DataFrame] = as_is) -> DataFrame:
    """D2/D3 and D7/D8 as detections: ip, ts_s, ord, seq, kind, number, reason, count.

    A request is one SQL detection at most and one traversal detection at
    most; the traversal ones carry the client's running number (W8) and its
    risk word.  Error lines and lines without a time have none.  ``keep``
    writes the lines that hit, so that they are matched once.
    """
    hits = keep(shell_profile_hits(requests.filter(F.col("ts_s").isNotNull()), detailed).filter("sql_rx OR trv_rx")
                .select("ip", "ts_s", "ord", "sql_rx", "trv_rx"), "profile-hits")
    sql_text = F.lit(f"{SQL_REASON} ({DETAILED_MARK})" if detailed else SQL_REASON)
    sql = hits.filter("sql_rx").select(
        "ip", "ts_s", "ord", F.lit(3).alias("seq"), sql_text.alias("kind"), F.lit(None).cast("int").alias("number"),
        sql_text.alias("reason"), F.lit(1).cast("bigint").alias("count"))
    ranked = win.running_rank(hits.filter("trv_rx").select("ip", "ts_s", "ord"), ["ip"], "number")
    kind = TRAVERSAL_REASON + (f" ({DETAILED_MARK})" if detailed else "")
    trv = ranked.select("ip", "ts_s", "ord", F.lit(4).alias("seq"), F.lit(kind).alias("kind"), "number",
                        _traversal_text(F.lit(detailed), F.col("number")).alias("reason"),
                        F.lit(1).cast("bigint").alias("count"))
    return sql.unionByName(trv)


def shell_detections(requests: DataFrame, detailed: bool = False,
                     keep: Callable[[DataFrame, str], DataFrame] = as_is) -> DataFrame:
    """Every detection of the profile over access and error lines.

    Columns ip, ts_s, ord, seq (place within the tests of a line), kind (the
    reason without its running number), number, reason, count, threat_level
    (F12), log_source.  ``keep`` (a table and its name) writes what several
    branches read: the lines that hit and the error lines with their rule.
    """
    timed = requests.filter(F.col("ts_s").isNotNull() & ~F.col("log_type").isin(*ERROR_LOGS))
    none = F.lit(None).cast("int").alias("number")
    frequent = win.high_frequency(timed).select(
        "ip", "ts_s", "ord", F.lit(1).alias("seq"), F.lit(win.HIGH_FREQ_REASON).alias("kind"), none,
        F.lit(win.HIGH_FREQ_REASON).alias("reason"), F.col("count").cast("bigint").alias("count"))
    errors4 = shell_client_errors(timed).select(
        "ip", "ts_s", "ord", F.lit(2).alias("seq"), F.col("reason").alias("kind"), none, "reason", "count")
    access = frequent.unionByName(errors4).unionByName(profile_detections(requests, detailed, keep)).withColumn(
        "log_source", F.lit("access_log"))
    acl = SHELL_ERROR_RULES[ACCESS_CONTROL_GROUP][1]
    counted = F.col("count") >= ACCESS_CONTROL_MIN
    error = error_detections(keep(error_rules(requests), "error-rules")).select(
        "ip", "ts_s", "ord", F.lit(5).alias("seq"),
        F.when(counted, F.lit(f"{acl} [MEDIUM]")).otherwise(F.col("reason")).alias("kind"),
        F.when(counted, F.col("count").cast("int")).alias("number"), "reason", "count",
        F.lit("error_log").alias("log_source"))
    return access.unionByName(error).withColumn("threat_level", threat_level_tag(F.col("reason")))


def _text_of(kind: Column, number: Column) -> Column:
    """The text of a kind of reason, with the highest running number where it has one."""
    acl = SHELL_ERROR_RULES[ACCESS_CONTROL_GROUP][1]
    detailed = f"{TRAVERSAL_REASON} ({DETAILED_MARK})"
    return (F.when(number.isNull(), kind)
            .when(kind.isin(TRAVERSAL_REASON, detailed), _traversal_text(kind == detailed, number))
            .otherwise(F.concat(F.lit(acl + " ("), number.cast("string"), F.lit("回) [MEDIUM]"))))


def kinds_of_clients(dets: DataFrame) -> DataFrame:
    """Step 1: one row per (client, kind of reason) with its priority.

    The priority is looked up by the whole reason; a level tag is no part of it.
    """
    per = dets.groupBy("ip", "kind", "log_source").agg(
        F.min(win.packed_order()).alias("first"), F.max("number").alias("number"), F.max("count").alias("count"),
        F.count(F.lit(1)).alias("detections"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))
    bare = F.regexp_replace("text", r" \[(CRITICAL|HIGH|MEDIUM|LOW)\]$", "")
    table = shell_priority_table(dets.sparkSession)  # fixed rows: the rule set's own table
    return (per.withColumn("text", _text_of(F.col("kind"), F.col("number"))).withColumn("reason_key", bare)
            .join(F.broadcast(table), "reason_key", "left")
            .withColumn("priority", F.coalesce("priority", F.lit(1))).drop("reason_key"))


def _fold(state, r):
    """A3: a new reason goes in front if its priority is higher, else to the end; one that the text holds is left out."""
    front = r["priority"] > state["priority"]
    text = (F.when(state["text"].isNull(), r["text"])
            .when(front, F.concat(r["text"], F.lit(JOINED_BY), state["text"]))
            .otherwise(F.concat(state["text"], F.lit(JOINED_BY), r["text"])))
    is_error = r["log_source"] == "error_log"
    held = F.coalesce(state["text"].contains(r["text"]), F.lit(False))
    return F.struct(F.when(held, state["text"]).otherwise(text).alias("text"),
                    F.when(held, state["priority"]).otherwise(F.greatest(state["priority"], r["priority"])).alias("priority"),
                    (state["access"] | (~held & ~is_error)).alias("access"),
                    (state["error"] | (~held & is_error)).alias("error"))


def shell_verdicts(dets: DataFrame, log_type: str = "mixed_access_primary") -> DataFrame:
    """A3 + A8: one row per client: ip, reason, source, count, priority, integrated, detections, first_s, last_s.

    ``priority`` is the highest of the merged reasons; ``integrated`` says
    that both access and error lines gave one.  ``log_type`` (the guess for
    the whole file) names the source of a client that only access lines gave.
    """
    one = F.struct("first", "text", "priority", "log_source")
    per = kinds_of_clients(dets).groupBy("ip").agg(
        F.sort_array(F.collect_list(one)).alias("_kinds"), F.max("count").alias("count"),
        F.sum("detections").alias("detections"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"))
    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("priority"),
                     F.lit(False).alias("access"), F.lit(False).alias("error"))
    merged = per.withColumn("_m", F.reduce("_kinds", start, _fold))
    source = (F.when(F.col("_m.access") & F.col("_m.error"), F.lit(BOTH_SOURCES))
              .when(F.col("_m.error"), F.lit(ERROR_SOURCE))
              .otherwise(F.lit(SOURCE_OF_LOG.get(log_type, OTHER_SOURCE))))
    return merged.select("ip", F.col("_m.text").alias("reason"), source.alias("source"), "count",
                         F.col("_m.priority").alias("priority"), (F.col("_m.access") & F.col("_m.error")).alias("integrated"),
                         "detections", "first_s", "last_s")


def _display(reason: Column, source: Column, width: int = 58) -> Column:
    """a text over ``width`` characters is cut, its source stays whole at the end."""
    tail = F.concat(F.lit("["), source, F.lit("]"))
    room = F.lit(width - 3) - F.length(tail)
    whole = F.concat(reason, F.lit(" "), tail)
    return (F.when(F.length(whole) <= width, whole)
            .when(F.length(reason) > room, F.concat(F.substring(reason, F.lit(1), F.greatest(room, F.lit(0))),
                                                    F.lit("... "), tail))
            .otherwise(whole))


def shell_ranking(verdicts: DataFrame) -> DataFrame:
    """O2: verdicts with rank_priority (one more where both logs agree), label and display texts.

    The order of the report is rank_priority, count (both falling), ip: see :func:`ranked`.
    """
    rank = F.col("priority") + F.when(F.col("integrated"), F.lit(1)).otherwise(F.lit(0))
    label = priority_label(rank)
    return verdicts.select(
        "ip", "count", "priority", rank.alias("rank_priority"), label.alias("label"), "reason", "source",
        count_display(F.col("count")).alias("count_text"),
        F.concat(label, F.lit(" "), _display(F.col("reason"), F.col("source"))).alias("reason_text"))


def ranked(ranking: DataFrame) -> DataFrame:
    """The rows of :func:`shell_ranking` in the order of the report: a range-partitioned sort."""
    return ranking.orderBy(F.desc("rank_priority"), F.desc("count"), "ip")


def shell_summary(dets: DataFrame) -> DataFrame:
    """O3 + A4 + A9: per kind of reason its clients, detections before the merge, priority and label."""
    per = kinds_of_clients(dets).groupBy("kind").agg(
        F.count(F.lit(1)).alias("ips"), F.sum("detections").alias("detections"), F.max("priority").alias("priority"))
    return per.select("kind", "ips", "detections", "priority", priority_label(F.col("priority")).alias("label"))

