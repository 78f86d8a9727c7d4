"""Ranked suspicious-client report.

The ranking is a global sort (range-partitioned, no single-task window);
the text form is a ``format_string`` projection written with
``DataFrame.write.text``.  ``top_n`` is the report's own feature (O4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip_display, count_display, pct

DISPLAY_WIDTH = 58


def ranked(verdicts: DataFrame) -> DataFrame:
    """O1: priority desc, count desc, first recorded first; ip breaks ties."""
    return verdicts.orderBy(F.desc("priority"), F.desc("count"), F.asc("first_ts_s"), F.asc("first_ord"),
                            F.asc("ip"), F.asc("reason"))


def report_lines(verdicts: DataFrame, country: DataFrame | None = None) -> DataFrame:
    """F10 display columns: ip, ``N回``, ``[label] reason`` cut at 58 chars, country."""
    v = verdicts
    if country is not None:
        v = v.join(country, "ip", "left")
    else:
        v = v.withColumn("country", F.lit("N/A"))
    display = clip_display(F.concat(F.col("label"), F.lit(" "), F.col("reason")), DISPLAY_WIDTH)
    return v.select("ip", "priority", "count", "first_ts_s", "first_ord",
                    count_display(F.col("count")).alias("count_text"),
                    display.alias("reason_text"), F.coalesce(F.col("country"), F.lit("N/A")).alias("country"),
                    F.format_string("%-16s %-8s %-60s %-20s", F.col("ip"), count_display(F.col("count")),
                                    display, F.coalesce(F.col("country"), F.lit("N/A"))).alias("line"))


def top_n(verdicts: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows of the ranked report."""
    return ranked(verdicts).limit(n)


def threat_summary(verdicts: DataFrame) -> DataFrame:
    """A4/O3: verdict rows per reason with priority, highest priority first."""
    return (verdicts.groupBy("reason", "priority", "label").agg(F.count(F.lit(1)).alias("ips"))
            .orderBy(F.desc("priority"), F.desc("ips"), F.asc("reason")))


def parse_stats(parsed: DataFrame) -> DataFrame:
    """One row of total, parsed and failed lines, shares, and the kinds of log among the parsed ones."""
    order = F.array(*[F.lit(t) for t in ("access_log", "error_log", "ssl_request_log")])
    agg = parsed.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("parsed")).alias("parsed"),
                     F.collect_set(F.when(F.col("parsed"), F.col("log_type"))).alias("_types"))
    kinds = F.filter(order, lambda t: F.array_contains(F.col("_types"), t))
    failed = F.col("total") - F.col("parsed")
    return agg.select("total", "parsed", failed.alias("failed"),
                      pct(F.col("parsed"), F.col("total")).alias("parsed_pct"), pct(failed, F.col("total")).alias("failed_pct"),
                      F.when(F.size(kinds) > 0, F.array_join(kinds, ", ")).otherwise(F.lit("不明なログ形式")).alias("log_types"))


def write_detections(dets: DataFrame, path: str, files_per_day: int = 16) -> None:
    """The detection list by day (``log_date``, ``unknown`` without a time).

    A run replaces the days that it holds and no other, each with one commit
    of the whole write; a day is dealt over ``files_per_day`` tasks.
    """
    day = F.coalesce(F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd"), F.lit("unknown"))
    (dets.withColumn("log_date", day)
     .repartition(F.col("log_date"), F.pmod(F.xxhash64("ip", "ord"), F.lit(files_per_day)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date").parquet(path))


def write_report(verdicts: DataFrame, stats: DataFrame, path: str, country: DataFrame | None = None) -> None:
    """Statistics, summary and ranked table as parquet plus a text form."""
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    threat_summary(verdicts).write.mode("overwrite").parquet(f"{path}/summary")
    ranked_lines = report_lines(ranked(verdicts), country)
    ranked_lines = ranked_lines.orderBy(F.desc("priority"), F.desc("count"), "first_ts_s", "first_ord", "ip", "reason_text")
    ranked_lines.write.mode("overwrite").parquet(f"{path}/ranked")
    ranked_lines.select("line").write.mode("overwrite").text(f"{path}/ranked_text")
