"""File-level format guess and quality profile.

Both look at the head of each file only: the first lines in file order,
however many blank or comment lines stand between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.parse import classify_line

# --- fixed values: head sizes and thresholds of the profile ---
TYPE_HEAD_LINES = 20
QUALITY_HEAD_LINES = 10
WARN_BELOW_PCT = 50.0
WARN_MIN_CHECKED = 2
# --- end of fixed values ---


def _head(lines: DataFrame, n: int, skip_blank: bool) -> DataFrame:
    src = lines.filter(~F.col("value").rlike(r"^\s*(#|$)")) if skip_blank else lines
    first = Window.partitionBy("file_path").orderBy("file_block_start", "ord")
    # a limit on row_number is applied in every task before the shuffle: n rows of a file per split move
    return (src.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n)
            .select("file_path", "ord", "value"))


def file_log_type(lines: DataFrame) -> DataFrame:
    """Per file, counts of line classes in the first 20 lines and a type."""
    head = _head(lines, TYPE_HEAD_LINES, skip_blank=False).withColumn("cls", classify_line(F.col("value")))
    c = head.groupBy("file_path").agg(
        F.count_if(F.col("cls").isin("access_log", "timestamp_first_access_log")).alias("access"),
        F.count_if(F.col("cls").isin("error_log", "nginx_error_log")).alias("error"),
        F.count_if(F.col("cls") == "ssl_request_log").alias("ssl"),
        F.count_if(F.col("value").rlike(r"\s(TLSv[\d.]+|SSLv\d)\s+\S+\s*$")).alias("ssl_access"))
    a, e, s, sa = F.col("access"), F.col("error"), F.col("ssl"), F.col("ssl_access")
    kind = (F.when((s > 0) & (a == 0) & (e == 0), "ssl_request_log")
            .when((sa > 0) & (sa >= a), "ssl_access_log")
            .when((a > 0) & (e > 0), F.when(a >= e, "mixed_access_primary").otherwise("mixed_error_primary"))
            .when(a > 0, "access_log")
            .when(e > 0, "error_log")
            .otherwise("unknown"))
    return c.withColumn("log_type", kind)


def file_quality(lines: DataFrame) -> DataFrame:
    """Share of the first 10 non-blank lines in a known format."""
    head = _head(lines, QUALITY_HEAD_LINES, skip_blank=True).withColumn(
        "valid", classify_line(F.col("value")) != "unknown")
    agg = head.groupBy("file_path").agg(F.count(F.lit(1)).alias("checked"), F.count_if("valid").alias("valid"))
    pct = F.round(F.col("valid") * 100.0 / F.col("checked"), 1)
    verdict = (F.when(F.col("valid") == 0, "reject")
               .when((pct < WARN_BELOW_PCT) & (F.col("checked") > WARN_MIN_CHECKED), "warn")
               .otherwise("ok"))
    return agg.select("file_path", "checked", "valid", pct.alias("validity_pct"), verdict.alias("verdict"))
