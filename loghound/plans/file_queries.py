"""Registered queries over log files: Spark writes them from ``events``, lines that fail included."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import synthetic
from . import oracle as O
from .materialize import materialize
from .report_job import analyse

_FILES: dict = {}


def log_files(spark: SparkSession, sf_dir: str, files: int = 7) -> str:
    """Folder of text files whose lines, by file name and place, are those of ``events`` by event_id,
    each followed by the failing lines of its event."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILES:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loghound-files-{uuid.uuid4().hex}"
        good = synthetic.log_lines(spark, sf_dir).select((F.col("ord") * 2).alias("ord"), "value")
        bad = synthetic.failing_lines(spark, sf_dir).select((F.col("ord") * 2 + 1).alias("ord"), "value")
        (good.unionByName(bad).repartitionByRange(files, "ord").sortWithinPartitions("ord").select("value")
         .write.text(path))
        _FILES[key] = path
    return _FILES[key]


def q_files_to_report(spark, sf_dir) -> DataFrame:
    """The verdicts of a run over files, read from what it has written."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loghound-report-{uuid.uuid4().hex}"
    analyse(spark, log_files(spark, sf_dir), out)
    ranked = spark.read.parquet(f"{out}/ranked")
    return ranked.select("ip", F.col("priority").cast("bigint").alias("priority"), "count", "count_text", "reason_text")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.parse import parse_lines
    from ..sources.text import read_log_lines
    return materialize(parse_lines(read_log_lines(spark, log_files(spark, sf_dir))), "parsed-files")


def q_file_stats(spark, sf_dir) -> DataFrame:
    from ..operators.report import parse_stats
    return parse_stats(_parsed(spark, sf_dir))


def q_reject_reasons(spark, sf_dir) -> DataFrame:
    from ..operators.parse import rejects
    return rejects(_parsed(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def q_file_profile(spark, sf_dir) -> DataFrame:
    """S4 + S5 over all files: files and checked lines per type and verdict."""
    from ..sources.profile import file_log_type, file_quality
    from ..sources.text import read_log_lines
    lines = read_log_lines(spark, log_files(spark, sf_dir))
    both = file_log_type(lines).join(file_quality(lines), "file_path")
    return both.groupBy("log_type", "verdict").agg(
        F.count(F.lit(1)).alias("files"), F.sum("checked").cast("bigint").alias("checked"))


QUERIES = {
    "files_to_report": q_files_to_report,
    "file_stats": q_file_stats,
    "reject_reasons": q_reject_reasons,
    "file_profile": q_file_profile,
}


def oracle_sql() -> dict[str, str]:
    label = "CASE WHEN priority >= 8 THEN '[高]' WHEN priority >= 5 THEN '[中]' ELSE '[低]' END"
    kinds = synthetic.FAILING
    failing = " UNION ALL ".join(f"SELECT {O.q(reason)} AS reason FROM events WHERE event_id % {m} = 0" for m, reason, _ in kinds)
    return {
        "files_to_report": O.with_all(f"""SELECT ip, CAST(priority AS BIGINT) AS priority, count,
            CASE WHEN count > 0 THEN CAST(count AS VARCHAR) || '回' ELSE '-' END AS count_text,
            CASE WHEN length(lbl || ' ' || reason) > 58 THEN left(lbl || ' ' || reason, 55) || '...'
                 ELSE lbl || ' ' || reason END AS reason_text FROM (SELECT *, {label} AS lbl FROM verdict)"""),
        "file_stats": O.with_all(f"""SELECT g + b AS total, g AS parsed, b AS failed, round(g * 100.0 / (g + b), 1) AS parsed_pct,
            round(b * 100.0 / (g + b), 1) AS failed_pct, log_types
            FROM (SELECT count(*) AS g, array_to_string(list_filter(['access_log', 'error_log', 'ssl_request_log'],
                    lambda t: list_contains(list(DISTINCT log_type), t)), ', ') AS log_types FROM req),
                 (SELECT count(*) AS b FROM ({failing}))""", ("base",)),
        "reject_reasons": f"SELECT reason, count(*) AS lines FROM ({failing}) GROUP BY reason",
    }
