"""From log files to the report in one call: read, order, parse, detect, judge, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import report
from ..operators.geo import ip_country
from ..operators.parse import parse_lines, rejects
from ..operators.rules import RuleSet
from ..sources.profile import file_log_type, file_quality
from ..sources.text import ordered_lines, read_log_lines
from . import core
from .materialize import materialize


@dataclass(frozen=True)
class Report:
    """The tables of one run."""

    parsed: DataFrame
    detections: DataFrame
    verdicts: DataFrame
    stats: DataFrame
    rejects: DataFrame
    log_types: DataFrame
    quality: DataFrame


def analyse(spark: SparkSession, paths, out: str | None = None, rules: RuleSet | None = None,
            blocks: DataFrame | None = None, names: DataFrame | None = None) -> Report:
    """Run profile core over log files.

    ``paths`` is one path or several; the order of lines over all of them is
    by path and place in the file, whatever the split size.  With ``out`` the
    report goes below it: ``detections`` by day (S7), ``rejects``, ``files``
    (S4, S5), ``stats``, ``summary``, ``ranked`` and ``ranked_text`` (S6).
    ``rules`` replaces the signatures, ``blocks`` and ``names`` give the
    countries of the clients (J1, J2).
    """
    lines = read_log_lines(spark, paths)
    parsed = materialize(parse_lines(ordered_lines(lines)), "parsed")
    dets = materialize(core.detections(parsed, rules=rules), "detections")
    found = Report(parsed, dets, core.verdicts(dets), report.parse_stats(parsed), rejects(parsed),
                   file_log_type(lines), file_quality(lines))
    if out:
        report.write_detections(dets, f"{out}/detections")
        found.rejects.write.mode("overwrite").parquet(f"{out}/rejects")
        found.log_types.join(found.quality, "file_path", "left").write.mode("overwrite").parquet(f"{out}/files")
        country = ip_country(found.verdicts, blocks, names) if blocks is not None else None
        report.write_report(found.verdicts, found.stats, out, country)
    return found
