"""Log files as DataFrames of lines (S1-S3, S8 input side).

``spark.read.text`` splits files across tasks (``.gz`` and many files come
for free).  A line keeps ``file_path`` and the byte offset of its split, from
which :func:`ordered_lines` restores the order of all lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the table of splits up to which it is broadcast (about 100 bytes each).
MAX_BROADCAST_SPLITS = 1_000_000


def read_log_lines(spark: SparkSession, paths, stream: bool = False) -> DataFrame:
    """Lines with ``file_path``, ``file_block_start``, ``ord`` and ``value``.

    The order key is ``(file_path, file_block_start, ord)``, and ``ord`` alone
    depends on how the files were split; :func:`ordered_lines` makes it the
    place of the line over all files, which does not.
    """
    if isinstance(paths, str):
        paths = [paths]
    if stream:
        raw = reduce(DataFrame.unionByName, [_columns(spark.readStream.format("text").load(p)) for p in paths])
    else:
        raw = _columns(spark.read.format("text").load(paths))
    return raw


def _columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        F.monotonically_increasing_id().alias("ord"),
        F.col("value"),
    )


def ordered_lines(lines: DataFrame, broadcast_splits: int = MAX_BROADCAST_SPLITS) -> DataFrame:
    """``ord`` becomes 0, 1, ... over all lines: by file path, then by place in the file.

    A task reads the lines of a split one after the other, so a line's place
    in its split is its running id less the least one of the split.  Only one
    row per split is counted and summed up: within each file, then over the
    files.  The result is the same for any split size and file listing.  The
    table of splits is broadcast up to ``broadcast_splits`` rows, and joined
    by a shuffle beyond it.  Use it on the lines as read, before any filter.
    """
    key = ["file_path", "file_block_start"]
    splits = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"))
    in_file = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_in_file", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
    files = splits.groupBy("file_path").agg(F.sum("_n").alias("_all"))
    over_files = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.withColumn("_before", F.coalesce(F.sum("_all").over(over_files), F.lit(0)))
    starts = splits.join(files, "file_path").select(
        *key, (F.col("_before") + F.col("_in_file") - F.col("_first")).alias("_shift")).checkpoint()
    if starts.count() <= broadcast_splits:
        starts = F.broadcast(starts)
    return lines.join(starts, key).withColumn("ord", F.col("ord") + F.col("_shift")).select(*lines.columns)


def line_flags(lines: DataFrame) -> DataFrame:
    """S3: blank/comment flag, rows kept for statistics; a line of any length stays whole."""
    v = F.col("value")
    return lines.select(
        "*",
        v.rlike(r"^\s*(#|$)").alias("blank_or_comment"),
    )
