"""Inputs of the registered queries: log data derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.parse import parse_lines
from ..sources import synthetic
from .materialize import materialize


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.log_lines(spark, sf_dir, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines parsed (``parsed`` flag kept), written once and read back."""
    return materialize(parse_lines(lines(spark, sf_dir)), "parsed")
