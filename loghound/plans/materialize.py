"""Lineage cuts: intermediate tables written to the shared checkpoint folder.

Parsing is the widest projection of the job and every detector branch reads
its output, so the parsed requests are written once as parquet (columnar,
so each later branch reads only its columns and gets ``PushedFilters``) and
read back.  The folder comes from ``spark.checkpoint.dir`` (set by the
cluster); a fresh sub-folder is used per table, nothing is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/loghound-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
