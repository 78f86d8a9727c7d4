"""Verdict table that grows with the stream.

``foreachBatch`` keeps two tables below ``path``, each as one version per
batch (``batch_id=N``): the running counters (ip, rule, n, last_s) and the
verdicts of :func:`loghound.plans.core.verdict_parts`.  Batch N reads the
versions N - 1 and writes the versions N whole, so a batch that runs again
after a failure reads the same and writes the same: nothing counts twice.

Running numbers go on over batches in order of arrival, and by time within a
batch.  A counter whose client was silent for ``ttl_seconds`` before the
newest event is dropped; verdicts stay.  Old versions are kept:
any version but the newest two may be removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import requests_only
from ..plans import core
from ..plans.materialize import materialize
from .alerts import stream_requests

COUNTERS = "ip string, rule string, n bigint, last_s bigint"
TTL_SECONDS = 86400


def _version(path: str, name: str, batch_id: int) -> str:
    return f"{path}/{name}/batch_id={batch_id}"


def counters_at(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The counters after batch ``batch_id``; none before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], COUNTERS)
    return spark.read.schema(COUNTERS).parquet(_version(path, "counters", batch_id))


def verdict_parts_at(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(_version(path, "verdicts", batch_id)) if batch_id >= 0 else None


def verdicts_at(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The verdict table (columns of ``core.verdicts``) after batch ``batch_id``."""
    return core.verdict_rows(verdict_parts_at(spark, path, batch_id))


def merge_parts(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Verdicts of two disjoint sets of detections from the verdicts of each: one full join, no sort.

    The later severe detection counts, else the first one; counts of
    accumulating reasons add up, others give their greatest.
    """
    if old is None:
        return new
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.ip") == F.col("n.ip")) & F.col("o.acc").eqNullSafe(F.col("n.acc")), "full")
    same = F.col("o.ip").isNotNull() & F.col("n.ip").isNotNull()
    # the detection of the new part counts if the client is new, if it alone is severe, or if it is
    # the later of two severe or the earlier of two others
    later = F.col("n.pick") > F.col("o.pick")
    takes_new = (F.when(~same, F.col("o.ip").isNull())
                 .when(F.col("n.severe") != F.col("o.severe"), F.col("n.severe"))
                 .otherwise(F.when(F.col("n.severe"), later).otherwise(~later)))

    def of_pick(name):
        return F.when(takes_new, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    def either(name):
        return F.coalesce(f"o.{name}", f"n.{name}").alias(name)

    count = F.when(same & F.col("o.acc").isNotNull(), F.col("o.count") + F.col("n.count")).otherwise(
        F.greatest("o.count", "n.count")).alias("count")
    low = lambda c: F.least(f"o.{c}", f"n.{c}").alias(c)
    return both.select(either("ip"), either("acc"), count, low("first"), of_pick("pick"), of_pick("severe"),
                       of_pick("reason"), of_pick("reason_code"), low("first_s"),
                       F.greatest("o.last_s", "n.last_s").alias("last_s"))


def _add_counts(before: DataFrame, found: list[tuple[str, DataFrame]], newest: DataFrame, ttl_seconds: int) -> DataFrame:
    added = reduce(DataFrame.unionByName, [
        df.groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.max("ts_s").alias("last_s")).withColumn("rule", F.lit(rule))
        for rule, df in found])
    total = before.unionByName(added.select("ip", "rule", "n", "last_s")).groupBy("ip", "rule").agg(
        F.sum("n").alias("n"), F.max("last_s").alias("last_s"))
    # one row: the newest time of the batch
    return (total.join(F.broadcast(newest)).filter(
        F.col("_newest").isNull() | F.col("last_s").isNull() | (F.col("last_s") >= F.col("_newest") - ttl_seconds))
        .drop("_newest"))


def process_batch(parsed: DataFrame, batch_id: int, path: str, ttl_seconds: int = TTL_SECONDS) -> None:
    """Write version ``batch_id`` of counters and verdicts from version ``batch_id - 1`` and one batch of lines."""
    spark = parsed.sparkSession
    requests = materialize(requests_only(parsed), "batch")
    before = counters_at(spark, path, batch_id - 1)
    lines = materialize(core.line_detections(requests), "batch-detections")
    plain = lines.filter("kind = 'plain'").drop("kind")
    trv, auth = (lines.filter(F.col("kind") == k).drop("kind") for k in ("trv", "auth"))
    of = lambda rule: before.filter(F.col("rule") == rule)
    numbered = core.traversal_detections(trv, of("traversal"))
    failures = core.failure_detections(auth, of("auth"))
    cols = ["ip", "ts_s", "ord", "seq", "sub", "code", "reason", "count", "acc"]
    dets = reduce(DataFrame.unionByName, [d.select(*cols) for d in (plain, numbered, failures)]).withColumnsRenamed(
        {"code": "reason_code", "acc": "accumulate"})
    newest = requests.agg(F.max("ts_s").alias("_newest"))
    counters = _add_counts(before, [("traversal", trv), ("auth", auth)], newest, ttl_seconds)
    counters.write.mode("overwrite").parquet(_version(path, "counters", batch_id))
    merged = merge_parts(verdict_parts_at(spark, path, batch_id - 1), core.verdict_parts(dets))
    merged.write.mode("overwrite").parquet(_version(path, "verdicts", batch_id))


def start(spark: SparkSession, src_dir: str, path: str, checkpoint_dir: str, ttl_seconds: int = TTL_SECONDS,
          available_now: bool = False):
    """Keep the verdict table of the log files that arrive in ``src_dir``."""
    writer = (stream_requests(spark, src_dir).writeStream
              .foreachBatch(lambda batch, batch_id: process_batch(batch, batch_id, path, ttl_seconds))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
