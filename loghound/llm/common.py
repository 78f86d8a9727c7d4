"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loghound.session import ensure_checkpoint_dir

#: A word: a maximal run of anything but blank and the five ASCII white-space controls.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows per Arrow batch handed to Python workers; bounds the memory of a worker.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Session settings that these operators rely on (SQL settings only)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage on storage that every executor sees, and gives the
    optimizer the true size of the data for its choice of join.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # what the write has shuffled is no longer needed: let Spark's cleaner drop the files
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by :func:`stage` that nothing reads any more.

    Only once all that was made of them is itself written: a lost executor then
    never asks for them again.
    """
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        if not folder.getName().startswith("stage-"):
            raise ValueError(f"not a table of stage(): {folder}")
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def add_order(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """Number the rows 0, 1, ... in the order ``by`` without a single-task window.

    The rows are range-partitioned and written; each partition is numbered on
    its own and shifted by the row counts of the partitions before it.  Only
    one row per partition goes through the window that adds up the counts.
    """
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = stage(df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()))
    before = (part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(
                  Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("_n"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return (part.withColumn("_within", within).join(before, "_part")
            .withColumn(name, (F.col("_before") + F.col("_within")).cast("long"))
            .drop("_part", "_before", "_within"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: rows (node, root), root the smallest node.

    Every round gives each node the smallest node among itself and its
    neighbours, contracts the edges to these and drops loops and repeats, so
    that the edge table shrinks geometrically.  Nodes without an edge do not
    appear.  The aggregates combine before the shuffle, so a hub is no hot task.
    """
    # tables that shrink are read with many partitions otherwise
    e = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    roots = None
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")))
        if roots is None:
            roots = low.select(F.col("a").alias("node"), F.col("low").alias("root"))
        else:
            roots = stage(roots.join(low.withColumnRenamed("a", "root"), "root", "left")
                          .select("node", F.coalesce("low", "root").alias("root")))
        e = stage(e.join(low.withColumnRenamed("low", "la"), "a")
                  .join(low.select(F.col("a").alias("b"), F.col("low").alias("lb")), "b")
                  .select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct())
    if roots is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
