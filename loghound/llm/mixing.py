"""Mixing sources to target weights by Pareto order sampling (operator 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loghound.llm.common import add_order, prepare, stage, table, word_count

WEIGHTS = (3, 1, 2)
RATE = 1.5
CAP = 2.0
#: Inclusion odds grow with size ** POWER.
POWER = 0.5
#: Rows that one bucket of the ranking holds on average.
BUCKET_ROWS = 5000
SEED = 20231


def source_targets(sources: DataFrame, weights=WEIGHTS, rate: float = RATE, cap: float = CAP) -> DataFrame:
    """Add ``target`` to rows (source, source_size).

    Weights repeat over the sources by code point, null last.  Together the
    sources get ``rate`` times all sizes; a target stops at ``cap`` times its
    source and the excess is shared again by weight until none is above.  Each
    round needs two sums of the whole table, never its rows.
    """
    ordered = add_order(sources, [F.col("source").asc_nulls_last()], "pos")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("pos") % len(weights) + 1).cast("int"))
    s = stage(ordered.withColumn("weight", weight.cast("long")).drop("pos"))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap * F.col("source_size")
        full, share = s.agg(F.sum(F.when(above, F.col("source_size")).otherwise(0)),
                            F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        new = (rate * total - cap * (full or 0)) / share if share else None
        if new is None or (level is not None and new <= level):
            break
        level = new
    if level is None:
        return s.withColumn("target", F.lit(0.0))
    return s.withColumn("target", F.least(F.col("weight") * F.lit(level), cap * F.col("source_size")).cast("double"))


def pareto_mix(docs: DataFrame, weights=WEIGHTS, rate: float = RATE, cap: float = CAP,
               power: float = POWER, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
               with_text: bool = False) -> DataFrame:
    """Copies of each document in a mix of the sources.

    Needs ``doc_id``, ``source`` and ``text``; other columns are not read.
    First every document of a source gets ``floor(target / source_size)``
    whole copies.  The words still missing come from one more copy of some
    documents: the inclusion chance of a document is ``min(1, c * size **
    power)`` with ``c`` solved per source so that the expected words are the
    missing ones, and documents are taken in the order of
    ``odds(u) / odds(chance)`` (Pareto order sampling) while they fit.  The
    last gap is closed by the one left document whose size is nearest to it.

    The order is cut by a histogram of the ranking variable, summed before the
    shuffle; only the bucket in which the cut lies is sorted, so a source with
    a third of all rows is no single task.

    Cases: text null or without words has size 0 and ``taken`` 0; a null source
    is a source of its own, last in order; repeated rows are documents of their
    own (equal rows tie, whichever is taken the result rows are the same); an
    empty table gives no rows; ``u`` is a hash of doc_id and ``seed``, so
    reruns agree.

    Returns doc_id, source, size, source_size, target, copies, taken; with
    ``with_text`` also ``text_hash``.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    d = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                          word_count(F.col("text")).alias("size"),
                          *([F.xxhash64(F.col("text").cast("string")).alias("text_hash")] if with_text else []))
              .withColumn("key", key).withColumn("row", F.monotonically_increasing_id()))
    src = source_targets(d.groupBy("key", "source").agg(F.sum("size").alias("source_size"),
                                                        F.count(F.lit(1)).alias("n")), weights, rate, cap)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0)
    src = stage(src.withColumn("base", base.cast("long"))
                .withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size"))))

    # c per source: the k largest sizes are certain, the others share the rest in proportion
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    sizes = d.where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = (sizes.withColumn("words", F.col("n") * F.col("size"))
             .withColumn("part", F.col("words") * F.pow("size", F.lit(power)))
             .withColumn("certain", F.sum("words").over(down) - F.col("words"))
             .withColumn("rest", F.sum("part").over(Window.partitionBy("key").orderBy("size")))
             .join(src.select("key", "missing"), "key")
             .withColumn("c", (F.col("missing") - F.col("certain")) / F.col("rest")))
    solved = (sizes.where(F.col("c") * F.pow("size", F.lit(power)) <= 1)
              .groupBy("key").agg(F.max_by("c", "size").alias("c")))
    par = stage(src.join(solved, "key", "left").fillna(0.0, ["c"]))

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / F.lit(2.0 ** 53)
    chance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c")) * F.pow("size", F.lit(power)))
    ranked = (d.join(par.select("key", "source_size", "target", "base", "missing", "c",
                                F.greatest(F.lit(16), F.ceil(F.col("n") / bucket_rows)).alias("buckets")), "key")
              .withColumn("u", u).withColumn("p", chance)
              # Q / (1 + Q) of the ranking variable Q: the same order, within 0 and 1
              .withColumn("q", F.col("u") * (1 - F.col("p")) /
                          (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p")))
              .withColumn("bucket", F.least(F.col("buckets") - 1, F.floor(F.col("q") * F.col("buckets")))))
    ranked = ranked.withColumn("open", (F.col("size") > 0) & (F.col("missing") > 0))
    cum = (ranked.where("open").groupBy("key", "missing", "bucket").agg(F.sum("size").alias("w"))
           .withColumn("upto", F.sum("w").over(Window.partitionBy("key").orderBy("bucket"))))
    cut = stage(cum.where("upto > missing").groupBy("key")
                .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("w")).alias("before"))).alias("cut"))
                .select("key", F.col("cut.bucket").alias("cut"), "cut.before"))
    at = ranked.join(cut, "key", "left").withColumn(
        "side", F.when(~F.col("open"), F.lit(1)).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), F.lit(-1))
        .when(F.col("bucket") == F.col("cut"), F.lit(0)).otherwise(F.lit(1)))
    order = Window.partitionBy("key").orderBy("q", "doc_id", "size", "row")
    edge = stage(at.where("side = 0").withColumn("words", F.col("before") + F.sum("size").over(order))
                 .select("key", "row", "size", "missing", "before", "words", "q", "doc_id"))
    inside = edge.where("words <= missing").select("row", F.lit(True).alias("inside"))
    gap = edge.groupBy("key").agg((F.first("missing") - F.greatest(
        F.first("before"), F.max(F.when(F.col("words") <= F.col("missing"), F.col("words"))))).alias("gap"))
    at = at.join(inside, "row", "left").withColumn("inside", (F.col("side") < 0) | F.coalesce("inside", F.lit(False)))
    left = at.where("open and not inside").join(gap, "key").withColumn("off", F.abs(F.col("size") - F.col("gap")))
    closing = (left.where("off < gap").groupBy("key").agg(F.min(F.struct("off", "q", "doc_id", "row")).alias("m"))
               .select(F.col("m.row").alias("row"), F.lit(True).alias("closes")))
    out = at.join(closing, "row", "left")
    extra = F.when(F.col("inside") | F.coalesce("closes", F.lit(False)), 1).otherwise(0)
    return (out.withColumn("copies", F.when(F.col("size") > 0, F.col("base") + extra).otherwise(0).cast("long"))
            .select("doc_id", "source", F.col("size").cast("long").alias("size"),
                    F.col("source_size").cast("long").alias("source_size"), "target", "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), *(["text_hash"] if with_text else [])))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`pareto_mix` takes it; all columns stay."""
    taken = pareto_mix(docs, with_text=True, **options)
    total = taken.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    total = total.where("_copies > 0").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    text_hash = F.xxhash64(F.col("text").cast("string"))
    rows = docs.withColumn("_at", text_hash)
    rows = rows.join(total, rows["doc_id"].cast("long").eqNullSafe(total["_id"]) & (rows["_at"] == total["_hash"]))
    # rows that are equal in doc_id and text share their copies evenly
    order = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("source"))
    copies = (F.floor(F.col("_copies") / F.col("_rows"))
              + F.when(F.row_number().over(order) <= F.col("_copies") % F.col("_rows"), 1).otherwise(0))
    return (rows.withColumn("_n", copies.cast("int")).where("_n > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pareto_mix(table(spark, sf_dir, "documents"))
