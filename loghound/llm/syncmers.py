"""Document fingerprints from closed syncmers, DataFrame functions only (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loghound.llm.common import prepare, stage, table

#: Tokens of an anchor (k-mer) and of the inner substrings that choose it; K is a multiple of S.
K = 6
S = 2
#: A token is a word of at most 24 characters; in longer runs without white space each character is one,
#: so a character put in or taken out changes the anchors about it only.
TOKEN = "(?<!\\S)\\S{1,24}(?!\\S)|\\S"
#: Smallest anchor hashes that a fingerprint keeps, whatever its text's length.
SKETCH = 64
#: All anchor hashes below this one, a sixteenth of all, are kept as well: the list grows with the text.
BELOW = -2 ** 63 + 2 ** 60
#: Consecutive doc_ids that are sorted together to find each document's neighbour.
BUCKET_IDS = 256


def inner_hashes(tokens: Column, s: int = S) -> Column:
    """Hash of each run of ``s`` tokens that starts at a token; null where fewer are left."""
    return F.transform(tokens, lambda x, i: F.when(
        i + s <= F.size(tokens), F.xxhash64(x, *[F.get(tokens, i + j) for j in range(1, s)])))


def anchors(inner: Column, k: int = K, s: int = S) -> Column:
    """Hashes of the closed syncmers from the inner hashes.

    A k-mer is one if the least of its inner substrings is its first or last.
    That depends on the k-mer alone, so equal text has equal anchors wherever
    it stands, and any ``k - s`` k-mers in a row hold at least one.  Each inner
    hash is compared with those after it (is it the least of the k-mer that it
    opens?) and before it (of the k-mer that it closes?) until one is less.
    """
    w = k - s + 1

    def least(x, others):
        test = x <= others[0]
        for y in others[1:]:
            test = test & (x <= y)
        return test

    def name(first):
        return F.xxhash64(*[F.get(inner, first + j) for j in range(0, k - s + 1, s)])

    opens = F.transform(inner, lambda x, i: F.when(
        least(x, [F.get(inner, i + j) for j in range(1, w)]), name(i)))
    closes = F.transform(inner, lambda x, i: F.when(
        least(x, [F.get(inner, i - j) for j in range(1, w)]), name(i - (w - 1))))
    return F.array_compact(F.concat(opens, closes))


def placed_anchors(inner: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers in text order, each with the number of its first token: array of (at, anchor)."""
    w = k - s + 1

    def at(x, i):
        run = [F.get(inner, i + j) for j in range(w)]
        low = F.least(*run)
        return F.when(run[-1].isNotNull() & ((run[0] == low) | (run[-1] == low)),
                      F.struct(i.cast("long").alias("at"), F.xxhash64(*run[::s]).alias("anchor")))

    return F.array_compact(F.transform(inner, at))


def smallest(hashes: Column, n: int = SKETCH, below: int = BELOW) -> Column:
    """The ``n`` smallest hashes and all that are less than ``below``, in order."""
    return F.filter(F.sort_array(F.array_distinct(hashes)), lambda h, i: (i < n) | (h < F.lit(below)))


def or_whole(hashes: Column, text: Column) -> Column:
    """A text without an anchor stands for itself; the empty text has no anchor at all."""
    return F.when((F.size(hashes) == 0) & (F.length(text) > 0), F.array(F.xxhash64(text))).otherwise(hashes)


def likeness(a: Column, b: Column, n: int = SKETCH, below: int = BELOW) -> Column:
    """Jaccard estimate of two sketches over the hashes up to which both are complete.

    A sketch of less than ``n`` hashes holds all of its text's, any other those
    up to its last one or ``below``.
    """
    def bound(x):
        return F.when(F.size(x) < n, F.lit(2 ** 63 - 1)).otherwise(F.greatest(F.element_at(x, -1), F.lit(below)))

    limit = F.least(bound(a), bound(b))
    union = F.size(F.filter(F.array_union(a, b), lambda h: h <= limit))
    common = F.size(F.filter(F.array_intersect(a, b), lambda h: h <= limit))
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def printed(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, bucket_ids: int = BUCKET_IDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """Add ``next_text`` and ``next_<c>`` of the next document in descending doc_id; after the last comes the first.

    The texts move once: rows are dealt by ranges of ``bucket_ids`` ids and
    sorted in these.  The last row of a range needs the first of the next
    range that has rows; a table of one id per range tells which rows these
    are, and copies of them go along.  Which ranges follow each other is found
    in two levels, so no task sorts more than the ranges of one super-range or
    one row per super-range.
    """
    bucket = F.coalesce(F.floor(F.col("doc_id") / bucket_ids), F.lit(-2 ** 62))
    d = docs.withColumn("bucket", bucket).withColumn("tie", F.xxhash64("text"))
    super_ = F.floor(F.col("bucket") / 4096)
    # struct order: a null doc_id is least, so it comes last in descending order
    tops = stage(d.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("top"))
                 .withColumn("super", super_))
    up = Window.partitionBy("super").orderBy("bucket")
    heads = (tops.groupBy("super").agg(F.min("bucket").alias("low"))
             .withColumn("above", F.lead("low").over(Window.orderBy("super"))))
    lowest = F.min("low").over(Window.partitionBy())
    heads = heads.withColumn("above", F.coalesce("above", lowest)).select("super", "above")
    # the range above uses the top of this one; the highest range's top closes the circle at the lowest
    asks = (tops.withColumn("into", F.lead("bucket").over(up)).join(heads, "super")
            .select(F.col("top.doc_id").alias("top_id"), F.col("top.tie").alias("top_tie"),
                    F.coalesce("into", "above").alias("into")))
    halo = (d.join(asks, d["doc_id"].eqNullSafe(asks["top_id"]) & (d["tie"] == asks["top_tie"]))
            .drop("bucket", "top_id", "top_tie").withColumnRenamed("into", "bucket").withColumn("halo", F.lit(1)))
    rows = d.withColumn("halo", F.lit(0)).unionByName(halo)
    order = Window.partitionBy("bucket").orderBy("halo", F.col("doc_id").desc_nulls_last(), F.desc("tie"))
    out = rows
    for c in ("text", *carried):
        out = out.withColumn(f"next_{c}", F.lead(c).over(order))
    return out.where("halo = 0").drop("bucket", "tie", "halo")


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, s: int = S, sketch: int = SKETCH) -> DataFrame:
    """Add the sketch of column ``text``; each step is a column of its own, so none is computed twice."""
    return (df.withColumn("_tokens", F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))
            .withColumn("_inner", inner_hashes(F.col("_tokens"), s)).drop("_tokens")
            .withColumn("_anchors", smallest(anchors(F.col("_inner"), k, s), sketch)).drop("_inner")
            .withColumn(name, or_whole(F.col("_anchors"), F.col(text))).drop("_anchors"))


def anchor_places(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """All anchors of every whole text with their places, for positional matching: (doc_id, anchor, at).

    ``at`` is the number of the anchor's first token.  A passage that stands in
    two texts has the same anchors in both, at places that differ by one number.

    Cases: a null or empty text and a text of less than ``k`` tokens have no
    rows; repeated rows give repeated rows; other columns are not read.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.regexp_extract_all(F.col("text").cast("string"), F.lit(TOKEN), F.lit(0)).alias("_tokens"))
            .select("doc_id", inner_hashes(F.col("_tokens"), s).alias("_inner"))
            .select("doc_id", F.explode(placed_anchors(F.col("_inner"), k, s)).alias("_a"))
            .select("doc_id", "_a.anchor", "_a.at"))


def fingerprints(docs: DataFrame, k: int = K, s: int = S, sketch: int = SKETCH,
                 bucket_ids: int = BUCKET_IDS) -> DataFrame:
    """Fingerprint of every text and of its edited text.

    The edited text has the last third replaced by the first characters of
    the next document (descending doc_id).  A fingerprint is the sorted list
    of the ``sketch`` smallest anchor hashes and of all below a fixed share; a
    text's own is made before the texts move.

    Cases: a null text is empty; the empty text has an empty fingerprint, and
    two of them are alike by 1; a text without an anchor stands for itself;
    equal doc_ids are ordered by a hash of the text, a null doc_id comes last;
    a single document is its own next one; an empty table gives no rows; other
    columns are not read.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = with_sketch(own, "text", "print", k, s, sketch).withColumn("n", F.length("text"))
    both = with_next(own, bucket_ids, ("print",)).withColumn("comes", F.floor(F.col("n") / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("comes")),
                      F.substring("next_text", F.lit(1), F.col("comes")))
    both = both.select("doc_id", "n", "print", "next_print", edited.alias("edited"))
    both = with_sketch(both, "edited", "edited_print", k, s, sketch)
    return both.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("print")).alias("fingerprint"), printed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print"), sketch).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print"), sketch).alias("near_next"))


def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fingerprints(table(spark, sf_dir, "documents"))
