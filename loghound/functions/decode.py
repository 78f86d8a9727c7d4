"""Percent-decoding as Column expressions (F1-F3), no Python UDF.

The lenient decoder of the log model turns ``%hh`` into that byte, copies a
``%`` that is not followed by two hex digits, and keeps ``+`` as is.  Spark's
``try_url_decode`` is strict (it rejects a bare ``%`` and maps ``+`` to a
blank), so the input is first protected: ``+`` -> ``%2B`` and a bad ``%`` ->
``%25``; then the strict decoder yields exactly the lenient result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_decode_once(c: Column) -> Column:
    """one lenient decoding pass; rows without ``%`` skip the work."""
    protected = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(protected), c)).otherwise(c)


def decode_levels(c: Column) -> Column:
    """``array(raw, decode^1, decode^2, ...)``, decoded until nothing
    changes, with equal neighbours removed.  A pass shortens the text by two
    characters at least, which bounds the passes."""
    encoded = "%[0-9A-Fa-f]{2}"
    passes = F.when(c.rlike(encoded), F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(c) / 2).cast("int")))
                    ).otherwise(F.array().cast("array<int>"))

    def step(state, _):
        return F.when(state["last"].isNull(), state).otherwise(advance(state["levels"], url_decode_once(state["last"])))

    def advance(levels, text):
        # a text without %hh ends the work: the passes that are left look at a null only
        return F.struct(F.array_append(levels, text).alias("levels"),
                        F.when(text.rlike(encoded), text).alias("last"))

    start = F.struct(F.array(c).alias("levels"), c.alias("last"))
    return F.array_distinct(F.aggregate(passes, start, step, lambda state: state["levels"]))
