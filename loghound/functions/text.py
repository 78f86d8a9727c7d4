"""Scalar text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize(c: Column) -> Column:
    """Every character outside printable ASCII becomes ``?``."""
    return F.regexp_replace(c, r"[^\x20-\x7e]", "?")


def prefix_int(c: Column, type_: str = "bigint") -> Column:
    """leading integer of a text (``atoi``-like), NULL when there is none."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast(type_)


def pct(part: Column, whole: Column) -> Column:
    """share in percent with one decimal, 0.0 for an empty whole."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1)).otherwise(F.lit(0.0))


def threat_level_tag(reason: Column) -> Column:
    """``[CRITICAL]``/``[HIGH]``/``[LOW]`` tag in a reason, MEDIUM otherwise."""
    tag = F.regexp_extract(reason, r"\[(CRITICAL|HIGH|LOW)\]", 1)
    return F.when(tag == "", F.lit("MEDIUM")).otherwise(tag)


def clip_display(text: Column, width: int = 58) -> Column:
    """cut a display text at ``width`` characters, ending in ``...``."""
    return F.when(F.length(text) > width,
                  F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def count_display(n: Column) -> Column:
    """``N回`` for a positive count, ``-`` otherwise."""
    return F.when(n > 0, F.concat(n.cast("string"), F.lit("回"))).otherwise(F.lit("-"))
