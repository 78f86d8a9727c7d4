"""Signature detectors.

Profile ``core``: the raw url and one lenient decoding are lower-cased once,
the terms of the rule table are looked for once per level, and signatures are
tested on the terms found (:mod:`loghound.operators.rules`).

* SQL (D1) and traversal (D6): first hit in (level, signature) order.
* Shell (D4/D5): every hit on both levels.

Profiles ``fast``/``detailed`` (D2/D3/D7/D8) test regular-expression
alternations on the request text and its decoding levels.
"""

from __future__ import annotations

from functools import reduce
from re._constants import LITERAL
from re._parser import parse as parse_regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import decode_levels, url_decode_once
from .patterns import (SQL_REGEX_DETAILED, SQL_REGEX_EXTRA, SQL_REGEX_FAST, TRAVERSAL_REGEX_DETAILED,
                       TRAVERSAL_REGEX_EXTRA, TRAVERSAL_REGEX_FAST)
from .rules import LEVEL_STEP, Matcher, RuleSet, default_rules

# --- fixed values: guards of the signature detectors ---
GUARD_WORDS = ["not found", "error:", "failed", "denied", "invalid", "missing"]
PAGE_SUFFIXES = [".html", ".php", ".jsp", ".asp"]
PAGE_SQL_WORDS = ["where", "=", "table", "values"]
PAGE_GUARDED = "SQL-004"
# --- end of fixed values ---


def _any_in(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def with_levels(requests: DataFrame) -> DataFrame:
    """Project the two matching levels (raw, decoded) and their lower forms."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return requests.withColumn("_l0", url).withColumn("_l1", url_decode_once(url)).select(
        "*", F.lower(F.col("_l0")).alias("_lo0"), F.lower(F.col("_l1")).alias("_lo1"))


def _alternation(patterns) -> str:
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def _longest_literal(pattern: str) -> str | None:
    """The longest text that every match of a regular expression contains, or None."""
    best, run = "", ""
    for op, arg in parse_regex(pattern):
        if op is LITERAL:
            run += chr(arg)
            continue
        best, run = max(best, run, key=len), ""
    return max(best, run, key=len) or None


def _whole_literal(pattern: str) -> str | None:
    """The text that a regular expression without any operator stands for, or None."""
    parsed = list(parse_regex(pattern))
    return "".join(chr(arg) for _, arg in parsed) if all(op is LITERAL for op, _ in parsed) else None


def required_literals(patterns) -> list[str] | None:
    """Texts of which at least one stands in whatever one of the patterns matches.

    A text that contains another one of the list is left out, as the shorter
    one is found wherever it is.  None if some pattern needs no literal.
    """
    found = {_longest_literal(p) for p in patterns}
    if None in found:
        return None
    kept: list[str] = []
    for text in sorted(found, key=lambda t: (len(t), t)):
        if not any(k in text for k in kept):
            kept.append(text)
    return kept


def gated_match(text: Column, patterns) -> Column:
    """Does one of the patterns match?  Each is tried only on texts that hold a literal which it requires."""
    literals = required_literals(patterns)
    if literals is None:
        return text.rlike(_alternation(patterns))
    groups: dict[str, list[str]] = {k: [] for k in literals}
    for p in patterns:
        longest = _longest_literal(p)
        groups[next(k for k in literals if k in longest)].append(p)

    def test(literal: str, group: list[str]) -> Column:
        held = text.contains(literal)
        return held if literal in map(_whole_literal, group) else held & text.rlike(_alternation(group))

    return reduce(lambda a, b: a | b, [test(k, g) for k, g in groups.items()])


def shell_profile_hits(requests: DataFrame, detailed: bool) -> DataFrame:
    """``sql_rx`` / ``trv_rx`` booleans on the lower-cased request.

    fast: raw request and one decoding (only when it has ``%``);
    detailed: all decoding levels, distinct levels only (F2/F3).  Error lines
    have rules of their own (D19) and never hit here."""
    error = F.col("log_type").isin("error_log", "nginx_error_log")
    req = F.lower(F.coalesce(F.col("request"), F.col("url"), F.lit("")))
    df = requests.withColumns({"_error": error, "_request": req})
    if detailed:
        sql_rx = SQL_REGEX_DETAILED + SQL_REGEX_EXTRA
        trv_rx = TRAVERSAL_REGEX_DETAILED + TRAVERSAL_REGEX_EXTRA
        levels = F.transform(decode_levels(F.col("_request")), lambda x: F.lower(x))
    else:
        sql_rx, trv_rx = SQL_REGEX_FAST, TRAVERSAL_REGEX_FAST
        levels = F.array_distinct(F.array("_request", F.lower(url_decode_once(F.col("_request")))))
    df = df.withColumn("_levels", F.when(~F.col("_error"), levels))
    found = [(~F.col("_error") & F.exists("_levels", lambda x: gated_match(x, rx))).alias(name)
             for name, rx in (("sql_rx", sql_rx), ("trv_rx", trv_rx))]
    # one row each: a filter on the hits stays behind it and does not repeat the decoding and the matching
    return df.select(*requests.columns, F.inline(F.array(F.struct(*found))))


def core_signature_hits(requests: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Add ``sql_hit`` (place of the first SQL signature that hits, level by level, or NULL), ``shell_hits``
    (array of ``level * 1000 + place``), ``shell_high`` (high-risk hits) and ``trv_hit`` (first traversal place).

    The terms of the rules are looked for once per level, and on the decoded
    level only if decoding changed the text.  No text length suppresses a hit
    (D21 is left out: padding or brevity hid attacks)."""
    rules = rules or default_rules()
    match = Matcher(rules)
    df = with_levels(requests)
    is_err = F.col("log_type").isin("error_log", "nginx_error_log")
    df = df.withColumn("_t0", match.terms_in("_lo0"))
    same = F.col("_l1") == F.col("_l0")
    df = df.withColumn("_t1", F.when(same, F.col("_t0")).otherwise(match.terms_in("_lo1")))
    for lvl in (0, 1):
        raw, terms = F.col(f"_l{lvl}"), F.col(f"_t{lvl}")
        guarded = is_err & _any_in(raw, GUARD_WORDS)
        page_only = _any_in(raw, PAGE_SUFFIXES) & ~_any_in(raw, PAGE_SQL_WORDS)
        none = F.array().cast("array<int>")
        df = df.withColumns({f"_page{lvl}": page_only, f"_open{lvl}": ~guarded})
        found = {f"_sql{lvl}": F.when(F.col(f"_open{lvl}"), F.get(
                     match.hits("sql", terms, F.col(f"_page{lvl}"), PAGE_GUARDED), F.lit(0))),
                 f"_shell{lvl}": F.when(F.col(f"_open{lvl}"), match.hits("shell", terms)).otherwise(none),
                 f"_trv{lvl}": F.get(match.hits("traversal", terms), F.lit(0))}
        # a text that decoding left as it was has the hits of the raw level
        df = df.withColumns({n: F.when(same, F.col(f"{n[:-1]}0")).otherwise(c) for n, c in found.items()} if lvl else found)
    high = F.expr(f"cast(array({', '.join(str(i) for i, s in enumerate(rules.shell) if s.high)}) as array<int>)")
    hits = df.select("*", F.coalesce("_sql0", "_sql1").alias("sql_hit"), F.concat("_shell0", F.transform("_shell1", lambda i: i + LEVEL_STEP)).alias("shell_hits"),
                     F.coalesce("_trv0", "_trv1").alias("trv_hit"))
    hits = hits.withColumn("shell_high", F.size(F.filter("shell_hits", lambda h: F.array_contains(high, h % LEVEL_STEP))))
    return hits.select(*[c for c in hits.columns if c in requests.columns or not c.startswith("_")])
