"""Signatures of profile ``core`` as data (T4, J4) and their matching by a term index.

A rule table (the columns of :func:`loghound.operators.patterns.pattern_library`)
becomes a :class:`RuleSet`.  Its distinct terms are looked for once per line
and level; every signature is then a test on the short list of terms that
were found.  The signatures stand in the plan as constant arrays, listed under
the terms that lead to them.  The terms are compiled tests up to ``MAX_TESTS``
of them and one constant array beyond that, so a large rule table does not
swell the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns

#: A rule table is configuration and stands in the plan: more rows than this are refused.
MAX_RULES = 20000
#: Up to this number of terms each one is an expression, which is compiled; more stand in one constant array.
MAX_TESTS = 2000
#: Characters that few texts hold: the terms with one of them are looked for only where it stands.
RARE_MARKS = "%()`$|;&<>\\*+@!{}[]'\",: "
#: Shell hits are numbered level * LEVEL_STEP + signature.
LEVEL_STEP = 1000


@dataclass(frozen=True)
class Signature:
    id: str
    cnf: tuple[tuple[str, ...], ...]
    unless: tuple[str, ...]
    suffix: str
    high: bool


@dataclass(frozen=True)
class RuleSet:
    sql: tuple[Signature, ...]
    shell: tuple[Signature, ...]
    traversal: tuple[Signature, ...]

    def __post_init__(self):
        if len(self.shell) > LEVEL_STEP:
            raise ValueError(f"at most {LEVEL_STEP} shell signatures")


def default_rules() -> RuleSet:
    """The built-in signatures."""
    def clauses(cnf):
        return tuple(tuple(c) for c in cnf)

    return RuleSet(
        tuple(Signature(i, clauses(cnf), tuple(unless), suffix, False)
              for i, _, cnf, unless, suffix in patterns.SQL_SIGNATURES),
        tuple(Signature(i, clauses(cnf), (), suffix, high) for i, _, cnf, suffix, high in patterns.SHELL_SIGNATURES),
        tuple(Signature(i, ((term,),), (), suffix, False) for i, _, term, suffix in patterns.TRAVERSAL_SIGNATURES))


def rules_of(library: DataFrame) -> RuleSet:
    """The rule set of a table: families sql, shell and traversal in the order of ``seq``, then pattern_id.

    Clauses without a term never hit; a signature without clauses is left out.
    """
    rows = (library.filter(F.col("family").isin("sql", "shell", "traversal") & (F.size("cnf") > 0))
            .select("pattern_id", "family", "seq", "cnf", "unless", "reason_suffix", "high_risk")
            .limit(MAX_RULES + 1).collect())
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows.sort(key=lambda r: (r["seq"], r["pattern_id"]))

    def of(family):
        return tuple(Signature(r["pattern_id"], tuple(tuple(t for t in c if t) for c in r["cnf"]),
                               tuple(t for t in r["unless"] or () if t), r["reason_suffix"] or "", bool(r["high_risk"]))
                     for r in rows if r["family"] == family)

    return RuleSet(of("sql"), of("shell"), of("traversal"))


def sql_text(value: str) -> str:
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values) -> Column:
    """A constant array of texts, as one expression."""
    return F.expr(f"cast(array({', '.join(map(sql_text, values))}) as array<string>)")


class Matcher:
    """Tests of a rule set on the terms that stand in a text.

    A signature hits only where a term of its key clause, the one with the
    longest shortest term, is found; so only the signatures that the found
    terms lead to are tested.
    """

    def __init__(self, rules: RuleSet):
        self.rules = rules
        every = [*rules.sql, *rules.shell, *rules.traversal]
        self.terms = sorted({t for s in every for c in (*s.cnf, s.unless) for t in c})
        self.number = {t: i for i, t in enumerate(self.terms)}

    def terms_in(self, column: str) -> Column:
        """Numbers of the terms that the text of a column contains."""
        if len(self.terms) > MAX_TESTS:
            # the column stands outside the lambda too, else its expression moves into it and is evaluated for every term
            table = F.expr("cast(array(" + ", ".join(
                f"named_struct('i', {i}, 't', {sql_text(t)})" for i, t in enumerate(self.terms)) + ") as array<struct<i:int,t:string>>)")
            found = F.filter(table, lambda t: F.col(column).contains(t["t"]))
            return F.when(F.length(F.col(column)) > 0, F.transform(found, lambda t: t["i"])).otherwise(F.array().cast("array<int>"))
        groups: dict[str | None, list[str]] = {}
        for t in self.terms:
            groups.setdefault(next((m for m in t if m in RARE_MARKS), None), []).append(t)
        parts = []
        for mark, terms in groups.items():
            tests = "array(" + ", ".join(f"if(contains({column}, {sql_text(t)}), {self.number[t]}, null)" for t in terms) + ")"
            parts.append(tests if mark is None else f"if(contains({column}, {sql_text(mark)}), {tests}, cast(array() as array<int>))")
        return F.expr(f"array_compact(concat(cast(array() as array<int>), {', '.join(parts)}))" if parts else "cast(array() as array<int>)")

    def _row(self, i: int, s: Signature, page_guarded: str | None) -> str:
        def ints(values):
            return f"cast(array({', '.join(str(self.number[v]) for v in values)}) as array<int>)"

        return (f"named_struct('i', {i}, 'cnf', array({', '.join(map(ints, s.cnf))}), 'unless', {ints(s.unless)}, "
                f"'page', {str(s.id == page_guarded).lower()})")

    def _candidates(self, signatures, page_guarded: str | None, terms: Column) -> Column:
        """The signatures whose key clause holds one of the terms."""
        row = "array<struct<i:int,cnf:array<array<int>>,unless:array<int>,page:boolean>>"
        always: list[str] = []
        by_term: dict[int, list[str]] = {}
        for i, s in enumerate(signatures):
            if not s.cnf:
                always.append(self._row(i, s, page_guarded))
            elif all(s.cnf):
                for t in set(max(s.cnf, key=lambda c: min(map(len, c)))):
                    by_term.setdefault(self.number[t], []).append(self._row(i, s, page_guarded))
        # a term without signatures has place 0, an empty list
        place = {t: n for n, t in enumerate(by_term, 1)}
        places = F.expr(f"cast(array({', '.join(str(place.get(t, 0)) for t in range(len(self.terms)))}) as array<int>)")
        lists = F.expr(f"cast(array(array(){''.join(f', array({", ".join(rows)})' for rows in by_term.values())}) as array<{row}>)")
        found = F.flatten(F.transform(terms, lambda t: F.get(lists, F.get(places, t))))
        return F.concat(F.expr(f"cast(array({', '.join(always)}) as {row})"), found) if always else found

    def hits(self, family: str, terms: Column, page_only: Column | None = None, page_guarded: str | None = None) -> Column:
        """Places of the signatures of a family that hit, rising; ``page_guarded`` misses where ``page_only`` holds."""
        def hit(s):
            good = F.forall(s["cnf"], lambda c: F.arrays_overlap(c, terms)) & ~F.arrays_overlap(s["unless"], terms)
            return good & ~(s["page"] & page_only) if page_only is not None else good

        found = F.transform(F.filter(self._candidates(getattr(self.rules, family), page_guarded, terms), hit), lambda s: s["i"])
        return F.when(F.size(terms) > 0, F.sort_array(F.array_distinct(found))).otherwise(F.array().cast("array<int>"))
