import random

import pytest
from pyspark.sql import functions as F

from conftest import lines_df
from loghound.operators import rules as R
from loghound.operators.parse import parse_lines, requests_only
from loghound.operators.patterns import pattern_library
from loghound.operators.signatures import core_signature_hits
from loghound.plans import core
from loghound.plans.materialize import materialize


def requests(spark, urls):
    lines = [f'198.51.100.7 - - [01/Aug/2025:10:00:00 +0000] "GET {u} HTTP/1.1" 200 5' for u in urls]
    return materialize(requests_only(parse_lines(lines_df(spark, lines))), "rules-test")


def test_the_table_gives_the_built_in_rules(spark):
    assert R.rules_of(pattern_library(spark)) == R.default_rules()


def test_a_replaced_pattern_changes_the_result(spark):
    req = requests(spark, ["/shop?x=frobnicate", "/q?a=union+select", "/read?f=../../a"])
    table = pattern_library(spark)
    new = spark.createDataFrame(
        [("OWN-1", "sql", 500, [["frob"], ["nicate", "zzz"]], ["harmless"], None, "own", "own words", False)], table.schema)
    changed = table.filter("pattern_id <> 'SQL-001' AND family <> 'traversal'").unionByName(new)

    def codes(rules):
        return {(r.ord, r.code, r.reason) for r in core.line_detections(req, rules=rules).collect() if r.seq in (3, 5)}

    before, after = codes(None), codes(R.rules_of(changed))
    assert {c for o, c, _ in before if o == 1} == {"SQL-001"} and any(o == 2 for o, _, _ in before)
    assert (0, "OWN-1", "SQLインジェクション攻撃の可能性 (own words)") in after
    assert not [c for o, c, _ in after if c == "SQL-001" or o == 2]


def test_hits_against_plain_tests(spark):
    """Every signature on every level, tried one by one."""
    rng = random.Random(2)
    rules = R.default_rules()
    terms = sorted({t for s in (*rules.sql, *rules.shell, *rules.traversal) for c in s.cnf for t in c if " " not in t and '"' not in t
                    and "\\" not in t and "%" not in t})
    urls = ["/" + "x".join(rng.choice(terms) for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["/a%2e%2e%2fb", "/"]
    req = requests(spark, urls)

    def hit(s, text):
        return all(any(t in text for t in c) for c in s.cnf) and not any(u in text for u in s.unless)

    for r in core_signature_hits(req, rules).collect():
        levels = [r.url.lower(), r.url.replace("%2e", ".").replace("%2f", "/").lower()] if "%2e" in r.url else None
        if levels is None and "%" in r.url:
            continue
        levels = levels or [r.url.lower()] * 2
        page = any(w in r.url for w in (".html", ".php", ".jsp", ".asp")) and not any(w in r.url for w in ("where", "=", "table", "values"))
        shell = [n * R.LEVEL_STEP + i for n, t in enumerate(levels) for i, s in enumerate(rules.shell) if hit(s, t)]
        sql = [i for t in levels for i, s in enumerate(rules.sql) if hit(s, t) and not (s.id == "SQL-004" and page)]
        trv = [i for t in levels for i, s in enumerate(rules.traversal) if hit(s, t)]
        assert (r.shell_hits, r.sql_hit, r.trv_hit) == (shell, sql[0] if sql else None, trv[0] if trv else None), r.url
        assert r.shell_high == sum(rules.shell[h % R.LEVEL_STEP].high for h in shell)


def test_size_of_the_table_is_checked(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_RULES", 3)
    with pytest.raises(ValueError):
        R.rules_of(pattern_library(spark))


def test_a_table_without_rules_finds_nothing(spark):
    req = requests(spark, ["/q?a=union+select"])
    none = R.rules_of(pattern_library(spark).limit(0))
    assert core.line_detections(req, rules=none).filter(F.col("seq").isin(3, 4, 5)).count() == 0
