from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loghound.operators.windows import trailing_failures


def brute(rows):
    out = {}
    for t in {t for _, t in rows}:
        near = [(ip, x) for ip, x in rows if t - 600 <= x <= t]
        out[t] = (len(near), len({ip for ip, _ in near}))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "ip string, ts_s bigint")
    return {r.ts_s: (r.w_failures, r.w_ips) for r in trailing_failures(df).collect()}


def test_nothing_later_counts_and_edges(spark):
    rows = [(f"10.0.0.{i}", 1000) for i in range(10)] + [("10.0.0.99", 1598), ("10.0.0.98", 1601)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[1000] == (10, 10) and got[1598] == (11, 11) and got[1601] == (2, 2)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(0, 9000)), min_size=1, max_size=60))
def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)
