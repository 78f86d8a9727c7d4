import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


def test_queries_match_duckdb_oracle():
    import compare_oracle
    assert compare_oracle.main("/root/testdata/sf0.001",
                               {"parse_requests", "high_frequency", "client_errors", "verdicts"})
