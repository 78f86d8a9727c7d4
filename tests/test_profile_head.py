import tempfile

from loghound.sources.profile import file_quality
from loghound.sources.text import read_log_lines


def test_head_after_many_comments(spark):
    d = tempfile.mkdtemp(prefix="lh-head-")
    line = '198.51.100.7 - - [12/Mar/2024:09:15:30 +0000] "GET /a HTTP/1.1" 200 5'
    with open(f"{d}/a.log", "w") as f:
        f.write("\n".join(["junk"] + ["# note"] * 600 + [line] * 20) + "\n")
    q = file_quality(read_log_lines(spark, f"{d}/*.log")).collect()[0]
    assert (q.checked, q.valid, q.verdict) == (10, 9, "ok")
