import tempfile

from loghound.sources.profile import file_log_type, file_quality
from loghound.sources.text import read_log_lines


def test_file_profiles(spark):
    d = tempfile.mkdtemp(prefix="lh-prof-")
    access = '1.2.3.4 - - [01/Aug/2025:10:00:01 +0000] "GET /a HTTP/1.1" 200 5'
    error = '[Sat Aug 09 14:26:02 2025] [error] [client 1.2.3.4] File does not exist: /x'
    with open(f"{d}/a.log", "w") as f:
        f.write("\n".join([access] * 25) + "\n")
    with open(f"{d}/b.log", "w") as f:
        f.write("\n".join([error] * 3 + [access] * 2 + ["junk"] * 30) + "\n")
    with open(f"{d}/c.log", "w") as f:
        f.write("\n".join(["# comment", "", "junk", "more junk"]) + "\n")
    lines = read_log_lines(spark, f"{d}/*.log")
    types = {r.file_path.split("/")[-1]: r.log_type for r in file_log_type(lines).collect()}
    assert types == {"a.log": "access_log", "b.log": "mixed_error_primary", "c.log": "unknown"}
    q = {r.file_path.split("/")[-1]: (r.checked, r.valid, r.verdict) for r in file_quality(lines).collect()}
    assert q["a.log"] == (10, 10, "ok")
    assert q["b.log"] == (10, 5, "ok")
    assert q["c.log"] == (2, 0, "reject")
