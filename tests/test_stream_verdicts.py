import random

from pyspark.sql import functions as F

from conftest import lines_df
from loghound.operators.parse import parse_lines, requests_only
from loghound.plans import core
from loghound.plans.materialize import materialize
from loghound.streaming import verdicts as V

URLS = ["/start", "/read?f=../../etc/group", "/q?a=1%27%20union%20select%20x--", "/app/.env", "/x/phpunit/a/eval-stdin.php"]


def log(seed, n):
    """Lines in order of time; failures, traversals, plain and severe detections of six clients."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ip = f"198.51.100.{rng.choice([1, 1, 1, 2, 3, 4, 5, 6])}"
        h, m, s = i // 3600 % 24, i // 60 % 60, i % 60
        if rng.random() < 0.3:
            out.append(f"[Fri Aug 01 {h:02d}:{m:02d}:{s:02d} 2025] [error] [client {ip}] user bob not found: /a")
        else:
            out.append(f'{ip} - - [01/Aug/2025:{h:02d}:{m:02d}:{s:02d} +0000] "GET {rng.choice(URLS)} HTTP/1.1" 200 5')
    return out


def table(df):
    return sorted((r.ip, r["count"], r.reason, r.reason_code, r.priority, str(r.first_seen), str(r.last_seen))
                  for r in df.collect())


def whole(spark, lines):
    """The same detections over all lines at once."""
    req = materialize(requests_only(parse_lines(lines_df(spark, lines))), "requests")
    found = materialize(core.line_detections(req), "found")
    cols = ["ip", "ts_s", "ord", "seq", "sub", "code", "reason", "count", "acc"]
    parts = [found.filter("kind = 'plain'"), core.traversal_detections(found.filter("kind = 'trv'")),
             core.failure_detections(found.filter("kind = 'auth'"))]
    dets = parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols))
    return core.verdicts(dets.withColumnsRenamed({"code": "reason_code", "acc": "accumulate"}))


def batch(spark, lines, at):
    return parse_lines(lines_df(spark, lines).withColumn("ord", F.col("ord") + at))


def test_batches_give_the_whole_and_a_replay_changes_nothing(spark, tmp_path):
    lines, path = log(3, 120), str(tmp_path / "t")
    for n in range(3):
        V.process_batch(batch(spark, lines[n * 40:n * 40 + 40], n * 40), n, path)
    assert table(V.verdicts_at(spark, path, 2)) == table(whole(spark, lines))
    counters = sorted(tuple(r) for r in V.counters_at(spark, path, 2).collect())
    # the last batch runs again, as after a failure between its two writes
    V.process_batch(batch(spark, lines[80:], 80), 2, path)
    assert table(V.verdicts_at(spark, path, 2)) == table(whole(spark, lines))
    assert counters == sorted(tuple(r) for r in V.counters_at(spark, path, 2).collect())
    assert {r[1] for r in counters} == {"traversal", "auth"} and max(r[2] for r in counters) > 5


def test_silent_counters_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    fail = '[Fri Aug 01 {} 2025] [error] [client {}] user bob not found: /a'
    V.process_batch(batch(spark, [fail.format("00:00:01", "198.51.100.1"), fail.format("00:00:02", "198.51.100.2")], 0), 0, path, 600)
    V.process_batch(batch(spark, [fail.format("00:05:00", "198.51.100.2")], 10), 1, path, 600)
    assert {r.ip: r.n for r in V.counters_at(spark, path, 1).collect()} == {"198.51.100.1": 1, "198.51.100.2": 2}
    V.process_batch(batch(spark, [fail.format("00:11:00", "198.51.100.3")], 20), 2, path, 600)
    assert {r.ip: r.n for r in V.counters_at(spark, path, 2).collect()} == {"198.51.100.2": 2, "198.51.100.3": 1}
    assert V.verdicts_at(spark, path, 2).count() == 3


def test_stream_of_files(spark, tmp_path):
    lines, src = log(4, 90), tmp_path / "src"
    src.mkdir()
    for n in range(3):
        (src / f"{n}.log").write_text("\n".join(lines[n * 30:n * 30 + 30]) + "\n")
        q = V.start(spark, str(src), str(tmp_path / "t"), str(tmp_path / "ck"), available_now=True)
        q.awaitTermination(240)
        assert q.exception() is None
    assert table(V.verdicts_at(spark, str(tmp_path / "t"), 2)) == table(whole(spark, lines))
