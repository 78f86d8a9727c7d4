"""Which documents keep_one() holds against each other, and that no link is lost by it."""
import random

import numpy as np

from loghound.llm import jaccard
from loghound.llm.hashing import mix

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)]


def groups(spark, monkeypatch, rows):
    """The ids that keep_one() keeps and the sizes of the groups whose pairs it looks at."""
    sizes, components = [], jaccard.components

    def watched(*args):
        out = components(*args)
        if not sizes:
            sizes.extend(r["count"] for r in out.groupBy("root").count().collect())
        return out

    monkeypatch.setattr(jaccard, "components", watched)
    got = [r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    return sorted(got, key=str), sorted(sizes)


def linked(rows):
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(i) for i in sets}, key=str)


def test_a_common_passage_ties_no_unlike_documents(spark, monkeypatch):
    rng = random.Random(5)
    passage = words(rng, 24)
    rows = []
    for i in range(400):
        own = words(rng, 300)
        at = rng.randrange(300)
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
    for i in range(20):  # near copies
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "other"
        rows.append((1000 + i, " ".join(w)))
    got, sizes = groups(spark, monkeypatch, rows)
    assert got == sorted(range(400), key=str)
    # the pairs, and at most a few by chance: not a group that holds a fixed share of all documents
    assert sum(sizes) < 100 and sizes[-1] <= 10


def test_links_at_the_limit_are_found_among_common_passages(spark, monkeypatch):
    rng = random.Random(6)
    passages = [words(rng, 30) for _ in range(3)]
    rows = []
    for i in range(120):
        n = rng.choice([6, 9, 14, 25, 40, 70, 150, 260, 500])
        w = words(rng, n) + (rng.choice(passages) if i % 2 else [])
        rows.append((2 * i, " ".join(w)))
        sets = lambda x: {tuple(x[k:k + 5]) for k in range(max(1, len(x) - 4))}
        near = list(w)
        while True:  # as many other words as the limit lets
            more = list(near)
            more[rng.randrange(len(more))] = f"other{rng.random()}"
            if 100 * len(sets(w) & sets(more)) < 80 * len(sets(w) | sets(more)):
                break
            near = more
        rows.append((2 * i + 1, " ".join(near)))
    got, _ = groups(spark, monkeypatch, rows)
    assert got == linked(rows)


def test_pairs_at_the_limit_share_more_keys_than_are_left_out():
    rng, low = np.random.default_rng(7), jaccard.bands()
    for percent, further in ((80, 0), (80, jaccard.KEEP_PARTS), (90, 0)):
        plan = jaccard.band_parts(percent, further)
        for n in (5, 9, 17, 30, 61, 104, 240, 800, 2500):
            band = next(j for j in range(len(low)) if low[j] <= n < low[j + 1])
            differ = 2 * n * (100 - percent) // (100 + percent)
            for _ in range(30):
                x = mix(rng.integers(0, 2 ** 63, n + differ, dtype=np.uint64))
                y = np.sort(np.r_[x[:n - differ // 2], x[n:n + differ - differ // 2 - differ % 2]])
                both = [set(jaccard.signatures(s, low, plan, percent).tolist()) for s in (np.sort(x[:n]), y)]
                shared = [k for k in both[0] & both[1] if k & 1 == band & 1]
                assert len(shared) > plan[band][1]
        assert any(drop > 5 for _, drop in plan[:25])


def test_no_shared_keys(spark, monkeypatch):
    rows = [(1, "a b c d e f g"), (2, "h i j k l m n"), (None, "a b c d e f g"), (3, None)]
    got, _ = groups(spark, monkeypatch, rows)
    assert got == [1, 2, 3, None]
