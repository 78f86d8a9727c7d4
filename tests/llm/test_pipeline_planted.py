"""run() on planted documents, every stage held against plain Python."""
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from loghound.llm import mixing, pii, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def kept_of(rows):
    """The smallest id of each group of documents linked by a Jaccard similarity of 0.8."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                root[b] = a
    return {rows[find(i)][0] for i in range(len(rows))}


def documents():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "th", "so", "lu"]) for _ in range(rng.randint(2, 4)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 200))), rng.choice("ab")) for i in range(160)]
    rows += [(200 + i, rows[i][1] + " moron" * (i % 2) + " trash" * (i % 3), "a") for i in range(20, 40)]
    for i in range(300, 340):  # toxic
        w = [word() for _ in range(60)]
        for bad in ("moron", "scum", "idiot", "trash"):
            w.insert(rng.randrange(len(w)), bad)
        rows.append((i, " ".join(w), "b"))
    rows += [(400 + i, rows[i][1], "a") for i in range(30)]                                    # copies
    rows += [(500 + i, rows[i][1].replace(rows[i][1].split()[7], "zz", 1), "b") for i in range(30)]  # near copies
    rows += [(600, "write to ann@example.com or +49 (30) 1234 5678 " + rows[0][1][::-1], "a"), (601, None, "a"),
             (602, "", "b"), (603, " \t\n", None), (604, "one", "b"), (605, "one", "b")]
    return rows


def test_run(spark, tmp_path):
    rows = documents()
    frame = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(300 <= i < 340)) for i, _, _ in rows if i < 160 or 300 <= i < 340]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    crf = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = [r for r in rows if crf.tag(r[1] or "")[0] < toxicity.THRESHOLD]
    # what is planted as toxic goes, what holds no toxic word stays
    assert not any(300 <= r[0] < 340 for r in clean)
    assert {r[0] for r in clean} >= {r[0] for r in rows if r[0] < 160 or 400 <= r[0] < 700}

    alone = kept_of(clean)
    assert not any(400 <= i < 600 for i in alone) and {601, 602, 603, 604} <= alone and 605 not in alone
    left = {r[0]: (pii.redact_text(r[1], pii.all_spans(r[1])[1]) if r[1] is not None else None, r[2])
            for r in clean if r[0] in alone}
    assert "ann@example.com" not in left[600][0]

    mid = docs
    for name, step in corpus_pipeline.STAGES[:3]:
        mid = spark.createDataFrame(step(spark, mid, sf).collect(), SCHEMA)
    assert {r.doc_id: (r.text, r.source) for r in mid.collect()} == left and mid.count() == len(left)

    size = {i: len(WORD.findall(t or "")) for i, (t, _) in left.items()}
    times = {r.doc_id: r.copies for r in mixing.pareto_mix(mid).collect()}
    assert all(0 <= n <= 2 for n in times.values())
    taken, target = Counter(), {}
    for r in mixing.pareto_mix(mid).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in target)

    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r.doc_id].append((r.start_token, r.n_tokens))
        if r.bin_id is not None:
            bins[r.bin_id, r.capacity].append((r.bin_offset, r.n_tokens))
    # every word of every copy is packed once, nothing else is
    want = {i: n * size[i] for i, n in times.items() if n}
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == want
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
