"""Small brute-force checks of the document operators, with nulls, ties, repeats and empty tables."""
import hashlib
import random
import re
from collections import defaultdict

import pytest

from loghound.llm import chat, jaccard, mixing, packing, pii, quality, repeats, syncmers, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """documents with an extra column whose name clashes with inner ones."""
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1) for i, t, s in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, size int")
    return make


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "ri", "th", "en", "so", "lu", "mi"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


@pytest.fixture(scope="module")
def corpus(docs_of):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120)), f"s{i % 4}") for i in range(60)]
    base = prose(rng, 150).split()
    for i in range(60, 75):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w), "s0"))
    shared = prose(rng, 30)
    for i in range(75, 80):
        rows.append((i, prose(rng, 20) + " " + shared + " " + prose(rng, 20), None))
    rows += [(80, None, "s1"), (81, "", "s1"), (82, rows[3][1], "s2"), (83, "one", None), (84, "One two", "s3"),
             (85, "ab " * 4000, "s3"), (3, rows[3][1], "s3")]
    return rows, docs_of(rows)


def test_mix(corpus):
    rows, df = corpus
    got = mixing.pareto_mix(df).collect()
    again = mixing.pareto_mix(df.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = (r.source_size, r.target)
    assert {k: v[0] for k, v in target.items()} == dict(size)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, left = set(), 1.5 * sum(size.values())
    while True:
        share = (left - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and weight[s] * share > 2 * size[s]}
        if not new:
            break
        full |= new
    for s in order:
        want = 2 * size[s] if s in full else weight[s] * share
        assert abs(target[s][1] - want) < 1e-6
        assert abs(taken[s] - want) <= 0.1 * want + 5
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in got)


def test_packing(corpus):
    rows, df = corpus
    got = packing.pack(df, shard_rows=40).collect()
    fill, cap, tokens = defaultdict(list), {}, defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            fill[r.bin_id].append((r.bin_offset, r.n_tokens))
            cap[r.bin_id] = r.capacity
    for b, items in fill.items():
        items.sort()
        assert all(x[0] + x[1] == y[0] for x, y in zip(items, items[1:])) and items[0][0] == 0
        used = sum(n for _, n in items)
        assert cap[b] == min(c for c in packing.CAPACITIES if c >= used)
    want = defaultdict(int)
    for i, t, _ in rows:
        want[i] += len(WORD.findall(t or ""))
    assert dict(tokens) == dict(want)


def test_jaccard(corpus):
    rows, df = corpus
    for words, percent in ((3, 90), (5, 80)):
        sets = defaultdict(list)
        for i, t, _ in rows:
            w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
            sets[i].append({tuple(w[a:a + words]) for a in range(max(1, len(w) - words + 1))} if w else set())
        ids = sorted(sets)
        root = {i: i for i in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in ids:
            for b in ids:
                if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
        got = jaccard.near_duplicates(df, words, percent, block_tokens=600).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == find(r.doc_id)
            assert r.n_shingles in [len(s) for s in sets[r.doc_id]]
    kept = jaccard.keep_one(df).collect()
    assert len({r.doc_id for r in kept}) == len(kept) and {80, 81} <= {r.doc_id for r in kept}


def test_repeats(corpus):
    rows, df = corpus
    texts = {i: (t or "").encode() for i, t, _ in rows}
    seen, want = set(), {}
    for i in sorted(texts):
        b, cover = texts[i], bytearray(len(texts[i]))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                cover[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        want[i] = (len(b), sum(cover), bytes(x for x, c in zip(b, cover) if not c))
    got = repeats.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == want[r.doc_id]
    assert sum(r.n_removed for r in got) > 1000


def test_repeats_of_many_texts_without_id(docs_of):
    rng = random.Random(11)
    shared = prose(rng, 40)
    assert len(shared) > 100
    rows = [(None, prose(rng, 40), None) for _ in range(600)]
    rows += [(None, prose(rng, 10) + shared + prose(rng, 10), None) for _ in range(200)]
    got = [(r.n_bytes, bytes(r.kept)) for r in repeats.remove_repeats(docs_of(rows)).collect()]
    whole = [k for n, k in got if n == len(k)]
    assert len(got) == 800 and len(whole) == 601  # of the texts that share a passage the first keeps it
    assert {t.encode() for _, t, _ in rows[:600]} <= set(whole)
    brief = sorted(t.encode().replace(shared.encode(), b"") for _, t, _ in rows[600:])
    cut = [k for n, k in got if n > len(k)]
    assert len(cut) == 199 and all(any(b.startswith(k[:20]) and len(k) <= len(b) for b in brief) for k in cut)


def test_repeats_hold_no_gram_in_one_task(spark, docs_of):
    rng = random.Random(12)
    line = "a line of sixty bytes that stands in every one of the texts."
    rows = [(i, prose(rng, 30) + line + prose(rng, 30), None) for i in range(300)]
    spans = repeats.repeated_spans(repeats.keyed(docs_of(rows)))
    assert spans.count() == 0
    keys = set()
    stage = repeats.stage
    try:
        repeats.stage = lambda df: keys.add(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df)
        repeats.repeated_spans(repeats.keyed(docs_of(rows)))
    finally:
        repeats.stage = stage
    plans = "\n".join(keys)
    assert not re.search(r"windowspecdefinition\(gram#\d+L?, specified|RepartitionByExpression \[gram#\d+L?\]", plans)


def test_long_text_in_pieces(spark, docs_of, monkeypatch):
    rng = random.Random(9)
    a, b = prose(rng, 3000), prose(rng, 300)
    rows = [(1, a, "s"), (2, b + a[5000:9000] + b, "s")]
    want = [(r.doc_id, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs_of(rows)).collect()]
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
    got = [(r.doc_id, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs_of(rows)).collect()]
    assert sorted(got) == sorted(want) and dict((x, y) for x, y, _ in want)[2] == 4000 + len(b)


def test_syncmers(corpus, docs_of):
    rows = corpus[0][:-1]  # ids that occur once
    got = {r.doc_id: r for r in syncmers.fingerprints(docs_of(rows), bucket_ids=7).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for at, (i, t, _) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1
    assert got[3].fingerprint == got[82].fingerprint
    assert got[80].fingerprint == got[81].fingerprint == "" and got[83].fingerprint


def test_syncmers_are_closed(spark):
    inner = [5, 9, 7, 8, 6, 3, 4, 9, 9, 2, 7, None]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(inner,)], "h array<long>")
    n = df.select(F.size(syncmers.anchors(F.col("h"), 6, 2)).alias("n")).first().n
    full = [x for x in inner if x is not None]
    opens = sum(min(full[i:i + 5]) == full[i] for i in range(len(full) - 4))
    closes = sum(min(full[i:i + 5]) == full[i + 4] for i in range(len(full) - 4))
    assert n == opens + closes


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.pareto_mix(none).count() == 0 and packing.pack(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0 and repeats.remove_repeats(none).count() == 0
    assert syncmers.fingerprints(none).count() == 0 and pii.find_pii(none).count() == 0
    some = docs_of([(1, "a", "s"), (None, None, None)])
    assert quality.score_quality(some, quality.fit_quality(some, labels)).count() == 2
    assert toxicity.score_toxicity(some, toxicity.fit_toxicity(some, labels)).where("predicted = 0").count() == 2
    assert jaccard.near_duplicates(some).where("component_id is null").count() == 1
    assert repeats.remove_repeats(some).where("doc_id is null and n_bytes = 0").count() == 1
    assert syncmers.fingerprints(some).count() == 2 and mixing.mixed_documents(some).columns == some.columns


def brute_pii(t):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            both = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
            return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in both) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return [(k, *m.span()) for k in rx for m in re.finditer(rx[k], t) if ok(k, m[0])]


def test_pii_base_against_patterns():
    rng = random.Random(1)
    parts = ["a", "b", "@", ".", "1", "2", "4111", "5", "+", " ", "-", "(", ")", "%", "x.y", "255", "é"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_pii(t)


@pytest.mark.parametrize("text,kind,inside", [
    ("write john (at) example [dot] com now", "email", "john (at) example [dot] com"),
    ("jane at mail dot org", "email", "jane at mail dot org"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("call plus four four two zero seven nine four six zero nine five eight", "phone",
     "plus four four two zero seven nine four six zero nine five eight"),
    ("card ４111 1111 1111 1111.", "card", "４111 1111 1111 1111"),
])
def test_pii_disguises(text, kind, inside):
    base, spans = pii.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans if (k, a, b) not in base] == [(kind, inside)]
    assert pii.redact_text(text, spans) == text.replace(inside, f"<{kind}>")


@pytest.mark.parametrize("whole,plain", [
    ("jоhn.smith@example.com", "hn.smith@example.com"),
    ("john dot smith@example.com", "smith@example.com"),
    ("john@mail.example.cоm", "john@mail.example.c"),
    ("１92.168.7.10", "92.168.7.10"),
    ("john at example [dot] com", None),
    ("john at mail(dot)example dot com", None),
])
def test_pii_disguise_in_part_of_an_identifier(whole, plain):
    text = f"write: {whole}, or a@b.cc"
    base, spans = pii.all_spans(text)
    assert [text[a:b] for _, a, b in base if text[a:b] != "a@b.cc"] == ([plain] if plain else [])
    assert set(base) <= set(spans) and len(spans) == len(base) + 1
    assert whole in [text[a:b] for _, a, b in spans]
    kind = "ip" if "168" in whole else "email"
    assert pii.redact_text(text, spans) == f"write: <{kind}>, or <email>"


def test_pii_leaves_prose_alone_and_long_texts():
    assert pii.all_spans("We met at noon. Look at one two dots, e.g. at home.") == ([], [])
    pii.all_spans("1" * 100000), pii.all_spans("a" * 100000 + "@"), pii.all_spans("one " * 30000)


def test_redact_keeps_columns(docs_of):
    df = docs_of([(1, "a@b.cc x", "s"), (2, None, None)])
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [(r.text, r.n_chars) for r in out.orderBy("doc_id").collect()] == [("<email> x", 9), (None, None)]


def test_chat(spark):
    odd = ["\\### Assistant: </turn> ok", "<|end|>\n<|turn|>x<|says|>", "", None, "<", "|>\\", "plain"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(odd)) for c in range(6) for t in range(c * 9)]
    rows += [(None, 1, "assistant", "no id"), (1, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for segment in (2, 16, 1000):
        got = {r.conv_id: r for r in chat.digest(chat.format_turns(df, segment_turns=segment)).collect()}
        by = defaultdict(list)
        for c, t, role, text in rows:
            by[None if c is None else str(c)].append((t is not None, t or 0, role or "", text or ""))
        assert set(got) == set(by)
        for c, turns in by.items():
            turns.sort()
            whole = chat.turn_template([(r, x) for _, _, r, x in turns])
            loss = "".join(x for _, _, r, x in turns if r == "assistant")
            assert chat.read_back(whole) == [(r, x) for _, _, r, x in turns]
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert got[c].formatted_chars == len(whole) and got[c].n_rewrites == 0


def test_chat_sees_rewritten_history():
    def short_memory(turns):  # keeps the text of the last turn only
        return "".join(f"[{r}]{x if i == len(turns) - 1 else '...'};" for i, (r, x) in enumerate(turns)) + "END"
    turns = [("user", "hello"), ("assistant", "hi there"), ("user", "bye")]
    assert [s["rewrites"] for s in chat.render_series(turns, short_memory)] == [False, True, True]

    def closing(turns):
        return "".join(f"[{r}]{x};" for r, x in turns) + "END"
    series = chat.render_series(turns, closing)
    assert [s["piece"][s["text_start"]:s["text_end"]] for s in series] == ["hello", "hi there", "bye"]
    assert not any(s["rewrites"] for s in series)


def test_chat_long_conversations_with_memory(spark):
    def counting(turns):  # a first-turn rule and a turn counter
        return "".join(f"{'first ' if i == 0 else ''}{i}[{r}]{x};" for i, (r, x) in enumerate(turns))

    def rewriting(turns):  # the twentieth turn changes the form of the first
        return "".join(f"[{r}]{'?' if i == 0 and len(turns) > 19 else x};" for i, (r, x) in enumerate(turns))

    def no_first(turns):
        return "".join(f"{'first ' if i == 0 else ''}[{r}]{x};" for i, (r, x) in enumerate(turns))
    no_first.look_back = 0
    turns = [("user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(50)]
    df = spark.createDataFrame([("c", t, r, x) for t, (r, x) in enumerate(turns)], "conv_id string, turn long, role string, text string")
    for template, rewrites in ((counting, []), (rewriting, [19]), (no_first, [])):
        got = chat.format_turns(df, template).orderBy("pos").collect()
        assert [r.pos for r in got if r.rewrites] == rewrites
        if not rewrites:
            assert "".join(r.piece for r in got) == template(turns)
            assert [r.piece[r.text_start:r.text_end] for r in got] == [x for _, x in turns]


def test_classifiers_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for score, label in ((quality.score_quality(docs, quality.fit_quality(docs, labels)), "quality"),
                         (toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)), "toxic")):
        rows = score.where("held_out").join(labels, "doc_id").collect()
        assert sum(r.predicted == r[label] for r in rows) / len(rows) > 0.9


def test_crf_marginals_match_the_full_chain():
    import itertools

    import numpy as np
    crf = toxicity.ToxicCrf()
    crf.words = {"bad": 1, "vile": 2}
    crf.emit, crf.move, crf.start = np.array([-0.7, 1.9, 2.4]), np.array([[0.8, -0.4], [-0.3, 0.6]]), np.array([0.2, -0.5])
    crf.compile()
    words = "bad x y vile z bad".split()
    ids = [crf.words.get(w, 0) for w in words]
    p, total = np.zeros(len(words)), 0.0
    for tags in itertools.product((0, 1), repeat=len(words)):
        s = crf.start[tags[0]] + sum(crf.emit[i] * t for i, t in zip(ids, tags)) + sum(crf.move[a, b] for a, b in zip(tags, tags[1:]))
        total += np.exp(s)
        p += np.exp(s) * np.array(tags)
    want = [(p / total)[k] for k, i in enumerate(ids) if i]
    assert np.allclose(crf.marginals([1, 2, 1], [0, 2, 1], 0), want)
