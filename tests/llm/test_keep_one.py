from loghound.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string"


def test_unlike_texts_of_one_id_stay_and_copies_go(spark):
    a = " ".join(f"alpha{i}" for i in range(40))
    b = " ".join(f"beta{i}" for i in range(40))
    near_a = a.replace("alpha39", "omega")
    rows = [(1, a, "s"), (1, b, "s"), (1, a, "t"), (2, near_a, "s"), (3, "short text", "s"), (4, "short text", "s"),
            (None, a, "s"), (None, a, "s"), (5, None, "s"), (6, "", "s"), (5, None, "s")]
    df = spark.createDataFrame([(i, t, "en", s, None, "clash") for i, t, s in rows], SCHEMA)
    got = jaccard.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [k for k in kept if k[0] is None] == [(None, a)] * 2
    # one of the two near copies of a, whichever key is smaller; b, the short text, and both empty ones
    assert len([k for k in kept if k[1] in (a, near_a) and k[0]]) == 1
    assert (1, b) in kept and (3, "short text") in kept and (4, "short text") not in kept
    assert (5, None) in kept and (6, "") in kept and len(kept) == 7


def test_without_odd_ids_the_smallest_id_stays(spark):
    a = " ".join(f"alpha{i}" for i in range(40))
    rows = [(9, a + " end"), (7, a), (8, "alone"), (7, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == [7, 8]
    assert jaccard.keep_one(df.limit(0)).count() == 0
