"""Transducers of four languages, and the way back to the source characters."""

import random

import pytest

from loghound.llm import pii


@pytest.mark.parametrize("kind, inside", [
    ("email", "john at example.com"), ("email", "john\tat\texample\tdot\tcom"), ("email", "john arroba example punto com"),
    ("email", "john arobase exemple point fr"), ("email", "john (ät) beispiel punkt de"),
    ("email", "john (at) mail dot example [punkt] de"), ("email", "j​ohn@example.com"),
    ("email", "j­ohn@exa​mple.com"), ("email", "𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦"), ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("ip", "192.168.seven.ten"), ("ip", "ten.zwei.3.uno"), ("ip", "१९२.१६८.७.१"),
    ("phone", "plus vier neun eins sieben zwei drei vier fünf sechs sieben"),
    ("phone", "más tres cuatro seis uno dos tres cuatro cinco seis siete"),
    ("phone", "plus trois trois six un deux trois quatre cinq six"),
    ("card", "vier eins eins eins " + " ".join(["eins"] * 12)),
])
def test_disguises_are_found_whole(kind, inside):
    text = f"écrit: {inside}; fin"
    _, spans = pii.all_spans(text)
    a = text.index(inside)
    assert (kind, a, a + len(inside)) in spans
    assert pii.redact_text(text, [s for s in spans if s[0] == kind]) == f"écrit: <{kind}>; fin"


@pytest.mark.parametrize("text", [
    "See more at example.com, or look at example.org.", "Le point final est là, un deux trois.",
    "Er kam at last. El punto es dos tres cuatro.", "Der Punkt (at) ist klein – und gut.", "naïve café, über 3 – 4 Tage",
])
def test_clean_prose_stays(text):
    assert pii.all_spans(text) == ([], [])


def test_edits_map_back_like_a_list_of_sources():
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 40)))
        view, sources = pii.Mapped(text), [(i, i + 1) for i in range(len(text))]
        for _ in range(3):
            edits, at = [], 0
            while at < len(view.text):
                a = at + rnd.randrange(0, 6)
                b = a + rnd.randrange(1, 4)
                if b > len(view.text):
                    break
                edits.append((a, b, "x" * rnd.randrange(0, 3)))
                at = b
            new, at = [], 0
            for a, b, put in edits:
                new += sources[at:a] + [(sources[a][0], sources[b - 1][1])] * len(put)
                at = b
            sources = new + sources[at:]
            view = view.rewrite(edits)
            assert len(view.text) == len(sources)
        for a in range(len(sources)):
            b = rnd.randrange(a, len(sources)) + 1
            assert view.source(a, b) == (sources[a][0], sources[b - 1][1])
