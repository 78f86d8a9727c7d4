"""The network looks at every place of a text, in fitting as in scoring."""

import numpy as np
import pytest

from loghound.llm import quality


def brute_features(net, data):
    s = quality.symbols(np.frombuffer(data, dtype=np.uint8)).astype(int)
    width = len(net.taps)
    s = np.concatenate([s, np.zeros(max(0, width - len(s)), dtype=int)])
    z = np.array([sum(net.taps[j, s[p + j]] for j in range(width)) for p in range(len(s) - width + 1)])
    halves = [z[a:a + quality.HALF].max(0) for a in range(0, len(z), quality.HALF)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    return np.maximum(np.array(chunks) + net.bias, 0)


@pytest.mark.parametrize("n", [1, 5, 6, 36, 37, 38, 69, 101, 700])
def test_chunks_cover_the_whole_text(n, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 3 * quality.HALF)
    net = quality.ByteConvNet(seed=3)
    data = bytes(np.random.default_rng(n).integers(32, 127, n, dtype=np.uint8))
    assert np.allclose(net.chunk_features(data), brute_features(net, data), atol=1e-5)


def test_fit_learns_from_a_passage_at_any_place():
    rng = np.random.default_rng(1)
    words = ["river", "stone", "light", "paper", "window", "garden", "morning", "letter"]

    def text(junk):
        t = " ".join(rng.choice(words, 400))
        at = int(rng.integers(0, len(t)))
        return (t[:at] + "$$##!!%%@@##$$!!" + t[at:] if junk else t).encode()

    y = np.array([k % 2 for k in range(240)], dtype=np.float32)
    texts = [text(not v) for v in y]
    net = quality.ByteConvNet()
    net.fit(texts[:200], y[:200])
    scores = np.array([net.score(t) for t in texts[200:]])
    assert ((scores >= 0.5) == (y[200:] == 1)).mean() >= 0.95
    assert net.score(texts[200]) == net.score(texts[200])
