"""The parse against brute force: factor boundaries, sources that change, one phrase in many rows."""

import random
from collections import Counter

import numpy as np
import pytest

from clickweave.llm import substring_dedup
from clickweave.llm.common import WordHashes

WINDOW, GRAM = 7, 3


def brute(texts, window):
    words = [(t or "").split() for t in texts]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(seed):
    """Texts of pieces of a few passages, cut anywhere, between words of their own; copies and a long one."""
    rng = random.Random(seed)
    sources = [[f"s{k}w{rng.randrange(40)}" for _ in range(60)] for k in range(4)]
    texts = [None, "", "one two", " ".join(sources[0]), " ".join(sources[0])]
    for n in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            source, at = rng.choice(sources), rng.randrange(50)
            words += [f"d{n}x{rng.randrange(9)}" for _ in range(rng.randrange(4))] + source[at : at + rng.randrange(3, 30)]
        texts.append(" ".join(words))
    texts += [texts[7]] * 20 + ["a " * 300, " ".join(w for s in sources for w in s) * 3]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = passages(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(substring_dedup.remove_duplicates(docs, WINDOW, GRAM).collect())
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == brute(texts, WINDOW)
    assert all(r.n_removed == sum(s.stop - s.start for s in r.spans) for r in got)


def test_runs_cover_every_window_and_phrases_are_their_words():
    words = [f"w{random.Random(i).randrange(30)}" for i in range(400)]
    for around in (0, 50):
        hashes = WordHashes()([f"x{i}" for i in range(around)] + words)
        anchor, first, last, phrase = substring_dedup.runs_of(hashes, 35, 8)
        assert first[0] == 0 and last[-1] == len(hashes) - 35 and (first[1:] == last[:-1] + 1).all()
        found = {(int(a), int(p)) for a, f, p in zip(anchor, first, phrase, strict=True) if f > around}
        if around:
            # Words before them change neither runs nor phrases.
            assert found <= before
        before = {(int(a), int(p)) for a, p in zip(anchor, phrase, strict=True)}


def test_factors_join_runs_without_a_gap():
    first, last = np.array([40, 0, 12, 3]), np.array([41, 2, 12, 4])
    assert substring_dedup.factors(first, last, 7) == [(0, 11), (12, 19), (40, 48)]
    assert substring_dedup.factors(first[:0], last[:0], 7) == []
