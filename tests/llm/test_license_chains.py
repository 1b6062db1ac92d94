"""Chains of matches against all chains there are; notices with stray words, and several in a text."""

import random

import pytest

from clickweave.llm import license_scan
from clickweave.llm.license_scan import GAP, LEAST_COVER, TEMPLATES, Scanner, chains


def best_of_all(found):
    """The most words any chain covers, by trying every chain."""
    best = 0

    def go(chain, covered):
        nonlocal best
        best = max(best, covered)
        for k, (start, at, length) in enumerate(found):
            if chain:
                s, t, n = found[chain[-1]]
                if not (s < start and t < at and start <= s + n + GAP):
                    continue
                new = length - max(s + n - start, t + n - at, 0)
                if new <= 0:
                    continue
            else:
                new = length
            go([*chain, k], covered + new)

    go([], 0)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_best_chain(seed):
    rng = random.Random(seed)
    size = 30
    found = sorted({(rng.randint(0, 60), at := rng.randint(0, size - 3), rng.randint(3, min(9, size - at))) for _ in range(rng.randint(1, 9))})
    got = chains(found, size)
    assert got[0][2] == best_of_all(found)
    spans = sorted((a, b) for a, b, _ in got)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert all(n >= LEAST_COVER * size for _, _, n in got[1:])


@pytest.fixture(scope="module")
def scanner():
    return Scanner(TEMPLATES, license_scan.PHRASES)


@pytest.mark.parametrize("label", sorted(TEMPLATES))
def test_a_notice_with_its_last_words_repeated_inside(scanner, label):
    words = TEMPLATES[label].split()
    for k in range(len(words) + 1):
        text = " ".join([*words[:k], *words[-3:], *words[k:]])
        assert label in scanner.scan(text.encode())["labels"], k


def test_two_notices_are_two_spans(scanner):
    text = TEMPLATES["mit"] + " and then " + TEMPLATES["mit"] + " x" * 50 + " " + TEMPLATES["mit"]
    spans = [s for s in scanner.scan(text.encode())["spans"] if s["label"] == "mit"]
    assert len(spans) == 3 and all(s["cover"] >= 0.99 for s in spans)
    assert all(a["stop"] <= b["start"] for a, b in zip(spans, spans[1:], strict=False))
