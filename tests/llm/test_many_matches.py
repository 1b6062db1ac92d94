"""Texts with very many matches take time in proportion to them, and give what brute force gives."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from clickweave.llm import pii


@pytest.mark.parametrize("n", [200_000])
def test_many_matches_in_one_text(spark, docs_of, n):
    text = " ".join(f"a{i}@b.cc" for i in range(n))
    docs = docs_of([(1, text)])
    began = time.perf_counter()
    found = pii.find(docs).select(F.size("email").alias("n"), F.element_at("email", -1).alias("last")).first()
    spent = time.perf_counter() - began
    assert found.n == n and found["last"].stop == len(text) and found["last"].hit == f"a{n - 1}@b.cc"
    began = time.perf_counter()
    clean = pii.redact(docs).first().text
    assert clean == " ".join(["<email>"] * n)
    # On a busy machine a minute; growth with the square would take hours.
    assert max(spent, time.perf_counter() - began) < 180


def test_tokens_apart_from_spans(spark):
    """Against a nested loop, on random spans and tokens."""
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        spans = sorted({(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))})
        tokens = sorted({(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 300)))})
        rows.append((spans, tokens))
    ddl = "s array<struct<start: bigint, stop: bigint>>, t array<struct<pattern: string, instance: string, start: bigint, stop: bigint, seed: boolean>>"
    df = spark.createDataFrame([(s, [("p", "i", a, b, False) for a, b in t]) for s, t in rows], ddl).coalesce(1)
    got = [[(c.start, c.stop) for c in r.x] for r in df.select(pii._apart(F.col("t"), F.col("s")).alias("x")).collect()]
    assert got == [[c for c in t if not any(b[0] < c[1] and c[0] < b[1] for b in s)] for s, t in rows]


def test_parts_of_a_text_in_pieces(spark):
    text = "".join(random.Random(1).choice("aé😀\n漢") for _ in range(2000))
    cuts = [(0, 0), (0, 5), (511, 513), (512, 512), (100, 1900), (1999, 2000), (2000, 2000), (1024, 1536)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a bigint, b bigint").coalesce(1)
    got = [r[0] for r in df.select(pii._part(pii._pieces(F.col("t")), F.col("a"), F.col("b"))).collect()]
    assert got == [text[a:b] for a, b in cuts]


def test_words_before_spans_across_pieces(spark, docs_of):
    """The word before a span is found wherever pieces are cut; one longer than the reach is none."""
    texts = [("x" * 505 + " konto me@host.org", "konto"), ("y" * 200 + " me@host.org", ""), ("konto me@host.org", "konto")]
    df = spark.createDataFrame([(t,) for t, _ in texts], "text string").coalesce(1)
    base = pii.base_spans(F.col("text"))
    rows = df.select(pii._contexts(F.col("text"), F.concat(*[base[k] for k in pii.KINDS])).alias("c")).collect()
    assert [[c.pattern for c in r.c if c.seed] for r in rows] == [[w] if w else [] for _, w in texts]
    assert re.fullmatch(r"\w+", "konto")
