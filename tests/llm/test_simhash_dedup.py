import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clickweave.llm import simhash_dedup as op
from clickweave.llm.common import connected_components


def brute_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, max_bits):
    """rows: (id, fingerprint); the smallest id reachable, by row."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if label[j] < label[i] and (a ^ b).bit_count() <= max_bits:
                    label[i], changed = label[j], True
    least = {}
    for (key, _), x in zip(rows, label):
        if key is not None:
            least[x] = min(key, least.get(x, key))
    return [least.get(x) for x in label]


def unsigned(x):
    return x % (1 << 64)


def test_against_brute_force(sample_docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in sample_docs.collect()]
    expected = sorted((i, f, c) for (i, f), c in zip(rows, brute_components(rows, 4)))
    got = op.simhash_components(sample_docs).collect()
    assert sorted((r.doc_id, unsigned(r.fp), r.component_id) for r in got) == expected


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in odd_docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    expected = sorted(((i, f, c) for (i, f), c in zip(rows, brute_components(rows, 4))), key=key)
    got = op.simhash_components(odd_docs.withColumn("component_id", F.lit(1)).withColumn("fp", F.lit("x"))).collect()
    assert sorted(((r.doc_id, unsigned(r.fp), r.component_id) for r in got), key=key) == expected
    assert op.simhash_components(no_docs).collect() == []
    assert op.drop_near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("hot_list", [4096, 2])
def test_links_connect_all_close_fingerprints(spark, hot_list):
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(12)]
    prints = {0}
    for c in centers:
        for _ in range(25):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "fp long")
    links = op.fingerprint_links(df, 4, hot_list)
    pairs = [(unsigned(r.a), unsigned(r.b)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    rows = [(i, f) for i, f in enumerate(prints)]
    label = dict(zip(prints, brute_components(rows, 4)))
    roots = {unsigned(r.node): r.component for r in connected_components(links).collect()}
    groups = {}
    for f in prints:
        groups.setdefault(roots.get(f, f), set()).add(label[f])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(label.values()))


@pytest.mark.parametrize("agreeing", [3, 4, 5])
def test_byte_subsets_cover(agreeing):
    from itertools import combinations

    subsets = [set(s) for s in op.byte_subsets(agreeing)]
    assert all(any(s <= set(c) for s in subsets) for c in combinations(range(8), agreeing))


def test_one_document_of_each_group_stays(docs_of):
    base = " ".join(f"word{i}" for i in range(5000))
    near = base.replace("word150 ", "other ")
    docs = docs_of([(5, base), (3, near), (3, near), (4, base), (7, "quite another text"), (None, base), (8, None), (9, "")])
    kept = op.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    shuffled = chain.orderBy(F.xxhash64("a")).repartition(5)
    got = connected_components(shuffled).collect()
    assert len(got) == 201 and {r.component for r in got} == {0}


def test_simhash_of_very_long_text():
    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(0, 1000, 100_000)))
    assert op.simhash(text.encode(), 4) == brute_fingerprint(text)
