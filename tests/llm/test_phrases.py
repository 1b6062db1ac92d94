"""Phrase collocations against brute force and SQL; counting quotient filters against plain counts."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from clickweave.llm import phrases, queries


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_permutation_is_invertible(m):
    rng = np.random.default_rng(m)
    grams = rng.integers(0, 2**32, (500, m), dtype=np.uint32)
    grams[:50] = np.arange(50 * m, dtype=np.uint32).reshape(50, m)
    assert (phrases.restore(phrases.permute(grams)) == grams).all()
    # Neighbouring ids part in the first column.
    tops = phrases.permute(np.arange(400 * m, dtype=np.uint32).reshape(400, m))[:, 0] >> 28
    assert np.bincount(tops, minlength=16).max() < 60


@pytest.mark.parametrize("m,bits,n", [(2, 1, 40), (2, 31, 40), (3, 9, 1000), (5, 12, 1000), (5, 3, 1), (2, 5, 0)])
def test_filter_gives_back_what_it_got(m, bits, n):
    rng = np.random.default_rng(bits)
    keys = np.unique(phrases.permute(rng.integers(0, 20, (n, m), dtype=np.uint32)), axis=0)
    counts = rng.integers(1, 2**40, len(keys)).astype(np.int64)
    back, their = phrases.entries_of(phrases.filter_of(keys, counts, bits))
    assert (back == keys).all() and their.tolist() == counts.tolist()


def test_segments_hold_the_chosen_grams_only():
    stream = np.array([1, 2, 3, 4, 5, 0, 6, 7, 8, 9], np.uint32)
    assert phrases._places(stream, 3).tolist() == [0, 1, 2, 6, 7]
    left = phrases._segments(stream, np.array([0, 2, 6, 7]), 3)
    assert left.tolist() == [1, 2, 3, 0, 3, 4, 5, 0, 6, 7, 8, 9, 0]
    assert [left[p : p + 3].tolist() for p in phrases._places(left, 3)] == [[1, 2, 3], [3, 4, 5], [6, 7, 8], [7, 8, 9]]


def test_merged_filters_add_up():
    rng = np.random.default_rng(1)
    grams = [rng.integers(1, 6, (300, 3)).astype(np.uint32) for _ in range(4)]
    filters = []
    for g in grams:
        keys, counts = np.unique(phrases.permute(g), axis=0, return_counts=True)
        filters.append(phrases.filter_of(keys, counts, 7))
    keys, counts, place = phrases.merged(filters)
    got = {tuple(k): int(c) for k, c in zip(phrases.restore(keys).tolist(), counts, strict=True)}
    assert got == Counter(tuple(r) for g in grams for r in g.tolist())
    assert (keys[place] == np.concatenate([phrases.entries_of(f)[0] for f in filters])).all()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, first, longest=5, held=100):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    key = (lang, tuple(ws[i : i + m]))
                    f[key] = f.get(key, 0) + 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = []
    for (lang, g), a in candidates.items():
        holds = [b for (la, h), b in candidates.items() if la == lang and len(h) > len(g)
                 and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if any(100 * b >= held * a for b in holds):
            continue
        cuts = []
        for k in range(1, len(g)):
            l, r = f[lang, g[:k]], f[lang, g[k:]]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        rows.append((lang, " ".join(g), a, l, r, n[lang], score))
    out = []
    for lang in n:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:first]
        out += [(lang, i, *r[1:]) for i, r in enumerate(best, 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "c", "É", "né", "漢字", "x\x00y", "the", "é", "B", " wide", "🙂"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!", " \x0c"]
    return [
        (rng.choice(["en", "en", "en", "de", None, "und"]), "".join(rng.choice(words[: rng.randint(2, 12)]) + rng.choice(ends) for _ in range(rng.randint(0, 60))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("least,first,held,chunk,span", [(3, 2000, 100, 8_000_000, 2_000_000), (2, 7, 100, 300, 50), (4, 30, 60, 1000, 200)])
def test_against_brute_force(spark, monkeypatch, least, first, held, chunk, span):
    monkeypatch.setattr(phrases, "RANGE_WORDS", span)
    rows = texts(least, 80) + [("en", "one two three four five six. " * 4), ("de", None), (None, ""), ("fr", "only once")]
    docs = spark.createDataFrame([(i, t, la) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string")
    docs = docs.withColumns({"phrase": F.lit("clash"), "word": F.lit(1)}).repartition(5)
    got = phrases.collocations(docs, least=least, first=first, held=held, chunk=chunk)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, first, held=held)


def test_nothing_frequent(spark, odd_docs, no_docs):
    assert phrases.collocations(no_docs).collect() == []
    got = phrases.collocations(odd_docs).collect()
    # Only the text of 20,000 times "word " has a phrase; all shorter ones lie in the longest but for
    # its count, as fewer long ones fit.
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in got) == brute(rows, 100, 2000)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.execute(queries.all_oracles()["op12_phrase_collocations"]).fetchall()
    got = [tuple(r) for r in queries.op12_phrase_collocations(spark, sf).collect()]
    assert sorted(got) == sorted(expected) and got


def test_a_chunk_gets_its_numbers_back_in_a_row_per_bucket():
    chunks = {1: ["a", "b", "rare"], 2: ["b", "a", "c"], 3: ["c", "once"]}
    times = {1: [3, 1, 1], 2: [4, 2, 7], 3: [1, 1]}
    dealt = []
    for k, words in chunks.items():
        values = [[k], ["en"], [[w.encode() for w in words]], [times[k]]]
        batch = pa.RecordBatch.from_arrays([pa.array(v, phrases._STREAM.field(i).type) for i, v in enumerate(values)], names=["chunk", "lang", "words", "times"])
        dealt += phrases._dealt(2)(iter([batch]))
    assert sum(b.num_rows for b in dealt) <= 2 * len(chunks)
    ids, back = {}, {}
    for bucket in (0, 1):
        table = pa.Table.from_batches(dealt).filter(pc.field("bucket") == bucket)
        if table.num_rows:
            level = phrases._known(3, 2)(table).to_pylist()
            assert sum(r["word"] is None for r in level) <= len(chunks)
            ids |= {r["id"]: (r["word"].decode(), r["count"]) for r in level if r["word"] is not None}
            for r in level:
                if r["word"] is None:
                    back.setdefault(r["chunk"], {}).update(zip(r["places"], r["ids"], strict=True))
    assert sorted(ids.values()) == [("a", 5), ("b", 5), ("c", 8)] and 0 not in ids
    assert {k: {p: ids[i][0] for p, i in v.items()} for k, v in back.items()} == {1: {1: "a", 2: "b"}, 2: {1: "b", 2: "a", 3: "c"}, 3: {1: "c"}}
