"""Token groups of two tokenizers against brute force with the plain libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from clickweave.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    from tokenizers.decoders import ByteLevel

    decoder = ByteLevel()
    b = SentencePieceProcessor(model_file=B)

    def tokens(text):
        if not text:
            return [], []
        whole = " " + text
        enc = a.encode(whole, add_special_tokens=False)
        assert decoder.decode(enc.tokens) == whole
        raw = {c: i for c, i in alignment._byte_of().items()}
        xs = [(i, bytes(raw[c] for c in t)) for i, t in zip(enc.ids, enc.tokens, strict=True)]
        ys = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            ys.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        same = b"".join(t for _, t in xs) == b"".join(t for _, t in ys) == whole.encode()
        return (xs, ys) if same else ([], [])

    return tokens


def brute_groups(xs, ys):
    def ends(ts):
        out, at = [], 0
        for _, t in ts:
            at += len(t)
            out.append(at)
        return out

    ea, eb = ends(xs), ends(ys)
    groups, a, b = [], [], []
    common = set(ea) & set(eb)
    ia = ib = 0
    for c in sorted(common):
        a, b = [], []
        while ia < len(ea) and ea[ia] <= c:
            a.append(xs[ia][0])
            ia += 1
        while ib < len(eb) and eb[ib] <= c:
            b.append(ys[ib][0])
            ib += 1
        groups.append((a, b))
    return groups


def brute(tokens, texts):
    all_groups = [brute_groups(*tokens(t)) for t in texts]
    counts = Counter()
    for gs in all_groups:
        counts.update({(x, y) for a, b in gs for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for gs in all_groups:
        links = [(x, y) for a, b in gs for x in a for y in b]
        printed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        rows.append((
            sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links),
            sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(printed.encode()).hexdigest() if gs else "",
        ))
    return rows


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    "plain words here", "a ▁ mark", "▁", "literal <|endoftext|> and <s> </s> <unk> <0x41>", " leading", "trailing ", "  two  ",
    "tab\there\r\nand\x00nul", "﻿bom ​ zero 　 wide", "漢字かな交じり文 と 😀👩‍👩‍👧", "ﬁ ligature é combining é", "'s 'll don't I'm 've",
    "1234567890 12 3.14 $5", "x" * 3000, "ab" * 1500 + " " + "é" * 999, "\n\n\n", "\x1c \x85  ", "the the the the",
]


def test_gallop_equals_searchsorted():
    rng = np.random.default_rng(5)
    for n, m in [(0, 0), (0, 5), (1, 1), (5, 0), (3, 1000), (700, 900), (65, 64), (5000, 20_000)]:
        short = np.sort(rng.choice(50_000, n, replace=False)).astype(np.int64)
        long = np.sort(rng.choice(50_000, m, replace=False)).astype(np.int64)
        assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_overlaps_and_groups_of_random_cuts(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    cut = lambda: np.array(sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, n)))}), np.int64)
    ea, eb = cut(), cut()
    found = alignment.align(ea, eb)
    assert ea[found.a[1:] - 1].tolist() == eb[found.b[1:] - 1].tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))
    spans = lambda e: list(zip([0, *e[:-1].tolist()], e.tolist(), strict=True))
    for (lo, hi), first, stop in zip(spans(ea), found.first, found.stop, strict=True):
        touching = [k for k, (x, y) in enumerate(spans(eb)) if x < hi and lo < y]
        assert touching == list(range(first, stop))


@pytest.mark.parametrize("chunk,large", [(8_000_000, 4096), (40, 2)])
def test_against_brute_force(spark, docs_of, odd_docs, plain, monkeypatch, chunk, large):
    monkeypatch.setattr(alignment, "LARGE", large)
    monkeypatch.setattr(alignment, "AT_ONCE", large * 10)
    docs = docs_of(list(enumerate(TEXTS, 100))).unionByName(odd_docs).withColumn("n_a", F.lit("clash"))
    rows = docs.collect()
    expected = [(r.doc_id, *x) for r, x in zip(rows, brute(plain, [r.text for r in rows]), strict=True)]
    got = [(r.doc_id, *[r[n] for n in NAMES]) for r in alignment.link_statistics(docs, A, B, chunk).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_parts_in_process(plain, monkeypatch):
    """Large groups and small blocks give the same pairs."""
    tok = alignment.Tokenizers(A, B)
    parts = ["x" * 500, "ab" * 200, "plain", "漢字かな交じり文", "don't"]
    whole = alignment.aligned_parts(tok, parts)
    monkeypatch.setattr(alignment, "LARGE", 3)
    monkeypatch.setattr(alignment, "AT_ONCE", 5)
    assert alignment.aligned_parts(tok, parts) == whole


def test_query_on_the_smallest_tables(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = [(r.doc_id, *x) for r, x in zip(rows, brute(plain, [r.text for r in rows]), strict=True)]
    got = [(r.doc_id, *[r[n] for n in NAMES]) for r in queries.op11_cross_tokenizer_alignment(spark, sf).collect()]
    assert sorted(got) == sorted(expected)


def test_documents_with_slices(spark, docs_of, no_docs, plain):
    docs = docs_of(list(enumerate(TEXTS)))
    for r in alignment.align_documents(docs, A, B).collect():
        xs, ys = plain(TEXTS[r.doc_id])
        assert (r.a_ids, r.b_ids) == ([i for i, _ in xs], [i for i, _ in ys])
        groups = [(r.a_ids[g.a_start : g.a_stop], r.b_ids[g.b_start : g.b_stop]) for g in r.groups]
        assert groups == brute_groups(xs, ys) and len(r.overlaps) == len(xs)
    assert alignment.align_documents(no_docs, A, B).collect() == []
    assert alignment.link_statistics(no_docs, A, B).collect() == []
