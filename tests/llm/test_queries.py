"""Registered queries over the smallest tables against brute force written from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from clickweave.llm import queries

SF = "/root/testdata/sf0.001"
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_license_scan(spark, documents):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    expected = []
    for d in documents:
        words = PLAIN.findall(lowered(d.text))
        places = [(i, k, len(p.split())) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        ends = (min(i for i, _, _ in places), max(i for i, _, _ in places)) if places else (None, None)
        expected.append((d.doc_id, len(words), len(places), *ends, ",".join(sorted({k for _, k, _ in places}))))
    got = queries.op1_license_scan(spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(expected)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_decontamination(spark, documents):
    windows = defaultdict(set)
    for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = tuple(PLAIN.findall(lowered(b.text)))
        if words:
            size = min(13, len(words))
            for i in range(len(words) - size + 1):
                windows[words[i : i + size]].add(b.item_id)
    sizes = {len(w) for w in windows}
    expected = []
    for d in documents:
        words, hit, items = tuple(PLAIN.findall(lowered(d.text))), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if found := windows.get(words[i : i + size]):
                    hit.update(range(i, i + size))
                    items |= found
        digest = sha(",".join(sorted(map(str, items))))
        expected.append((d.doc_id, len(words), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(words)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(queries.op2_benchmark_decontamination(spark, SF), *columns) == sorted(expected)


@pytest.fixture(scope="module")
def ids(documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d.doc_id: tokenizer.encode(d.text or "", add_special_tokens=False).ids for d in documents}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_token_output(spark, ids):
    expected, start = [], 0
    for doc_id in sorted(ids):
        values = [*ids[doc_id], 0]
        expected.append((doc_id, start, len(values), crc(values)))
        start += len(values)
    assert rows(queries.op3_token_output(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == expected


def test_packing(spark, ids):
    got = queries.op10_best_fit_packing(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for doc_id, values in ids.items():
        values, parts = [*values, 2], sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(values) // 1024)))
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts[:-1]]]).tolist()
        assert all(r.length == 1024 for r in parts[1:]) and sum(r.length for r in parts) == len(values)
        assert all(r.ids_crc32 == crc(values[r.start : r.start + r.length]) for r in parts)
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist()
        assert sum(n for _, n in places) <= 1024
    least = -(-sum(r.length for r in got) // 1024)
    assert len(sequences) <= least * 1.02 + 1


def test_near_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    column = next(n for n, t in table.dtypes if t.startswith("array"))
    vectors = table.select("vec_id", column).collect()
    usable = {r.vec_id: np.array(r[column], float) for r in vectors if r[column] and None not in r[column]}
    usable = {k: v / np.linalg.norm(v) for k, v in usable.items() if np.isfinite(v).all() and v.any()}
    names = list(usable)
    near = np.array([usable[k] for k in names]) @ np.array([usable[k] for k in names]).T >= 0.9
    links = {k: int(near[i].sum()) - 1 for i, k in enumerate(names)}
    root = {r.vec_id: r.vec_id for r in vectors}
    for _ in names:
        before = dict(root)
        for i, k in enumerate(names):
            root[k] = min(root[names[j]] for j in np.flatnonzero(near[i]))
        if root == before:
            break
    expected = sorted((r.vec_id, links.get(r.vec_id, 0), root[r.vec_id], root[r.vec_id] == r.vec_id) for r in vectors)
    assert rows(queries.op6_embedding_near_dedup(spark, SF), "vec_id", "n_links", "component_id", "kept") == expected


def test_substrings(spark, documents):
    words = [SPACED.findall(d.text or "") for d in documents]
    starts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = []
    for d, w in zip(documents, words, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        expected.append((d.doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert rows(queries.op7_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected)


def test_simhash(spark, documents):
    prints = {}
    for d in documents:
        words = SPACED.findall(lowered(d.text))
        grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            best = min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
            if best < root[a]:
                root[a], changed = best, True
    expected = sorted((k, f"{p:016x}", root[k]) for k, p in prints.items())
    assert rows(queries.op9_simhash_near_dedup(spark, SF), "doc_id", "fingerprint", "component_id") == expected
