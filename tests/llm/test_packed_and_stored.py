"""Token files, packing, substring and vector deduplication, the pipeline."""

import io
import random
import re
import struct
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from clickweave.llm import packing, substring_dedup, token_store, vector_dedup
from clickweave.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids_of(text, end):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoder_equals_the_tokenizer():
    rng = random.Random(4)
    encode = Encoder(PATH, limit=50)
    letters = "a b'c  \n\t é漢1½²_-.,!ſ\xa0 \x1cß😀'sDon't\r<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["word " * 3000, "x" * 5000, "<|endoftext|> <|endoftext|>", "I'm don't we'll '"]
    assert [t for t in texts if encode(t) != encode.whole(t)] == []


def test_token_files(spark, docs_of, odd_docs, no_docs, sample_docs):
    docs = sample_docs.filter("doc_id >= 20").unionByName(odd_docs).withColumn("n_tokens", F.lit(1))
    folder = tempfile.mkdtemp(prefix="tokens-")
    manifest = token_store.write_tokens(docs, folder, PATH, end_id=0)
    rows = token_store.document_starts(manifest).collect()
    order = lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)
    rows.sort(key=lambda r: r.start)
    assert rows == sorted(rows, key=order)
    expected = Counter((r.doc_id, zlib.crc32(ids_of(r.text, 0)), len(ids_of(r.text, 0)) // 4) for r in docs.collect())
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in rows) == expected
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    some = token_store.read_tokens(manifest, {5, 30}).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {
        5: ids_of("ONE", 0), 30: ids_of(sample_docs.filter("doc_id = 30").first().text, 0)
    }
    assert token_store.document_starts(token_store.write_tokens(no_docs, folder + "x", PATH)).collect() == []


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    writer = token_store.Writer(out, frame_bytes=400)
    docs = [(i, struct.pack("<50I", *range(i, i + 50))) for i in range(9)]
    for d in docs:
        writer.add(*d)
    writer.close()
    reader = token_store.Reader(out)
    assert len(reader.frames) == 5 and list(reader.documents()) == docs
    assert list(token_store.Reader(out).documents({7})) == [docs[7]]
    data = bytearray(out.getvalue())
    data[-9 - 12 + 8] ^= 1  # the last frame's checksum in the seek table
    broken = token_store.Reader(io.BytesIO(bytes(data)))
    assert list(broken.documents({0})) == [docs[0]]
    with pytest.raises(ValueError):
        list(broken.documents({8}))


def test_packing_keeps_every_token(docs_of, odd_docs, no_docs, sample_docs):
    docs = sample_docs.unionByName(odd_docs)
    rows = packing.pack(docs.withColumn("item", F.lit(1)), PATH, end_id=2).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 1024
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    expected = Counter()
    for r in docs.collect():
        ids = ids_of(r.text, 2)
        n = len(ids) // 4
        cuts = [0, *range(n % 1024 or min(n, 1024), n + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[r.doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * -(-total // 1024) + 1
    assert packing.pack(no_docs, PATH, end_id=2).collect() == []


def test_genetic_operators_keep_all_pieces():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1024, 300).tolist()
    a = packing.best_fit(sizes, range(300), [], 1024)
    b = packing.mutated(sizes, a, 1024, rng)
    child = packing.crossover(sizes, a, b, 1024, rng)
    for bins in (a, b, child, packing.evolve(sizes, [], 1024, 10, 1)[0]):
        assert sorted(i for x in bins for i in x) == list(range(300))
        assert max(sum(sizes[i] for i in x) for x in bins) <= 1024
    assert len(packing.evolve(sizes, [], 1024, 10, 1)[0]) <= len(a)


def brute_removed(texts, window):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [8, 35])
def test_substrings_against_brute_force(docs_of, odd_docs, no_docs, window):
    rng = random.Random(window)
    words = lambda n: " ".join(rng.choice("abcd") + rng.choice("efg") for _ in range(n))
    shared = [words(n) for n in (34, 35, 36, 60, 200)]
    texts = [" ".join([words(20), rng.choice(shared), words(15), rng.choice(shared)]) for _ in range(30)]
    texts += [shared[1], shared[1], shared[4] + " " + shared[4], "same " * 100]
    docs = docs_of(list(enumerate(texts))).unionByName(odd_docs)
    got = substring_dedup.remove_duplicates(docs.withColumn("row", F.lit("x")), window).collect()
    expected = brute_removed([r.text for r in docs.collect()], window)
    assert sorted((r.n_words, r.n_removed, r.kept) for r in got) == expected
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.remove_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("shard_size", [8192, 150])
def test_vectors_against_brute_force(spark, shard_size):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(20, 16))
    x = np.concatenate([c + rng.normal(size=(n, 16)) * 0.12 for c, n in zip(centers, [1, 2, 40, 200, *[5] * 16])])
    x = np.concatenate([x, x[:30] * 3.0, rng.normal(size=(100, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [float("inf")] * 16]
    rows += [(10_000 + i, v) for i, v in enumerate(odd)] + [(None, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, 0.9, shard_size).collect()}
    assert len(got) == len(rows)
    y = np.concatenate([x, x[50:51]]).astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    linked = y @ y.T >= 0.9
    np.fill_diagonal(linked, False)
    truth, found = linked.sum(axis=1), [got[i].n_links for i in [*range(len(x)), None]]
    assert sum(found) >= 0.99 * truth.sum() and (np.array(found) <= truth).all()
    for i in range(len(x)):
        assert got[i].kept == (got[i].component_id == i)
    for i in range(len(odd)):
        assert (got[10_000 + i].n_links, got[10_000 + i].component_id) == (0, 10_000 + i)
    assert not got[None].kept
    assert vector_dedup.near_duplicates(df.limit(0)).collect() == []


def test_pipeline_stages(spark, sample_docs, odd_docs):
    docs = sample_docs.unionByName(odd_docs)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        path = tempfile.mkdtemp(prefix="stage-") + "/out"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == sample_docs.columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 150
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= counts[-1]
