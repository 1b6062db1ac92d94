"""Uniform shuffle into shards: exact sizes, gapless slots, the law of the matrix."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickweave.llm import queries, sharding


def hypergeometric_pmf(total, good, draws):
    from math import comb

    return {k: comb(good, k) * comb(total - good, draws - k) / comb(total, draws)
            for k in range(max(0, draws + good - total), min(draws, good) + 1)}


@pytest.mark.parametrize("total,good,draws", [(10, 4, 5), (40, 20, 13), (7, 7, 3), (5, 0, 2), (9, 3, 0), (60, 2, 59)])
def test_counts_follow_the_law(spark, total, good, draws):
    n = 4000
    lit = lambda x: F.lit(x).cast("bigint")
    # Evenly spaced numbers give every count its share to within one draw.
    rows = spark.range(n).select(
        sharding.hypergeometric(lit(total), lit(good), lit(draws), (F.col("id") + 0.5) / n).alias("k")
    )
    got = Counter(r.k for r in rows.collect())
    expected = hypergeometric_pmf(total, good, draws)
    assert set(got) <= set(expected)
    assert all(abs(got[k] / n - p) <= 1.5 / n for k, p in expected.items())


def test_matrix_has_exact_margins_and_the_right_mean(spark):
    sizes = [0, 1, 50, 400, 33, 7] + [20] * 300
    blocks = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "block long, rows long")
    sent = {r.block: r.sent for r in sharding.communication_matrix(blocks, 7, seed=3).collect()}
    assert {b: sum(s) for b, s in sent.items()} == {i: n for i, n in enumerate(sizes) if n}
    columns = np.sum(list(sent.values()), axis=0)
    assert columns.max() - columns.min() <= 1 and columns.sum() == sum(sizes)
    # Large block: 400 draws, a seventh each; seven standard deviations are about 50.
    assert all(abs(k - 400 / 7) < 50 for k in sent[3])


def test_one_row_blocks_are_uniform(spark):
    """Whatever the place of a block below its node, every shard gets it equally often."""
    blocks = spark.createDataFrame([(i, 1) for i in range(960)], "block long, rows long")
    seen = np.zeros((16, 4))
    for r in sharding.communication_matrix(blocks, 4).collect():
        seen[r.block % 16] += r.sent
    assert seen.sum(axis=0).tolist() == [240] * 4
    # 60 blocks with probability 1/4: mean 15, deviation 3.4.
    assert seen.min() > 1 and seen.max() < 33


def check(rows, n, shards=24):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1


def test_query_keeps_every_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 3)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op13_sharding(spark, sf).collect()
    check(rows, len(docs))
    expected = sorted((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_odd_rows(spark, odd_docs, no_docs):
    n = odd_docs.count()
    clash = odd_docs.withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "block": F.lit(1), "rows": F.lit(2)})
    for docs in (odd_docs, clash, odd_docs.repartition(5), odd_docs.coalesce(1)):
        rows = sharding.shuffle_to_shards(docs, 24).collect()
        check(rows, n)
        assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(
            map(repr, ((r.doc_id, r.text) for r in docs.collect()))
        )
    assert sharding.shuffle_to_shards(no_docs, 24).collect() == []
    check(sharding.shuffle_to_shards(odd_docs, 3).collect(), n, 3)


def test_a_shuffle_moves_rows(spark):
    rows = sharding.shuffle_to_shards(spark.range(4000).repartition(8), 4, seed=1).orderBy("shard", "slot").collect()
    order = [r.id for r in rows]
    # Neighbours in the result are strangers in the input.
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < 20
    assert abs(np.corrcoef(order, range(4000))[0, 1]) < 0.08


def test_written_shards(spark, tmp_path):
    sharding.write_shards(spark.range(100).select("id", (F.col("id") * 2).alias("twice")), str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    check(back.collect(), 100, 6)
    assert back.filter("twice <> 2 * id").count() == 0
