"""Running values against plain windows, with hot keys and narrow chunks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickweave.operators.running import Running, hot_keys, running, time_chunk

KINDS = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for seq in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}"
        data.append((key, rng.randrange(20_000), seq, rng.choice([None, 1, 5, -3, 40])))
    return spark.createDataFrame(data, "key string, ts long, seq long, x int").cache()


@pytest.mark.parametrize("width", [1, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_equals_plain_window(rows, width, inclusive, both_ways):
    values = [Running(k, k, F.col("x"), inclusive) for k in KINDS]
    got = running(rows, ["key"], ["ts", "seq"], values, time_chunk(F.col("ts"), width))
    w = Window.partitionBy("key").orderBy("ts", "seq")
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.withColumns({k: f(F.col("x")).over(w) for k, f in KINDS.items()})
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_keys(rows):
    got = running(rows, [], ["ts", "seq"], [Running("n", "sum", F.lit(1))], time_chunk(F.col("ts"), 500))
    assert [r.n for r in got.orderBy("ts", "seq").collect()] == list(range(1, 3001))


def test_chunk_that_adds_nothing_still_inherits(table, both_ways):
    df = table("key string, ts long, seq long, x int", ("a", 1, 1, 5), ("a", 11, 2, None), ("a", 21, 3, None))
    got = running(df, ["key"], ["ts", "seq"], [Running("l", "last", F.col("x"))], time_chunk(F.col("ts"), 10))
    assert {r.seq: r.l for r in got.collect()} == {1: 5, 2: 5, 3: 5}


def test_initial_values(table, both_ways):
    df = table("key string, ts long, seq long, x int", ("a", 1, 1, None), ("a", 11, 2, 4), ("b", 1, 3, 1))
    initial = table("key string, total int, latest int", ("a", 10, 7), ("z", 1, 1))
    values = [Running("total", "sum", F.col("x")), Running("latest", "last", F.col("x"), inclusive=False)]
    got = running(df, ["key"], ["ts", "seq"], values, time_chunk(F.col("ts"), 10), initial)
    assert {r.seq: (r.total, r.latest) for r in got.collect()} == {1: (10, 7), 2: (14, 7), 3: (1, None)}


def test_only_the_hot_key_goes_by_chunk(spark, rows):
    spark.conf.set("spark.clickweave.hotKeyRows", "500")
    try:
        assert [r.key for r in hot_keys(rows, ["key"]).collect()] == ["hot"]
        values = [Running("n", "sum", F.lit(1))]
        got = running(rows, ["key"], ["ts", "seq"], values, time_chunk(F.col("ts"), 100))
        w = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
        want = rows.withColumn("n", F.sum(F.lit(1)).over(w))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.clickweave.hotKeyRows")


def test_hot_key_is_spread_over_tasks(spark, rows):
    spark.conf.set("spark.clickweave.hotKeyRows", "500")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(rows, ["key"], ["ts", "seq"], [Running("n", "sum", F.lit(1))], time_chunk(F.col("ts"), 100))
        tasks = got.filter("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.clickweave.hotKeyRows")
    assert tasks == 4


def test_null_keys_are_split_too(spark, rows):
    spark.conf.set("spark.clickweave.hotKeyRows", "500")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed = rows.withColumn("key", F.when(F.col("key") != "hot", F.col("key")))
        got = running(keyed, ["key"], ["ts", "seq"], [Running("n", "sum", F.lit(1))], time_chunk(F.col("ts"), 100))
        nulls = got.filter("key is null").select("n", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.clickweave.hotKeyRows")
    assert sorted(r.n for r in nulls) == list(range(1, rows.filter("key = 'hot'").count() + 1))
    assert len({r.p for r in nulls}) > 1
