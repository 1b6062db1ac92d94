"""As-of joins against a nested loop, both ways of the running values."""

import random

import pytest
from pyspark.sql import functions as F

from clickweave.operators.asof import asof_join


def brute(left, right, tolerance, inclusive):
    out = []
    for k, t, i in left:
        fits = [(rt, tie, v) for rk, rt, tie, v in right
                if None not in (k, t, rt) and rk == k and (rt <= t if inclusive else rt < t) and (tolerance is None or t - rt <= tolerance)]
        out.append((k, t, i, max(fits)[1:] if fits else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tolerance,inclusive", [(None, True), (5, True), (5, False), (0, True)])
def test_against_a_nested_loop(spark, both_ways, tolerance, inclusive):
    """Half of all rows are of one key; times tie, and some keys and times are NULL."""
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 4 + ["b", "c", "d", None])
    time = lambda: rng.choice([*range(40), None])
    left = [(key(), time(), i % 90) for i in range(100)]
    right = [(key(), time(), i, f"v{i}") for i in range(60)]
    l = spark.createDataFrame(left, "k string, t long, i long")
    r = spark.createDataFrame(right, "k string, at long, tie long, v string")
    got = asof_join(l, r, ["k"], "t", "at", "tie", "x", tolerance, inclusive, chunk_ms=7)
    rows = sorted(((r.k, r.t, r.i, (r.x.tie, r.x.v) if r.x else None) for r in got.collect()), key=repr)
    assert rows == brute(left, right, tolerance, inclusive)


def test_no_rows_on_one_side(spark):
    l = spark.createDataFrame([("a", 1)], "k string, t long")
    r = spark.createDataFrame([], "k string, at long, tie long")
    assert [(x.k, x.x) for x in asof_join(l, r, ["k"], "t", "at", "tie", "x").collect()] == [("a", None)]
    assert asof_join(l.filter(F.lit(False)), r, ["k"], "t", "at", "tie", "x").collect() == []
