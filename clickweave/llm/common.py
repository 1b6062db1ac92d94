"""What several operators share: scratch tables, word hashes, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickweave.session import scratch_dir

#: Multiplier of the polynomial hash over word hashes; odd, so it can be inverted mod 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back.

    Cuts the lineage: the rows survive the loss of any executor and are computed once.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Lower-cases A-Z and blanks every ASCII character that is no letter or digit.
_LETTERS_DIGITS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased."""
    return text.translate(_LETTERS_DIGITS).split()


class WordHashes:
    """64-bit hashes of words, remembered for as many words as ``limit``."""

    def __init__(self, limit: int = 400_000) -> None:
        self.limit, self.known = limit, {}

    def __call__(self, words: list) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 7)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes stirred, so that any order of them is as good as random."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, one per start.

    A polynomial mod 2**64, put together from runs of doubling length: log2(k) passes.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, run, width, left = None, 0, words, 1, k
    while left:
        if left & 1:
            part = run[done : done + n]
            out = part if out is None else out * _power(base, width) + part
            done += width
        left >>= 1
        if left:
            run = run[: len(run) - width] * _power(base, width) + run[width:]
            width *= 2
    return mixed(out)


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum of each window of ``w`` values, the rightmost among equals.

    One position per window; the choice depends on the window's values alone.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = h, np.arange(len(h), dtype=np.int64)
    width = 1
    while width < w:
        step = min(width, w - width)
        a, b = best[: len(best) - step], best[step:]
        right = b <= a
        best = np.where(right, b, a)
        at = np.where(right, at[step:], at[: len(at) - step])
        width += step
    return at[:n]


class Union:
    """Union-find over any hashable nodes; the root is the smallest node of its set."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = parent.setdefault(x, x)
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _local_stars(batches: Iterable[pa.RecordBatch], limit: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Edges of a partition reduced to (node, root) rows; sends what it has beyond ``limit`` nodes."""
    found = Union()

    def stars() -> pa.RecordBatch:
        rows = [(x, r) for x in found.parent if (r := found.root(x)) != x]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"]
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.join(a, b)
        if len(found.parent) > limit:
            yield stars()
            found = Union()
    yield stars()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of all nodes of ``edges`` (two BIGINT columns).

    Alternating large-star and small-star steps, every round written to the shared folder;
    a round only aggregates minima and joins them back, so a busy node is a busy join key
    at worst, which adaptive execution splits. Edges of a partition are contracted before
    they are shuffled. Isolated nodes don't occur in the result.
    """
    u, v = edges.columns
    now = edges.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).filter("u <> v")
    now = materialise(now.mapInArrow(_local_stars, "u bigint, v bigint"), label)
    before = None
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Equal ends mean that a node has met itself; such rows say nothing.
        now = materialise(
            small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), label
        )
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
