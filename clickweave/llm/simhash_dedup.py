"""Near-duplicates by SimHash: fingerprints, a positional byte index, components.

A fingerprint has eight bytes. Two fingerprints that differ in at most ``max_bits`` (4)
bits differ in at most that many bytes, so at least ``8 - max_bits`` bytes agree *in their
positions*: the guaranteed minimum of the count filter. The inverted index lists
fingerprints by (position, byte). Its single lists hold a 256th of the corpus each, so
pairs are not read off them: lists are intersected three positions at a time, with the
fewest triples of positions of which every four agreeing positions contain one (20 for
eight bytes). Within an intersected list the agreeing bytes of a pair are tallied, pairs
that reach the minimum are kept and their bit distance is verified.

Lists longer than ``HOT_LIST`` are intersected with a fourth position before they are
worked on; whatever remains is compared in blocks of bounded size. A list sends on a
spanning forest of its links, at most one row per member, never all pairs.

Defined results: a null or blank text has fingerprint zero, linked like any other. Equal
texts, repeated rows and null ids share their fingerprint's component; an empty table
gives an empty result. ``component_id`` is the smallest id of the component (null if all
its ids are null). Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.llm.common import Union, connected_components, materialise, utf8

BYTES = 8
SEED = 42
#: Members of a list from which on it is split by a further position.
HOT_LIST = 4096
#: Rows that are compared with a list at once.
BLOCK = 512


def simhash(text: bytes, shingle: int) -> int:
    """The 64-bit fingerprint; words are parted by ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64
        )
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, BYTES)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t, shingle) for t in utf8(batch.column(2))], np.uint64).view(np.int64)
        columns = [batch.column(0), batch.column(1), pa.array(prints)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp"])


def fingerprints(
    docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", text_key: Column | None = None
) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed BIGINT) per row, and ``text_key`` if given."""
    key = F.lit(0).cast("bigint") if text_key is None else text_key
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), key.alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id bigint, text_key bigint, fp bigint")


def byte_subsets(agreeing: int) -> list[tuple[int, ...]]:
    """Position sets of which every set of ``agreeing`` byte positions contains one.

    For four agreeing bytes: triples within one of three groups of positions, or with two
    members in a group and one in the next. Any four positions hold such a triple.
    """
    if agreeing != 4:
        return list(combinations(range(BYTES), max(1, agreeing)))
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(BYTES), 3):
        n = [sum(group[i] == g for i in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            out.append(t)
    return out


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (BYTES - 1 - i)).bitwiseAND(F.lit(0xFF))


def _list_key(fp: Column, number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("bigint")
    for i in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, i))
    return F.struct(key.alias("key"), F.lit(number).alias("positions"))


def _links(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one list."""
    n = len(fps)
    if n == 2:
        pairs = [(0, 1)] if _close(fps[:1], fps[1:], max_bits)[0, 0] else []
    else:
        found, pairs = Union(), []
        for i in range(0, n, BLOCK):
            for j in range(i, n, BLOCK):
                a, b = np.nonzero(_close(fps[i : i + BLOCK], fps[j : j + BLOCK], max_bits))
                for x, y in zip((a + i).tolist(), (b + j).tolist(), strict=True):
                    if x < y and found.join(x, y):
                        pairs.append((x, y))
    for x, y in pairs:
        yield int(fps[x]), int(fps[y])


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs with the guaranteed number of agreeing bytes and at most ``max_bits`` differing bits."""
    x = a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]
    agreeing = (x[..., None].view(np.uint8) == 0).sum(axis=-1)
    out = agreeing >= BYTES - max_bits
    out[out] = np.bitwise_count(x[out]) <= max_bits
    return out


def _scan_lists(batches: Iterable[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key; lists are cut where the key changes."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def work(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        many = np.flatnonzero(np.diff(cuts) > 1)
        edges = [e for i in many for e in _links(np.unique(fp[cuts[i] : cuts[i + 1]]), max_bits)]
        return pa.RecordBatch.from_arrays(
            [pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"]
        )

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        # The last list may go on in the next batch.
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if whole:
            yield work(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
    if len(key):
        yield work(key, fp)


def _pairs_of(lists: DataFrame, max_bits: int) -> DataFrame:
    ordered = lists.repartition("key").sortWithinPartitions("key").select("key", "fp")
    return ordered.mapInArrow(partial(_scan_lists, max_bits=max_bits), "a bigint, b bigint")


def fingerprint_links(distinct_fps: DataFrame, max_bits: int = 4, hot_list: int = HOT_LIST) -> DataFrame:
    """``a``, ``b``: links that connect what ``max_bits`` connect, from distinct ``fp`` values."""
    subsets = byte_subsets(BYTES - max_bits)
    fp = F.col("fp")
    keys = F.array(*[_list_key(fp, n, s) for n, s in enumerate(subsets)])
    index = distinct_fps.select("fp", F.inline(keys))
    hot = index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_list).select("key")
    ordinary = index.join(hot, "key", "left_anti").select("key", "fp")
    # A hot list is intersected with each further position: still complete, since pairs in
    # it need one more agreeing byte than the list's own where the minimum exceeds them.
    further = F.array(
        *[
            F.struct(
                F.xxhash64("key", F.lit(i), _byte(fp, i)).alias("key"),
                F.array(*[F.lit(i in s) for s in subsets])[F.col("positions")].alias("own"),
            )
            for i in range(BYTES)
        ]
    )
    if len(subsets[0]) < BYTES - max_bits:
        refined = index.join(hot, "key", "left_semi").select("fp", F.inline(further)).filter("not own")
    else:
        refined = index.join(hot, "key", "left_semi")
    lists = ordinary.unionByName(refined.select("key", "fp"))
    return _pairs_of(lists, max_bits).distinct()


def _components(prints: DataFrame, max_bits: int) -> DataFrame:
    """``fp``, ``root`` (a fingerprint that names the component), ``component_id``."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(classes.select("fp"), max_bits)
    roots = connected_components(links).select(F.col("node").alias("fp"), "component")
    # A class without links is a component of its own.
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialise(rooted.join(named, "root").select("fp", "root", "component_id"), "labels")


def simhash_components(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` for every row of ``docs``."""
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    return prints.join(_components(prints, max_bits), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Null ids come last. Rows of one id are told apart by a hash of their text; of rows
    that agree in both, one stays.
    """
    text_key = F.xxhash64(text_col, F.col(id_col).isNull())
    prints = materialise(fingerprints(docs, shingle, id_col, text_col, text_key), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    # The members of a component are reduced before they meet: per fingerprint, then per root.
    by_print = prints.groupBy("fp").agg(F.min(order).alias("first"))
    first = by_print.join(_components(prints, max_bits), "fp").groupBy("root").agg(F.min("first").alias("first"))
    keys = ["__first_id", "__first_key"]
    key = [F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("text_key").alias(keys[1])]
    # Rows of one id and text cannot be told apart by their key; only their texts are shuffled.
    counts = prints.groupBy(*key).agg((F.count("*") > 1).alias("__repeated"))
    first = first.select("first.*").select(*key).distinct().join(counts, keys)
    keyed = docs.withColumns({keys[0]: F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), keys[1]: text_key})
    kept = keyed.join(materialise(first, "firsts"), keys)
    once = kept.filter(~F.col("__repeated"))
    return once.unionByName(kept.filter("__repeated").dropDuplicates(keys)).select(*docs.columns)
