"""Benchmark decontamination by winnowing.

A *window* is ``length`` (13) consecutive words of a benchmark item; an item of fewer
words is one window. Both sides are cut into k-grams, and of every run of
``window - k + 1`` k-grams the one with the smallest hash is its fingerprint (the rightmost
among equals). The choice depends on the run's words alone, so any span that a document
shares with an item and that is as long as a window has a fingerprint in common with it:
nothing long enough can be missed. Fingerprints of documents and items are joined, every
hit is extended word by word to both sides, and extensions as long as a window count.

Benchmarks are small beside the corpus but not bounded, so they are cut into blocks of at
most ``BLOCK_WORDS`` words; every block is broadcast and a task holds one at a time. The
corpus is read once, without a shuffle, and no group is ever gathered.

Defined results: a null or wordless text has no words and no hits; an item without words
or with a null id is never reported; items that repeat an id count once; empty tables on
either side give no hits. Only the named columns of either table are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.llm.common import WordHashes, gram_hashes, plain_words, utf8, window_minima

LENGTH = 13
GRAM = 5
BLOCK_WORDS = 4_000_000
#: Words of documents that are worked on at once.
CHUNK_WORDS = 200_000
#: Stands between documents; no word hash of an item equals it but by a chance of 2**-64.
GAP = np.uint64(0x5EED_0F_6A95_0001)

FOUND = "struct<n_words: bigint, hits: array<struct<start: bigint, stop: bigint>>, items: array<string>>"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


@dataclass
class Block:
    """A part of the benchmark: items end to end, and their fingerprints by window length."""

    words: np.ndarray
    starts: np.ndarray
    ids: list[str]
    by_length: dict[int, tuple[int, np.ndarray, np.ndarray]]


def _fingerprints(words: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen k-grams of all windows of ``length`` words."""
    grams = gram_hashes(words, k)
    at = np.unique(window_minima(grams, length - k + 1))
    return at, grams[at]


def _block(items: list[tuple[str, np.ndarray]], length: int, gram: int) -> Block:
    sizes = np.array([len(w) for _, w in items], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for (_, words), start in zip(items, starts[:-1], strict=True):
        window = min(length, len(words))
        at, hashes = _fingerprints(words, min(gram, window), window)
        found.setdefault(window, []).append((at + start, hashes))
    by_length = {}
    for window, parts in found.items():
        at, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, hashes))
        by_length[window] = (min(gram, window), hashes[order], at[order])
    return Block(np.concatenate([w for _, w in items]), starts, [i for i, _ in items], by_length)


def benchmark_blocks(
    benchmark: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    block_words: int = BLOCK_WORDS,
) -> list[Broadcast]:
    """The benchmark's blocks, each broadcast; the driver holds one block while it builds it."""
    sc, hashes, out = benchmark.sparkSession.sparkContext, WordHashes(), []
    items: list[tuple[str, np.ndarray]] = []
    total = 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).dropna()
    for item, text in rows.toLocalIterator():
        words = hashes(plain_words(text.encode("utf-8", "surrogatepass")))
        # An item longer than a block goes into several, which share a window less a word.
        for i in range(0, max(1, len(words) - length + 1), block_words):
            part = words[i : i + block_words + length - 1]
            if len(part):
                items.append((item, part))
                total += len(part)
            if total >= block_words:
                out.append(sc.broadcast(_block(items, length, gram)))
                items, total = [], 0
    if items:
        out.append(sc.broadcast(_block(items, length, gram)))
    return out


def _extended(block: Block, window: int, words: np.ndarray, x: int, y: int, item: int) -> tuple[int, int] | None:
    """The span of ``words`` around ``x`` that agrees with the item around ``y``, if long enough."""
    low, high = int(block.starts[item]), int(block.starts[item + 1])
    left = min(x, y - low)
    differ = np.flatnonzero(words[x - left : x] != block.words[y - left : y])
    start = x - left + (int(differ[-1]) + 1 if len(differ) else 0)
    right = min(len(words) - x, high - y)
    differ = np.flatnonzero(words[x : x + right] != block.words[y : y + right])
    stop = x + (int(differ[0]) if len(differ) else right)
    return (start, stop) if stop - start >= window else None


def _hits(block: Block, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, stop, item) of the maximal spans that ``words`` shares with items of the block."""
    for window, (k, hashes, at) in block.by_length.items():
        mine, mine_hashes = _fingerprints(words, k, window)
        first = np.searchsorted(hashes, mine_hashes, "left")
        last = np.searchsorted(hashes, mine_hashes, "right")
        done: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(last > first).tolist():
            x = int(mine[i])
            places = at[first[i] : last[i]]
            owners = np.searchsorted(block.starts, places, "right") - 1
            for y, item in zip(places.tolist(), owners.tolist(), strict=True):
                # A span is extended once, whatever the number of fingerprints in it.
                if x >= done.get((item, x - y), -1) and (span := _extended(block, window, words, x, y, item)):
                    done[item, x - y] = span[1]
                    yield *span, item


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _chunks(texts: list[bytes], hashes: WordHashes) -> Iterator[tuple[list[int], np.ndarray]]:
    """Documents end to end with a gap after each: where each starts (and the end), the words."""
    starts, parts, total = [0], [], 0
    for text in texts:
        words = plain_words(text)
        parts.append(hashes(words))
        parts.append(np.array([GAP]))
        total += len(words) + 1
        starts.append(total)
        if total >= CHUNK_WORDS:
            yield starts, np.concatenate(parts)
            starts, parts, total = [0], [], 0
    if parts:
        yield starts, np.concatenate(parts)


def _search(blocks: list[Broadcast], texts: list[bytes], hashes: WordHashes) -> list[dict]:
    chunks = list(_chunks(texts, hashes))
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    items: dict[tuple[int, int], set[str]] = {}
    for held in blocks:
        block = held.value
        for c, (starts, words) in enumerate(chunks):
            for start, stop, item in _hits(block, words):
                doc = int(np.searchsorted(starts, start, "right")) - 1
                spans.setdefault((c, doc), []).append((start - starts[doc], stop - starts[doc]))
                items.setdefault((c, doc), set()).add(block.ids[item])
        if len(blocks) > 1:
            # A broadcast keeps what it has loaded; a task is to hold one block at a time.
            vars(held).pop("_value", None)
    out = []
    for c, (starts, _) in enumerate(chunks):
        for doc in range(len(starts) - 1):
            hits = [{"start": a, "stop": b} for a, b in _merged(spans.get((c, doc), []))]
            n = starts[doc + 1] - starts[doc] - 1
            out.append({"n_words": n, "hits": hits, "items": sorted(items.get((c, doc), ()))})
    return out


def contamination(text: Column, blocks: list[Broadcast]) -> Column:
    """``n_words``, ``hits`` (word spans, disjoint, in order) and ``items`` (sorted ids) of a text."""
    hashes = WordHashes()

    @F.arrow_udf(FOUND)
    def search(column: pa.Array) -> pa.Array:
        return pa.array(_search(blocks, utf8(column), hashes), _FOUND)

    return search(text)


def n_hit(found: Column) -> Column:
    """Words inside hits."""
    return F.aggregate(found["hits"], F.lit(0).cast("bigint"), lambda n, h: n + h["stop"] - h["start"])


def is_contaminated(found: Column, one_in: int = 20) -> Column:
    """Whether at least every ``one_in``-th word is inside a hit."""
    return (n_hit(found) > 0) & (n_hit(found) * one_in >= found["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without those that the benchmark contaminates; null texts stay."""
    blocks = benchmark_blocks(benchmark)
    marked = docs.withColumn("__found", contamination(F.col(text_col), blocks))
    return marked.filter(~is_contaminated(F.col("__found"))).drop("__found")
