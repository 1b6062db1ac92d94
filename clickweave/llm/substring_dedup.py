"""Substring deduplication by a relative Lempel-Ziv parse in runs of windows.

A *window* is ``WINDOW`` (35) consecutive words of a document; its words go if the same
sequence also starts anywhere else. Documents are parsed against a reference made of the
documents themselves:

1. *Phrases*: of every window the word 8-gram with the smallest hash is its anchor (the
   rightmost among equals). Consecutive windows with one anchor are a run; the words under a
   run are a phrase. Equal windows have equal anchors, so runs whose anchor stands in one
   place only are literals: nothing in them repeats. Anchors are counted by a shuffle.
2. *Reference*: every distinct phrase once, with the number of its places, dealt to blocks by
   anchor: whatever shares a window with a phrase lies in that phrase's block.
3. *Factors*: a document is read phrase by phrase. A phrase that the reference has from
   another place goes on with the factor, from whatever source; one that it has from this place
   alone ends the factor.
4. *Boundaries*: such a phrase may share some of its windows with others of its block, as where
   a passage starts, ends or changes. Its windows are compared with those of all distinct phrases
   of the block; those met add to the factors beside them.

Factors are at least a window long by construction, and become the removed spans. Only a row
for each phrase is moved, and windows of distinct phrases around boundaries alone. A passage that
fills a third of the corpus is one phrase in the reference after partial aggregation, and otherwise
the larger side of sort-merge joins, which adaptive execution splits.

Words are compared by their 64-bit hashes, phrases by anchor and a second polynomial over these,
windows by two polynomials; neither holds out against words made to collide.

Defined results: a null or blank text has no words; texts shorter than a window lose
nothing; repeated rows are duplicates of each other (all copies go); rows are told apart by
a number of their own, so ties and null ids are no special case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.llm.common import BASE, WordHashes, gram_hashes, materialise, mixed, utf8, window_minima

WINDOW = 35
GRAM = 8
SECOND_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Texts worked on at once, words whose hashes a task remembers, windows sent on at once.
TEXTS, WORDS, ROWS = 256, 150_000, 200_000
#: Rows of a key that stay together: this many, or this part of all rows where that is more.
TOGETHER, PARTS = 1_000, 10_000


#: Powers of ``SECOND_BASE`` and of its inverse mod 2**64, as long as the longest text met.
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", int(SECOND_BASE)), ("down", pow(int(SECOND_BASE), -1, 1 << 64))):
            factors = np.full(2 * n, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


def phrase_hashes(words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the words ``first`` to ``stop`` (exclusive), whatever lies around them."""
    up, down = _powers(len(words) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mixed((sums[stop] - sums[first]) * down[first] ^ mixed((stop - first).astype(np.uint64)))


def runs_of(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window, and phrase hash of the runs of a text's word hashes."""
    grams = gram_hashes(words, gram)
    at = window_minima(grams, window - gram + 1)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1]) if len(at) else np.empty(0, np.int64)
    last = np.append(cuts[1:], len(at))[: len(cuts)] - 1
    return grams[at[cuts]], cuts, last, phrase_hashes(words, cuts, last + window)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few texts each."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _phrases(window: int, gram: int) -> Callable:
    """The runs of each document that has a window, as arrays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(WORDS)
        for batch in _parts(batches):
            rows, parts = [], []
            for row, text in enumerate(utf8(batch.column(1))):
                found = runs_of(hashes(text.split()), window, gram)
                if len(found[0]):
                    rows.append(row)
                    parts.append(found)
            if rows:
                ends = pa.array(np.cumsum([0, *[len(p[0]) for p in parts]]), pa.int32())
                anchor, first, last, phrase = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = (anchor.view(np.int64), first.astype(np.int32), last.astype(np.int32), phrase.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *[pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]],
                    names=["row", "anchor", "first", "last", "phrase"],
                )

    return run


def _windows(window: int) -> Callable:
    """Two hashes of every window of the given runs; (row, place, alone, a, b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(WORDS)
        for batch in _parts(batches):
            for row, (text, own) in enumerate(zip(utf8(batch.column(1)), batch.column(2), strict=True)):
                words, runs = hashes(text.split()), own.values
                first, last = (runs.field(n).to_numpy() for n in ("first", "last"))
                alone = np.repeat(runs.field("alone").to_numpy(zero_copy_only=False), last - first + 1)
                places = np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last, strict=True)])
                a, b = (gram_hashes(words, window, base)[places].view(np.int64) for base in (BASE, SECOND_BASE))
                columns = [pa.array(c) for c in (places.astype(np.int32), alone, a, b)]
                key = batch.column(0).take(pa.array(np.full(len(places), row)))
                found = pa.RecordBatch.from_arrays([key, *columns], names=["row", "place", "alone", "a", "b"])
                for at in range(0, len(places), ROWS):
                    yield found.slice(at, ROWS)

    return run


def factors(first: np.ndarray, last: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans of words under the windows ``first`` to ``last`` of each run, joined where no word lies between."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(last[order]) + window
    cuts = np.flatnonzero(first[1:] > stop[:-1]) + 1
    return list(zip(first[np.append(0, cuts)].tolist(), stop[np.append(cuts, len(stop)) - 1].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _remove(window: int, digest: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            n_words, n_removed, kept, spans = [], [], [], []
            for text, runs in zip(utf8(batch.column(1)), batch.column(2), strict=True):
                words, found = text.split(), []
                if runs.is_valid:
                    found = factors(*(runs.values.field(n).to_numpy().astype(np.int64) for n in ("first", "last")), window)
                rest, at = [], 0
                for start, stop in found:
                    rest += words[at:start]
                    at = stop
                rest = b" ".join(rest + words[at:])
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in found))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8", "replace"))
                spans.append([{"start": a, "stop": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(spans, _SPANS)],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return run


def _having(rows: DataFrame, counts: DataFrame, keys: list[str], by: list[str], total: int) -> DataFrame:
    """The ``rows`` whose ``keys`` are among ``counts`` (``keys`` and ``n``, their rows of ``total`` counted).

    Rows of a frequent key are dealt to slices by ``by``. At most ``PARTS`` keys are frequent, as
    each holds more than that part of the rows counted, so their list may be broadcast.
    """
    together = max(TOGETHER, -(-total // PARTS))
    sliced = counts.withColumn("slices", F.ceil(F.col("n") / together)).drop("n")
    dealt = rows.join(F.broadcast(sliced.filter("slices > 1")), keys, "left")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64(*by), F.coalesce("slices", F.lit(1)))).drop("slices")
    wanted = sliced.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    return dealt.join(wanted, [*keys, "slice"], "left_semi").drop("slice")


def repeated_runs(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``row``, ``runs`` (``first``, ``last``): windows that occur elsewhere too. ``rows``: ``row``, ``text``."""
    key = rows.schema["row"].dataType.simpleString()
    ddl = f"row {key}, anchor array<bigint>, first array<int>, last array<int>, phrase array<bigint>"
    parsed = materialise(rows.mapInArrow(_phrases(window, gram), ddl), "phrases")
    places = parsed.agg(F.sum(F.size("anchor"))).first()[0] or 0
    anchors = parsed.select(F.explode("anchor").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    every = parsed.select("row", F.inline(F.arrays_zip("anchor", "first", "last", "phrase")))
    runs = materialise(_having(every, shared, ["anchor"], ["row", "first"], places), "shared-runs")
    # The reference: distinct phrases, one place of each.
    place = F.min(F.struct("row", "first", "last")).alias("at")
    reference = materialise(runs.groupBy("anchor", "phrase").agg(F.count("*").alias("n"), place), "reference")
    known = reference.filter("n > 1").select("anchor", "phrase", "n")
    whole = _having(runs, known, ["anchor", "phrase"], ["row", "first"], runs.count())
    # Blocks with a phrase of one place and other phrases beside it.
    mixed_blocks = reference.groupBy("anchor").agg(F.count("*").alias("phrases"), F.min("n").alias("least"))
    mixed_blocks = mixed_blocks.filter("phrases > 1 and least = 1").select("anchor", F.col("phrases").alias("n"))
    boundary = _having(reference, mixed_blocks, ["anchor"], ["phrase"], reference.count()).select(
        "at.*", (F.col("n") == 1).alias("alone")
    )
    by_row = boundary.groupBy("row").agg(F.collect_list(F.struct("first", "last", "alone")).alias("runs"))
    texts = rows.join(by_row, "row").select("row", "text", "runs")
    ddl = f"row {key}, place int, alone boolean, a bigint, b bigint"
    windows = materialise(texts.mapInArrow(_windows(window), ddl), "boundary-windows")
    # A phrase has a window once, and the reference a phrase once: two rows are two phrases.
    met = windows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")
    parts = _having(windows.filter("alone"), met, ["a", "b"], ["row", "place"], windows.count())
    found = whole.select("row", "first", "last").unionByName(parts.select("row", F.col("place").alias("first"), F.col("place").alias("last")))
    return found.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def stored_row_key() -> Column:
    """File and place in it of a row that is read from Parquet, however the scan is cut."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def remove_duplicates(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
    row_key: Column | None = None,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by spaces, or the
    SHA-256 of that), ``spans`` (removed words) for every row.

    ``row_key`` tells rows apart, and every scan must give the same one (``stored_row_key``).
    Without it rows are numbered, and the numbered texts are stored once: how a scan is cut
    into tasks, and so the numbers, changes with the executors at hand.
    """
    number = F.monotonically_increasing_id() if row_key is None else row_key
    numbered = docs.select(
        number.alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
    )
    if row_key is None:
        numbered = materialise(numbered, "numbered")
    runs = repeated_runs(numbered.select("row", "text"), window, gram)
    joined = numbered.join(runs, "row", "left").select("doc_id", "text", "runs")
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start: bigint, stop: bigint>>"
    return joined.mapInArrow(_remove(window, digest), ddl)
