"""Phrases of words that stand together more often than their parts would by chance.

Words get ids by shuffle, no task needs all of them: a task writes a row per chunk and
language with its distinct words and its text as a stream of their places. The words are dealt to
buckets by a hash, a row per chunk and bucket; a bucket's words are summed up and those with
enough occurrences numbered in one place, which gives each chunk its numbers back in a row. A rarer
word cannot be part of a phrase that is frequent enough, so it becomes a gap, like the end of a piece.

N-grams of 2 to ``longest`` words are then counted level by level. An n-gram is looked at
only where both (n-1)-grams in it are frequent, which loses nothing. Counters are
counting quotient filters: the n-gram's packed ids are permuted invertibly (rounds that add to one
id a hash of the others), the upper bits of the result are the quotient, all the rest is
the remainder. A filter holds its n-grams in that order as bits (how many an occupied quotient
has), remainders and counters of as many bytes as needed; nothing is hashed away, so counts are exact and
the n-gram is had back from it. Filters are cut by quotient into ranges; the filters of
all chunks for a range are merged in a task by sorting what already is in order, and each
chunk gets back a bit per entry that says which of its n-grams are frequent.

Scores follow by joins on the n-gram's ids: the counts of both parts of each cut, and the
counts of longer phrases that hold a candidate. They are whole numbers of 38 digits. The first rows
of a language are found among ranks within salted parts of it, then among those left.

Defined results: null and empty texts have no words; a null language is ``und``; null ids and
repeated rows count like others; ties go by count and phrase; an empty table, or one without frequent
phrases, gives no rows; only the named columns are read.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickweave.llm.common import materialise, mixed

#: Bytes of text of a chunk (a language's part of it is one row); a longer text is a chunk of its own.
CHUNK = 16_000_000
#: Occurrences that a range of quotients is expected to hold.
RANGE_WORDS = 2_000_000
#: Rows of chunks that a task works on, about.
ROWS_PER_TASK = 4
#: Parts of a language that are ranked side by side.
SALTS = 64
#: Distinct words of chunks that a bucket is expected to hold, in which they are numbered.
BUCKET_WORDS = 1_000_000

# Where pieces end, what parts words, and the letters that are lower-cased.
_ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"\n" * 10)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PREPARED = bytes(_LOWER[_ENDS[c]] for c in range(256))
_WORD = re.compile(rb"[^ \t\n]+|\n")


# --- counting quotient filters --------------------------------------------------------


def _stir(grams: np.ndarray, column: int) -> np.ndarray:
    """A hash of every column but one."""
    h = np.full(len(grams), 0x9E3779B97F4A7C15 + column, np.uint64)
    for k in range(grams.shape[1]):
        if k != column:
            h = mixed(h ^ grams[:, k].astype(np.uint64))
    return h.astype(np.uint32)


def permute(grams: np.ndarray) -> np.ndarray:
    """An invertible permutation of rows of unsigned 32-bit ids; the first column comes out even."""
    out = grams.copy()
    for column in (*range(out.shape[1]), 0):
        out[:, column] += _stir(out, column)
    return out


def restore(keys: np.ndarray) -> np.ndarray:
    """What ``permute`` was given."""
    out = keys.copy()
    for column in (0, *reversed(range(out.shape[1]))):
        out[:, column] -= _stir(out, column)
    return out


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    # Bytes of one weight side by side compress better.
    return struct.pack("<B", width) + raw.T.tobytes()


def _widened(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    width = data[0]
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, n * width, 1).reshape(width, n).T
    return raw.view("<u8").ravel(), 1 + n * width


def filter_of(keys: np.ndarray, counts: np.ndarray, quotient_bits: int) -> bytes:
    """Permuted keys, in order, and their counts as a counting quotient filter.

    The quotient, the upper bits of the first column, is told by place: the first entry of each
    occupied quotient is marked, and occupied quotients are kept as distances. The lower bits of the
    column and all other columns are the remainder.
    """
    n, m = keys.shape
    shift = np.uint32(32 - quotient_bits)
    quotient = keys[:, 0] >> shift
    first = np.concatenate([[True], quotient[1:] != quotient[:-1]]) if n else np.zeros(0, bool)
    occupied = np.diff(quotient[first].astype(np.int64), prepend=0)
    low = keys[:, 0] & np.uint32((1 << int(shift)) - 1)
    parts = [np.packbits(first).tobytes(), _narrow(occupied), _narrow(low)]
    parts += [_narrow(keys[:, k]) for k in range(1, m)] + [_narrow(counts)]
    head = struct.pack("<IBBI", n, m, quotient_bits, int(first.sum()))
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def entries_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Permuted keys in order, and their counts, of a filter."""
    n, m, quotient_bits, n_first = struct.unpack_from("<IBBI", data)
    body = memoryview(zstandard.ZstdDecompressor().decompress(data[10:]))
    marks = (n + 7) // 8
    first = np.unpackbits(np.frombuffer(body, np.uint8, marks), count=n).astype(bool)
    occupied, used = _widened(body[marks:], n_first)
    at = marks + used
    columns = []
    for _ in range(m + 1):
        values, used = _widened(body[at:], n)
        columns.append(values)
        at += used
    quotient = np.cumsum(occupied)[np.cumsum(first) - 1] if n else np.zeros(0, np.uint64)
    keys = np.empty((n, m), np.uint32)
    keys[:, 0] = (quotient << np.uint64(32 - quotient_bits)) | columns[0]
    for k in range(1, m):
        keys[:, k] = columns[k]
    return keys, columns[m].astype(np.int64)


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned 32-bit numbers, two columns compared at once."""
    m = keys.shape[1]
    wide = [keys[:, k].astype(np.uint64) << np.uint64(32) | keys[:, k + 1] for k in range(0, m - 1, 2)]
    if m % 2:
        wide.append(keys[:, m - 1].astype(np.uint64))
    if len(wide) == 1:
        return np.argsort(wide[0], kind="stable")
    return np.lexsort(wide[::-1])


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where another key begins, of keys in order."""
    if not len(keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))


def merged(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of several filters as one, and for each entry of them, one filter after the
    other, its place in the result."""
    entries = [entries_of(f) for f in filters]
    keys, counts = np.concatenate([k for k, _ in entries]), np.concatenate([c for _, c in entries])
    order = _order(keys)
    keys, counts = keys[order], counts[order]
    starts = _runs(keys)
    place = np.empty(len(keys), np.int64)
    marks = np.zeros(len(keys), np.int64)
    marks[starts] = 1
    place[order] = np.cumsum(marks) - 1
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts, place


# --- words ------------------------------------------------------------------------------

_STREAM = pa.schema(
    [("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())), ("stream", pa.binary())]
)
STREAMS = "chunk bigint, lang string, words array<binary>, times array<bigint>, stream binary"


def _stream_row(chunk: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    """A language's texts of a chunk: distinct words, how often, and their places, a gap (0) between pieces."""
    found = _WORD.findall(b"\n".join(texts).translate(_PREPARED))
    times = Counter(found)
    times.pop(b"\n", None)
    number = {w: k for k, w in enumerate(times, 1)}
    number[b"\n"] = 0
    stream = np.fromiter(map(number.__getitem__, found), np.uint32, len(found))
    values = [[chunk], [lang], [list(times)], [list(times.values())], [zstandard.ZstdCompressor(level=1).compress(stream.tobytes())]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _STREAM, strict=True)], schema=_STREAM)


def _streams(size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts, held = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            langs, raw = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for lang, text in zip(langs, raw, strict=True):
                text = text or b""
                if texts and held + len(text) > size:
                    for part in sorted(texts):
                        yield _stream_row(chunk, part, texts[part])
                    chunk, texts, held = chunk + 1, {}, 0
                texts.setdefault("und" if lang is None else lang, []).append(text)
                held += len(text)
        for part in sorted(texts):
            yield _stream_row(chunk, part, texts[part])

    return run


def _unzipped(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of word ids from streams of places: unknown words are gaps, and a gap is one 0 long."""
    for batch in batches:
        for row in range(batch.num_rows):
            chunk, lang, stream, places, ids = [batch.column(k)[row] for k in range(5)]
            local = _unzipped(stream.as_py())
            table = np.zeros((int(local.max()) if len(local) else 0) + 1, np.uint32)
            table[places.values.to_numpy()] = ids.values.to_numpy()
            out = table[local]
            kept = (out != 0) | np.concatenate([[False], out[:-1] != 0]) if len(out) else np.zeros(0, bool)
            data = zstandard.ZstdCompressor(level=1).compress(out[kept].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py()], t) for x, t in ((chunk, pa.int64()), (lang, pa.string()))] + [pa.array([data], pa.binary())],
                names=["chunk", "lang", "stream"],
            )


def _together(streams: DataFrame, more: DataFrame, rows: int) -> DataFrame:
    """Rows of chunks with what came back for them. Few bytes may be much work, so the number of
    tasks follows the rows."""
    tasks = max(1, -(-rows // ROWS_PER_TASK))
    return streams.repartition(tasks, "chunk", "lang").join(more.repartition(tasks, "chunk", "lang"), ["chunk", "lang"])


_DEALT = pa.schema(
    [("chunk", pa.int64()), ("lang", pa.string()), ("bucket", pa.int32()), ("words", pa.list_(pa.binary())),
     ("times", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))]
)
DEALT = "chunk bigint, lang string, bucket int, words array<binary>, times array<bigint>, places array<bigint>"


def _dealt(buckets: int) -> Callable:
    """The distinct words of a chunk in buckets, each with its place in the chunk, from 1 on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, lang, words, times = [batch.column(k)[row] for k in range(4)]
                words, times = words.values, times.values
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))
                bucket = (hashes % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                ends = pa.array(np.append(cuts[full], len(order)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (words.take(pa.array(order)), times.take(pa.array(order)), pa.array(order + 1))]
                columns = [pa.array([x.as_py()] * len(full), t) for x, t in ((chunk, pa.int64()), (lang, pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(full, pa.int32()), *lists], schema=_DEALT)

    return run


_KNOWN = pa.schema(
    [("chunk", pa.int64()), ("lang", pa.string()), ("places", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())),
     ("word", pa.binary()), ("id", pa.int64()), ("count", pa.int64())]
)
KNOWN = "chunk bigint, lang string, places array<bigint>, ids array<bigint>, word binary, id bigint, count bigint"


def _known(least: int, buckets: int) -> Callable:
    """A bucket's words of all chunks as one: a row per chunk with the places and ids of its words that
    are frequent, and a row per such word with its id and count."""

    def run(table: pa.Table) -> pa.Table:
        lang, bucket = table.column("lang")[0].as_py(), table.column("bucket")[0].as_py()
        flat = lambda name: pa.chunked_array([c.flatten() for c in table.column(name).chunks]).combine_chunks()
        encoded = flat("words").dictionary_encode()
        at, words = encoded.indices.to_numpy(), encoded.dictionary
        times, places = flat("times").to_numpy(), flat("places").to_numpy()
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, at, times)
        often = np.flatnonzero(counts >= least)
        # In the order of the words, so that a retried task numbers them alike. From 1 on, 0 is a gap.
        found = words.take(pa.array(often)).to_pylist()
        order = sorted(range(len(found)), key=found.__getitem__)
        ids = np.zeros(len(words), np.int64)
        ids[often[order]] = np.arange(len(order)) * buckets + bucket + 1
        here = ids[at]
        kept = np.concatenate([[0], np.cumsum(here > 0)])
        sizes = np.array([len(w) for c in table.column("words").chunks for w in c], np.int64)
        ends = kept[np.concatenate([[0], np.cumsum(sizes)])]
        rows = np.flatnonzero(np.diff(ends))
        cuts = pa.array(np.append(ends[rows], ends[-1]), pa.int32())
        n, k = len(rows), len(found)
        chunks = table.column("chunk").to_numpy()[rows]
        of_chunks = [
            pa.array(chunks, pa.int64()), pa.array([lang] * n, pa.string()),
            *(pa.ListArray.from_arrays(cuts, pa.array(x[here > 0])) for x in (places, here)),
            *(pa.nulls(n, _KNOWN.field(c).type) for c in ("word", "id", "count")),
        ]
        of_words = [
            pa.nulls(k, pa.int64()), pa.array([lang] * k, pa.string()), *(pa.nulls(k, _KNOWN.field(c).type) for c in ("places", "ids")),
            pa.array(found, pa.binary()), pa.array(ids[often]), pa.array(counts[often]),
        ]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, schema=_KNOWN) for x in (of_chunks, of_words)])

    return run


def word_streams(docs: DataFrame, least: int, chunk: int, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Streams of frequent words' ids per chunk and language, those words (``lang``, ``word``, ``id``,
    ``count``; ids are a language's own), and the number of all words per language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    streams = materialise(rows.mapInArrow(_streams(chunk), STREAMS), "streams")
    of_chunk = F.aggregate("times", F.lit(0).cast("bigint"), lambda s, x: s + x)
    totals = streams.groupBy("lang").agg(F.sum(of_chunk).alias("n")).filter("n > 0")
    n_rows, n_words = streams.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    buckets = max(8, -(-n_words // BUCKET_WORDS))
    dealt = streams.select("chunk", "lang", "words", "times").mapInArrow(_dealt(buckets), DEALT).repartition(2 * buckets, "lang", "bucket")
    level = materialise(dealt.groupBy("lang", "bucket").applyInArrow(_known(least, buckets), KNOWN), "words")
    known = level.filter("word IS NOT NULL").select("lang", "word", "id", "count")
    back = (
        level.filter("chunk IS NOT NULL").groupBy("chunk", "lang").agg(F.collect_list(F.struct("places", "ids")).alias("v"))
        .select("chunk", "lang", F.flatten("v.places").alias("places"), F.flatten("v.ids").alias("ids"))
    )
    both = _together(streams.select("chunk", "lang", "stream"), back, n_rows)
    both = both.select("chunk", "lang", "stream", "places", "ids")
    ids = both.mapInArrow(_numbered, "chunk bigint, lang string, stream binary")
    return materialise(ids, "word-ids"), known, totals


# --- n-grams -----------------------------------------------------------------------------

FILTERS = "chunk bigint, lang string, range int, filter binary"
_FILTERS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("range", pa.int32()), ("filter", pa.binary())])


def _grams(stream: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    return np.stack([stream[at + k] for k in range(m)], axis=1) if len(at) else np.empty((0, m), np.uint32)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys[:, 0].astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _sorted_grams(stream: np.ndarray, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Permuted n-grams at ``at``: the distinct keys in order, their counts, and each one's entry."""
    keys = permute(_grams(stream, at, m))
    order = _order(keys)
    keys = keys[order]
    starts = _runs(keys)
    counts = np.diff(np.append(starts, len(keys)))
    entry = np.empty(len(keys), np.int64)
    entry[order] = np.repeat(np.arange(len(starts)), counts)
    return keys[starts], counts, entry


def _places(stream: np.ndarray, m: int) -> np.ndarray:
    """Where ``m`` words without a gap begin."""
    words = np.concatenate([[0], np.cumsum(stream != 0)])
    return np.flatnonzero(words[m:] - words[:-m] == m) if len(stream) >= m else np.empty(0, np.int64)


def _segments(stream: np.ndarray, places: np.ndarray, m: int) -> np.ndarray:
    """The words of n-grams of ``m`` words at ``places``, and no other n-gram: each run of consecutive
    places with its words, and a gap after it."""
    first = np.concatenate([[True], np.diff(places) > 1])
    starts = places[first]
    lengths = np.diff(np.append(np.flatnonzero(first), len(places))) + m
    begins = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(starts - begins, lengths)
    out = stream[np.minimum(at, len(stream) - 1)]
    out[begins + lengths - 1] = 0
    return out


def _filters(m: int, ranges: int, bits: int) -> Callable:
    """Filters of the n-grams of ``m`` words of each stream, one per range of quotients."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, lang, stream = [batch.column(k)[row].as_py() for k in range(3)]
                ids = _unzipped(stream)
                keys, counts, _ = _sorted_grams(ids, _places(ids, m), m)
                cuts = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
                full = np.flatnonzero(np.diff(cuts))
                data = [filter_of(keys[cuts[r] : cuts[r + 1]], counts[cuts[r] : cuts[r + 1]], bits) for r in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(full), pa.int64()), pa.array([lang] * len(full), pa.string()),
                     pa.array(full, pa.int32()), pa.array(data, pa.binary())], schema=_FILTERS,
                )

    return run


MERGED = "chunk bigint, lang string, range int, frequent binary, gram binary, count bigint"
_MERGED = pa.schema(
    [("chunk", pa.int64()), ("lang", pa.string()), ("range", pa.int32()), ("frequent", pa.binary()), ("gram", pa.binary()),
     ("count", pa.int64())]
)


def _merge(least: int) -> Callable:
    """A range's filters of all chunks as one: a row per chunk with a bit per entry, and a row per
    frequent n-gram (its ids, 4 bytes each, the highest first) with its count."""

    def run(table: pa.Table) -> pa.Table:
        chunks, filters = table.column("chunk").to_pylist(), table.column("filter").to_pylist()
        lang, part = table.column("lang")[0].as_py(), table.column("range")[0].as_py()
        keys, counts, place = merged(filters)
        often = counts >= least
        sizes = np.array([struct.unpack_from("<I", f)[0] for f in filters])
        bits = np.split(often[place], np.cumsum(sizes)[:-1])
        marked = [np.packbits(b).tobytes() for b in bits]
        grams = restore(keys[often]).astype(">u4")
        width = grams.shape[1] * 4
        raw = grams.tobytes()
        found = [raw[i : i + width] for i in range(0, len(raw), width)]
        n, k = len(chunks), len(found)
        columns = [
            chunks + [None] * k, [lang] * (n + k), [part] * (n + k), marked + [None] * k, [None] * n + found,
            [None] * n + counts[often].tolist(),
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MERGED, strict=True)], schema=_MERGED)

    return run


def _pruned(m: int, ranges: int) -> Callable:
    """Streams of what n-grams of ``m + 1`` words may be frequent: both of ``m`` words in them are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, lang, stream, marks = [batch.column(k)[row].as_py() for k in range(4)]
                ids = _unzipped(stream)
                places = _places(ids, m)
                keys, _, entry = _sorted_grams(ids, places, m)
                cuts = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
                often = np.zeros(len(keys), bool)
                for mark in marks:
                    start, stop = cuts[mark["range"]], cuts[mark["range"] + 1]
                    often[start:stop] = np.unpackbits(np.frombuffer(mark["frequent"], np.uint8), count=stop - start)
                good = places[often[entry]]
                both = good[:-1][np.diff(good) == 1]
                if len(both):
                    left = zstandard.ZstdCompressor(level=1).compress(_segments(ids, both, m + 1).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk], pa.int64()), pa.array([lang], pa.string()), pa.array([left], pa.binary())],
                        names=["chunk", "lang", "stream"],
                    )

    return run


def frequent_grams(streams: DataFrame, words: int, least: int, longest: int) -> DataFrame:
    """``lang``, ``gram`` (ids), ``size``, ``count`` of every n-gram of 2 to ``longest`` ids of the streams
    with at least ``least`` occurrences; ``words`` is the number of occurrences of ids."""
    ranges = max(8, -(-words // RANGE_WORDS))
    bits = max(1, min(31, (max(words, 2) // ranges).bit_length() + ranges.bit_length()))
    here, rows = streams, streams.count()
    found = None
    for m in range(2, longest + 1):
        filters = here.mapInArrow(_filters(m, ranges, bits), FILTERS).repartition(2 * ranges, "lang", "range")
        level = materialise(filters.groupBy("lang", "range").applyInArrow(_merge(least), MERGED), f"grams-{m}")
        grams = level.filter("gram IS NOT NULL").select("lang", "gram", F.lit(m).alias("size"), "count")
        found = grams if found is None else found.unionByName(grams)
        if m < longest:
            marks = level.filter("chunk IS NOT NULL").groupBy("chunk", "lang").agg(F.collect_list(F.struct("range", "frequent")).alias("marks"))
            both = _together(here, marks, rows).select("chunk", "lang", "stream", "marks")
            here = materialise(both.mapInArrow(_pruned(m, ranges), "chunk bigint, lang string, stream binary"), f"left-{m}")
    return found


# --- scores ------------------------------------------------------------------------------


def _part(start: int | Column, size: int | Column) -> Column:
    """``size`` ids of a packed n-gram from the id numbered ``start`` on."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring("gram", lit(start) * 4 + 1, lit(size) * 4)


def scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``a``, ``l``, ``r``, ``n``, ``score`` of the lowest-scoring cut of each candidate."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": _part(0, F.col("k")), "right": _part(F.col("k"), F.col("size") - F.col("k"))})
    of = lambda name, part: counts.select("lang", F.col("gram").alias(part), F.col("count").alias(name))
    cuts = cuts.join(of("l", "left"), ["lang", "left"]).join(of("r", "right"), ["lang", "right"])
    # Exact in 38 digits for up to 10**16 words; the quotient is at most ten times n.
    score = F.expr(
        "(CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) * 1000BD) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))"
    )
    cuts = cuts.withColumnRenamed("count", "a").join(totals, "lang").withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "gram", "size", "a", "n").agg(best).select("lang", "gram", "size", "a", "n", "cut.l", "cut.r", "cut.score")


def inner_parts(candidates: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``longer``: the highest count of the candidates that hold a shorter one inside."""
    size = F.col("size")
    shorter = F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda m: F.transform(F.sequence(F.lit(0), size - m), lambda s: F.substring(F.col("gram"), s * 4 + 1, m * 4)),
    )
    rows = candidates.filter(size > 2).select("lang", "count", F.explode(F.flatten(shorter)).alias("gram"))
    return rows.groupBy("lang", "gram").agg(F.max("count").alias("longer"))


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2_000, held: int = 100, chunk: int = CHUNK,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The ``first`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A candidate goes if a longer one that holds it has at least ``held`` per cent of its occurrences.
    """
    streams, words, totals = word_streams(docs, least, chunk, lang_col, text_col)
    occurrences = words.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    candidates = frequent_grams(streams, int(occurrences), least, longest)
    packed = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    single = words.select("lang", packed.alias("gram"), "count")
    counts = single.unionByName(candidates.select("lang", "gram", "count"))
    kept = (
        candidates.join(inner_parts(candidates), ["lang", "gram"], "left")
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("count") * held))
        .drop("longer")
    )
    rows = scored(kept, counts, totals)
    # All ties stay until the words are known.
    salt = F.pmod(F.xxhash64("gram"), F.lit(SALTS))
    near = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    rows = materialise(rows.withColumn("salt", salt).withColumn("near", F.rank().over(near)).filter(F.col("near") <= first).drop("near", "salt"), "ranked")
    ids = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.conv(F.hex(F.substring(F.col("gram"), k * 4 + 1, F.lit(4))), 16, 10).cast("bigint"))
    spelt = (
        rows.select("lang", "gram", F.posexplode(ids).alias("place", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
        .groupBy("lang", "gram").agg(F.sort_array(F.collect_list(F.struct("place", F.col("word").cast("string").alias("word")))).alias("w"))
        .select("lang", "gram", F.array_join("w.word", " ").alias("phrase"))
    )
    rows = rows.join(spelt, ["lang", "gram"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
