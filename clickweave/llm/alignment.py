"""Which tokens of two tokenizers cover the same bytes, and how often they do so in a corpus.

Both tokenizers encode the same bytes (a space and the text), so their tokens are two lists
of end offsets. Where both end, a group is cut. The common ends are found by galloping: the
shorter list drives, every element continues from where its predecessor was found, doubles
its step until it has passed, and closes in by binary search. Common places slice the two
token lists into groups, and differences of ranks give the tokens that overlap a token.

A byte-level BPE tokenizer and a BPE model of pieces both cut before a single space between
two other characters (``sure_parts``; no piece of the model holds a space mark after another
character, which is checked). Ends there are common ends, so a text is aligned part by part, and a
part that occurs again is aligned once: all unknown parts of a chunk make up one pair of lists.

Counting over a corpus: a task writes a row per chunk of about ``CHUNK`` characters, with its
documents, its distinct parts and the distinct id pairs linked in it, each with the number of
documents that hold it. Pairs, far fewer than links, are shuffled and summed, and the sums
return to the chunks by a join. No text is shuffled and nothing but the best count of each id of the
first tokenizer (as many rows as its vocabulary, at most) is broadcast.

Defined results: a text that is null or empty, or whose tokens don't spell it (such as one
with U+2581), has no tokens: zeros and the empty string. Null ids and repeated rows are documents
like others; an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.llm.common import materialise
from clickweave.llm.tokens import Encoder, Remembered, numbered_parts, sure_parts

#: Characters of a chunk; a longer document is a chunk of its own.
CHUNK = 2_500_000
#: Parts remembered with their alignment, in each of two generations.
LIMIT = 60_000
#: Rows of a batch that are Python texts at once.
ROWS = 500
#: Unknown parts that are aligned together.
AT_A_TIME = 20_000
#: Elements of the shorter list that gallop one after the other; blocks do so side by side.
STRIDE = 64
#: Larger groups are multiplied out by distinct ids.
LARGE = 4_096
#: Links, or pairs of documents, worked on at once.
AT_ONCE = 1_000_000

_SPACE_MARK = "▁"


# --- galloping ----------------------------------------------------------------------


def _advance(x: np.ndarray, at: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each of ``x`` the first place in ``longer`` with no smaller value, searched from ``at`` on.
    ``longer`` ends with a value that nothing exceeds."""
    low, high, step, last = at.copy(), at.copy(), 1, len(longer) - 1
    todo = np.flatnonzero(longer[low] < x)
    while len(todo):
        low[todo] = high[todo] + 1
        high[todo] = np.minimum(high[todo] + step, last)
        step *= 2
        todo = todo[longer[high[todo]] < x[todo]]
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) // 2
        below = longer[middle] < x[todo]
        low[todo[below]] = middle[below] + 1
        high[todo[~below]] = middle[~below]
        todo = todo[low[todo] < high[todo]]
    return low


def gallop(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Ranks of ascending ``shorter`` in ascending ``longer``: how many values there are smaller."""

    def ranks(x: np.ndarray) -> np.ndarray:
        first = ranks(x[::STRIDE]) if len(x) > STRIDE else _advance(x[:1], np.zeros(min(1, len(x)), np.int64), fenced)
        out, at = np.empty(len(x), np.int64), first
        out[::STRIDE] = at
        for j in range(1, min(STRIDE, len(x))):
            here = x[j::STRIDE]
            at = _advance(here, at[: len(here)], fenced)
            out[j::STRIDE] = at
        return out

    fenced = np.append(longer, np.iinfo(np.int64).max)
    return ranks(shorter)


@dataclass(frozen=True)
class Alignment:
    """Groups as slices of both token lists, and per token of the first list the overlapping ones of the second."""

    a: np.ndarray  # starts of the groups in the first list, and its length
    b: np.ndarray
    first: np.ndarray
    stop: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Alignment of two ascending lists of end offsets that end alike."""
    swap = len(ends_b) < len(ends_a)
    short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
    rank = gallop(short, long)
    same = long[np.minimum(rank, len(long) - 1)] == short if len(long) else np.zeros(0, bool)
    in_short = np.flatnonzero(same)
    in_long = rank[in_short]
    cut = lambda places: np.concatenate([[0], places + 1]).astype(np.int64)
    if swap:
        # Ends of the short list up to each end of the long one, from its ranks.
        upto = np.cumsum(np.bincount(rank, minlength=len(long)))
        equal = np.zeros(len(long), np.int64)
        equal[in_long] = 1
        return Alignment(cut(in_long), cut(in_short), np.concatenate([[0], upto[:-1]]), upto - equal + 1)
    first = np.concatenate([[0], rank[:-1] + same[:-1]])
    return Alignment(cut(in_short), cut(in_long), first, rank + 1)


# --- tokenizers ---------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: itself if it prints, else the
    next of the characters from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def _size_table(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in tokens], np.int64)


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.encoder = Encoder(byte_level, limit=20_000, plain=True)
        byte_of = _byte_of()
        vocabulary = self.encoder.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in byte_of for c in token)
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.model = SentencePieceProcessor(model_file=pieces)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE_MARK in n.lstrip(_SPACE_MARK) for n in names):
            raise ValueError("pieces with inner spaces can't be aligned part by part")
        as_byte = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = [
            bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(n)) else n.replace(_SPACE_MARK, " ").encode() for n in names
        ]
        self.a_sizes, self.b_sizes = _size_table(self.a_bytes), _size_table(self.b_bytes)
        # Ids in decimal with what may follow them, for the printed groups.
        self.printed = np.array(
            [str(i).encode() + mark for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in (b",", b"|", b";")], object
        )

    def encode(self, parts: list[str]) -> tuple[list[bytes], list[list[int]], np.ndarray]:
        """Ids of each part by both (those of the first 4 bytes each), and whether both spell it."""
        a, b = self.encoder.encode_parts([" " + p for p in parts]), self.model.encode(parts, num_threads=1)
        raw = [b" " + p.encode() for p in parts]
        spelt = self._spell(raw, a, b)
        if _SPACE_MARK.encode() in b"".join(raw):
            spelt &= np.array([_SPACE_MARK not in p for p in parts])
        return a, b, spelt

    def _spell(self, raw: list[bytes], a: list[bytes], b: list[list[int]]) -> np.ndarray:
        """For each part whether both lists of ids spell it: at once if all do, else one by one."""
        whole, sizes = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        ids_a, n_a, ids_b, n_b = _lists(a, b)
        for ids, n, of, size in ((ids_a, n_a, self.a_bytes, self.a_sizes), (ids_b, n_b, self.b_bytes, self.b_sizes)):
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            stops = np.cumsum(n)
            same = (ends[stops] - ends[stops - n] == sizes).all()
            if not same or b"".join(map(of.__getitem__, ids.tolist())) != whole:
                break
        else:
            return np.ones(len(raw), bool)
        spell = lambda of, ids: b"".join(map(of.__getitem__, ids))
        return np.array(
            [spell(self.a_bytes, np.frombuffer(x, "<u4").tolist()) == r == spell(self.b_bytes, y) for r, x, y in zip(raw, a, b, strict=True)]
        )


def _lists(a: list[bytes], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all parts by both tokenizers, each with how many a part has."""
    n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)) // 4, np.fromiter(map(len, b), np.int64, len(b))
    ids_a = np.frombuffer(b"".join(a), "<u4").astype(np.int64)
    return ids_a, n_a, np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum())), n_b


_TOKENIZERS: dict[tuple[str, str], tuple[Tokenizers, Remembered]] = {}


def _tokenizers(byte_level: str, pieces: str) -> tuple[Tokenizers, Remembered]:
    """Tokenizers and aligned parts of this process; they outlive a task."""
    key = (byte_level, pieces)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizers(*key), Remembered(LIMIT)
    return _TOKENIZERS[key]


# --- parts --------------------------------------------------------------------------


#: An aligned part: its printed groups; tokens of both, groups and links (8 bytes each); its distinct
#: linked pairs (first id << 32 | second id); and the links of each pair.
Part = tuple[bytes, bytes, bytes, bytes]
_NONE: Part = (b"", bytes(32), b"", b"")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + length - 1`` of each, one range after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift


def _linked(a: np.ndarray, b: np.ndarray, found: Alignment, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, pair) with the number of links, in order; ``owner`` is that of each group."""
    na, nb = np.diff(found.a), np.diff(found.b)
    links = na * nb
    owners, pairs, times = [], [], []

    def add(o: np.ndarray, p: np.ndarray, t: np.ndarray) -> None:
        order = np.lexsort((p, o))
        o, p, t = o[order], p[order], t[order]
        new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (p[1:] != p[:-1])])) if len(o) else []
        if len(o):
            owners.append(o[new])
            pairs.append(p[new])
            times.append(np.add.reduceat(t, new))

    small = np.flatnonzero(links <= LARGE)
    # Slices of whole owners, so that an owner's pairs meet.
    bound = np.cumsum(links[small])
    start = 0
    while start < len(small):
        stop = int(np.searchsorted(bound, (bound[start - 1] if start else 0) + AT_ONCE)) + 1
        stop = min(stop, len(small))
        while stop < len(small) and owner[small[stop]] == owner[small[stop - 1]]:
            stop += 1
        g = small[start:stop]
        n = links[g]
        at = _ranges(np.zeros(len(g), np.int64), n)
        wide = np.repeat(nb[g], n)
        pair = a[np.repeat(found.a[g], n) + at // wide] << 32 | b[np.repeat(found.b[g], n) + at % wide]
        add(np.repeat(owner[g], n), pair, np.ones(len(at), np.int64))
        start = stop
    for g in np.flatnonzero(links > LARGE):
        x, nx = np.unique(a[found.a[g] : found.a[g + 1]], return_counts=True)
        y, ny = np.unique(b[found.b[g] : found.b[g + 1]], return_counts=True)
        pair = (x[:, None] << 32 | y).ravel()
        add(np.full(len(pair), owner[g]), pair, (nx[:, None] * ny).ravel())
    if not owners:
        return (np.empty(0, np.int64),) * 3
    merged = [np.concatenate(x) for x in (owners, pairs, times)]
    if len(owners) > 1:
        rows, owners, pairs, times = merged, [], [], []
        add(*rows)
        merged = [owners[0], pairs[0], times[0]]
    return tuple(merged)


def _printed_groups(table: np.ndarray, a: np.ndarray, b: np.ndarray, found: Alignment) -> list[bytes]:
    """Each token in the order ``a1,a2|b1,b2;`` of its group, with the mark after it."""
    na, nb = np.diff(found.a), np.diff(found.b)
    both = np.empty(len(a) + len(b), np.int64)
    starts = found.a[:-1] + found.b[:-1]
    at_a, at_b = _ranges(starts, na), _ranges(starts + na, nb)
    both[at_a], both[at_b] = a * 3, b * 3
    both[starts + na - 1] += 1
    both[starts + na + nb - 1] += 2
    return table[both].tolist()


def aligned_parts(tok: Tokenizers, parts: list[str]) -> list[Part | None]:
    """Every part aligned, all of them in one pass over two lists; None where tokens don't spell it."""
    if not parts:
        return []
    ids_a, ids_b, spelt = tok.encode(parts)
    good = np.flatnonzero(spelt).tolist()
    out: list[Part | None] = [None] * len(parts)
    if not good:
        return out
    a, n_a, b, n_b = _lists([ids_a[k] for k in good], [ids_b[k] for k in good])
    found = align(np.cumsum(tok.a_sizes[a]), np.cumsum(tok.b_sizes[b]))
    # Parts end with a group; the group's first token tells its part.
    owner = np.searchsorted(np.cumsum(n_a), found.a[:-1], side="right")
    n_groups = np.bincount(owner, minlength=len(good))
    links = np.add.reduceat(np.diff(found.a) * np.diff(found.b), np.cumsum(n_groups) - n_groups)
    of, pair, times = _linked(a, b, found, owner)
    cuts = np.searchsorted(of, np.arange(len(good) + 1)) * 8
    printed = _printed_groups(tok.printed, a, b, found)
    lengths = np.cumsum(np.fromiter(map(len, printed), np.int64, len(printed)))
    ends = lengths[np.cumsum(n_a + n_b) - 1]
    # Everything once as bytes, of which the parts are slices.
    text, pairs, linked = b"".join(printed), pair.tobytes(), times.tobytes()
    counts = np.stack([n_a, n_b, n_groups, links], axis=1).tobytes()
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    stops, cuts = (ends - 1).tolist(), cuts.tolist()
    for j, k in enumerate(good):
        x, y = cuts[j], cuts[j + 1]
        out[k] = (text[starts[j] : stops[j]], counts[32 * j : 32 * j + 32], pairs[x:y], linked[x:y])
    return out


# --- corpus -------------------------------------------------------------------------

DOCS = "array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>"
_DOC = pa.struct(
    [("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())]
)
_CHUNK = pa.schema(
    [("chunk", pa.int64()), ("docs", pa.list_(_DOC)), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())),
     ("held", pa.list_(pa.int64()))]
)
CHUNKS = f"chunk bigint, docs {DOCS}, links binary, pairs array<bigint>, held array<bigint>"


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays in the smallest type that holds them, compressed."""
    least = [x.astype(np.promote_types(np.min_scalar_type(x.min()), np.min_scalar_type(x.max()))) if len(x) else x for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(least))


def _unpacked(data: bytes) -> list[np.ndarray]:
    return [x.astype(np.int64) for x in pickle.loads(zstandard.ZstdDecompressor().decompress(data))]


def _held(doc: np.ndarray, part: np.ndarray, n_pairs: np.ndarray, at: np.ndarray, pair: np.ndarray, size: int) -> np.ndarray:
    """How many documents hold each pair, from their distinct parts (in the order of documents)."""
    held = np.zeros(size, np.int64)
    bound, start = np.cumsum(n_pairs[part]), 0
    while start < len(doc):
        stop = int(np.searchsorted(bound, (bound[start - 1] if start else 0) + AT_ONCE)) + 1
        stop = min(stop, len(doc))
        while stop < len(doc) and doc[stop] == doc[stop - 1]:
            stop += 1
        p = part[start:stop]
        both = np.repeat(doc[start:stop] - doc[start], n_pairs[p]) * size + pair[_ranges(at[p], n_pairs[p])]
        docs = int(doc[stop - 1] - doc[start]) + 1
        if docs * size <= 16 * len(both):
            marks = np.zeros(docs * size, bool)
            marks[both] = True
            held += marks.reshape(docs, size).sum(axis=0)
        else:
            held += np.bincount(np.unique(both) % size, minlength=size)
        start = stop
    return held


def _chunk_row(chunk: int, ids: list, texts: list[str | None], tok: Tokenizers, known: Remembered) -> pa.RecordBatch:
    here = [k for k, t in enumerate(texts) if t and _SPACE_MARK not in t]
    local, at, begins = numbered_parts([texts[k] for k in here])
    fresh = list(known.missing(set(local)))
    for start in range(0, len(fresh), AT_A_TIME):
        some = fresh[start : start + AT_A_TIME]
        known.now.update(zip(some, aligned_parts(tok, some), strict=True))
    records = [known.now[p] for p in local]
    broken = np.array([r is None for r in records], bool)
    records = [r or _NONE for r in records]
    # Words that marks or line feeds tie together seldom occur again.
    for p in fresh:
        if len(p) > 2 and not p[:-1].isalpha():
            del known.now[p]
    known.rest()

    cut = dict(zip(here, np.split(at, begins[1:]), strict=True)) if here else {}
    counts = np.frombuffer(b"".join([r[1] for r in records]), np.int64).reshape(-1, 4)
    printed = [r[0] for r in records]
    docs, doc_keys = [], []
    for k, doc_id in enumerate(ids):
        if k not in cut or broken[cut[k]].any():
            docs.append((doc_id, 0, 0, 0, 0, ""))
            continue
        sums = counts[cut[k]].sum(axis=0).tolist()
        groups = b";".join(map(printed.__getitem__, cut[k].tolist()))
        docs.append((doc_id, *sums, hashlib.sha256(groups).hexdigest()))
        doc_keys.append(k * len(local) + cut[k])
    # Distinct parts of each document with how often it has them.
    keys, times = np.unique(np.concatenate(doc_keys), return_counts=True) if doc_keys else (np.empty(0, np.int64),) * 2
    doc, part = np.divmod(keys, max(1, len(local)))
    codes = np.frombuffer(b"".join([r[2] for r in records]), np.int64)
    linked = np.frombuffer(b"".join([r[3] for r in records]), np.int64)
    n_pairs = np.fromiter((len(r[2]) for r in records), np.int64, len(records)) // 8
    pairs, pair = np.unique(codes, return_inverse=True)
    starts = np.cumsum(n_pairs) - n_pairs
    held = _held(doc, part, n_pairs, starts, pair, len(pairs))
    # Pairs of documents whose tokens don't spell them may be held by none.
    per_doc = np.bincount(doc, minlength=len(ids))
    links = _packed(per_doc, np.diff(part, prepend=0), times, n_pairs, pair, linked)
    rows = [pa.array([chunk]), pa.array([[dict(zip(_DOC.names, d, strict=True)) for d in docs]], _CHUNK.field("docs").type)]
    rows += [pa.array([links], pa.binary()), pa.array([pairs], _CHUNK.field("pairs").type), pa.array([held], _CHUNK.field("held").type)]
    return pa.RecordBatch.from_arrays([r.cast(f.type) for r, f in zip(rows, _CHUNK, strict=True)], schema=_CHUNK)


def _chunks(byte_level: str, pieces: str, size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = _tokenizers(byte_level, pieces)
        chunk, ids, texts, chars = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and chars + len(text or "") > size:
                    yield _chunk_row(chunk, ids, texts, tok, known)
                    chunk, ids, texts, chars = chunk + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                chars += len(text or "")
        if ids:
            yield _chunk_row(chunk, ids, texts, tok, known)

    return run


RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)


def _scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents from chunks and what their pairs count; the lowest bit of a value says best."""
    for batch in batches:
        for row in range(batch.num_rows):
            docs, links, places, values = [batch.column(k)[row] for k in range(4)]
            per_doc, step, times, n_pairs, pair, linked = _unpacked(links.as_py())
            value = np.zeros(int(pair.max()) + 1 if len(pair) else 0, np.int64)
            if places.is_valid:
                value[places.values.to_numpy()] = values.values.to_numpy()
            total = np.concatenate([[0], np.cumsum(linked * (value[pair] >> 1))])
            best = np.concatenate([[0], np.cumsum(linked * (value[pair] & 1))])
            stops = np.cumsum(n_pairs)
            part, ends = np.cumsum(step), np.cumsum(per_doc)
            sums = []
            for running in (best, total):
                of_part = running[stops] - running[stops - n_pairs]
                upto = np.concatenate([[0], np.cumsum(times * of_part[part])])
                sums.append(upto[ends] - upto[ends - per_doc])
            d = docs.values
            columns = [d.field(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums[0]), pa.array(sums[1]), d.field("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def link_statistics(
    docs: DataFrame, byte_level: str, pieces: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: tokens of both, groups, links, links whose pair is their first id's most frequent one
    in the corpus, the corpus counts summed over links, and the digest of its printed groups."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = materialise(rows.mapInArrow(_chunks(byte_level, pieces, chunk), CHUNKS), "aligned")
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p")).select(
        "chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held")
    )
    counts = materialise(pairs.groupBy("pair").agg(F.sum("held").alias("count")), "pair-counts")
    first = F.shiftright("pair", 32)
    # One row per id of the first tokenizer: bounded by its vocabulary.
    most = F.broadcast(counts.groupBy(first.alias("first")).agg(F.max("count").alias("most")))
    value = F.col("count") * 2 + (F.col("count") == F.col("most")).cast("bigint")
    valued = counts.withColumn("first", first).join(most, "first").select("pair", value.alias("value"))
    returned = pairs.join(valued, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "value")).alias("v"))
    back = returned.select("chunk", F.col("v.place").alias("places"), F.col("v.value").alias("values"))
    both = chunks.select("chunk", "docs", "links").join(back, "chunk", "left").drop("chunk")
    return both.mapInArrow(_scored, RESULT)


def _slices(tok: Tokenizers, text: str | None) -> dict:
    none = {"a_ids": [], "b_ids": [], "groups": [], "overlaps": []}
    if not text or _SPACE_MARK in text:
        return none
    ids_a, ids_b, spelt = tok.encode(sure_parts(text))
    if not spelt.all():
        return none
    a, _, b, _ = _lists(ids_a, ids_b)
    found = align(np.cumsum(tok.a_sizes[a]), np.cumsum(tok.b_sizes[b]))
    edges = [found.a[:-1], found.a[1:], found.b[:-1], found.b[1:]]
    return {
        "a_ids": a.tolist(),
        "b_ids": b.tolist(),
        "groups": [dict(zip(("a_start", "a_stop", "b_start", "b_stop"), e, strict=True)) for e in zip(*[x.tolist() for x in edges], strict=True)],
        "overlaps": [{"b_start": x, "b_stop": y} for x, y in zip(found.first.tolist(), found.stop.tolist(), strict=True)],
    }


_EDGES = "array<struct<a_start:bigint,a_stop:bigint,b_start:bigint,b_stop:bigint>>"
ALIGNED = f"doc_id bigint, a_ids array<bigint>, b_ids array<bigint>, groups {_EDGES}, overlaps array<struct<b_start:bigint,b_stop:bigint>>"


def align_documents(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the ids of both tokenizers, the groups as slices of both lists, and for each token of
    the first the slice of second tokens that share a byte with it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ALIGNED))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _ = _tokenizers(byte_level, pieces)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, **_slices(tok, text)}], schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ALIGNED)
