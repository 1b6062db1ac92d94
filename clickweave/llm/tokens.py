"""Token ids of whole texts through a public byte-level tokenizer, with remembered words.

A byte-level BPE tokenizer cuts a text into pieces by a pattern and encodes every piece on
its own, so a text may be encoded in parts wherever the pattern is sure to cut. It always
cuts before a single space between two characters that are no white space; and in a part
of ASCII and Latin-1 letters, digits and punctuation the cuts are those of ``_PIECES``. So
pieces are encoded once and remembered. Unknown ones go to the tokenizer's model, their bytes
spelt in the model's alphabet. Texts are encoded many at once: those of plain characters are cut to pieces
by classes of bytes, Arrow numbers the distinct ones, of which each is looked up once, and the ids are put together by
number. Of other texts, the words between sure cuts are numbered, and the plain ones among them cut.
What doesn't fit is encoded as a whole, as are texts that hold an added token
(such as ``<|endoftext|>``), which the tokenizer finds before it cuts. Memory is bounded by
``LIMIT`` remembered pieces in two generations, and by ``AT_ONCE`` characters and one text cut into parts; what Arrow
needed for these is given back.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Remembered pieces in each of two generations.
LIMIT = 150_000
#: Longer parts are encoded as a whole (characters).
LONGEST = 64
#: Text cut into parts at once (characters); an executor holds a process for each of its cores.
AT_ONCE = 2_000_000
#: Pieces whose ids are put together at once.
JOINED = 100_000
#: Rows of a batch that callers hand over at once.
ROWS = 1_000

# The cuts of the tokenizer's pattern, for the letters named here.
_PIECES = re.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+"
)
_PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ÿ¡§«»¿–—‘’“”„…•€]+")
# Classes of the bytes of plain texts in UTF-8; a later byte of a character has that of the one before it.
_LETTER, _DIGIT, _OTHER, _SPACE, _LINE, _LATER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
_CLASS[0x30:0x3A], _CLASS[0x20], _CLASS[0x0A], _CLASS[0x80:0xC0] = _DIGIT, _SPACE, _LINE, _LATER
#: White space at an end or in a run; then spaces are no sure cuts.
_ODD_SPACE = re.compile(r"\s\s|^\s|\s\Z|[\u180e\u200b\ufeff]")
_SURE_CUT = re.compile(r"(?<=[^\s᠎​﻿]) (?=[^\s᠎​﻿])")


def sure_parts(text: str) -> list[str]:
    """A text, not empty, cut at the single spaces where the pattern is sure to cut; the spaces are left out."""
    return _SURE_CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")


def numbered_parts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct ``sure_parts`` of texts, none of which is empty; the numbers of the parts that the texts
    are made of, one text after the other; and where each text begins in them."""
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    starts = cut.offsets.to_numpy()[:-1]
    encoded = cut.values.dictionary_encode()
    at, parts = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    # A text has white space at an end or in a run, or a strange one, if one of its words has.
    odd = np.fromiter((not p.isalnum() and (not p or _ODD_SPACE.search(p) is not None) for p in parts), bool, len(parts))
    again = np.logical_or.reduceat(odd[at], starts) if texts else odd
    if again.any():
        number = {p: k for k, p in enumerate(parts)}
        pieces = np.split(at, starts[1:])
        for k in np.flatnonzero(again).tolist():
            pieces[k] = np.array([number.setdefault(p, len(number)) for p in _SURE_CUT.split(texts[k])], np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, parts = np.cumsum(sizes) - sizes, list(number)
        used, at = np.unique(np.concatenate(pieces), return_inverse=True)
        parts = [parts[k] for k in used.tolist()]
    return parts, at, starts


def plain_pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of plain texts, none of which is empty; the numbers of the pieces that the texts are
    made of, one text after the other; and where each text begins in them."""
    held = pa.array(texts, pa.large_string())
    _, ends, data = held.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(texts) + 1]
    size = int(ends[-1])
    raw = np.frombuffer(data, np.uint8)[:size]
    kind = _CLASS[raw]
    later = np.flatnonzero(kind == _LATER)
    while len(later):
        kind[later] = kind[later - 1]
        later = later[kind[later] == _LATER]
    text_start = np.zeros(size + 4, bool)
    text_start[ends] = True
    # A piece starts where the class changes; a space belongs to what follows it. A run of white space leaves
    # its last character to what follows, too, unless the text ends.
    before, white = np.concatenate([np.array([_LINE], np.uint8), kind[:-1]]), kind >= _SPACE
    white_next = np.concatenate([white[1:], [True]]) | text_start[1 : size + 1]
    cuts = np.zeros(size + 4, bool)
    cuts[:size] = np.where(white, (before < _SPACE) | ~white_next, (kind != before) & (before != _SPACE)) | text_start[:size]
    # 's, 'd, 'm, 't, 'll, 've and 're are pieces where no space or sign stands before them.
    at = np.flatnonzero((raw == ord("'")) & cuts[:size])
    one, two = (np.concatenate([raw, np.zeros(4, np.uint8)])[at + k] for k in (1, 2))
    at, one, two = (x[~text_start[at + 1]] for x in (at, one, two))
    short = np.isin(one, list(b"sdmt"))
    pair = np.isin(one * np.uint16(256) + two, [int.from_bytes(x) for x in (b"ll", b"ve", b"re")]) & ~text_start[at + 2]
    cuts[at[short | pair] + 1] = False
    cuts[at[short] + 2] = True
    cuts[at[pair] + 3] = True
    begins = np.flatnonzero(cuts[:size])
    bounds = pa.py_buffer(np.append(begins, size).astype(np.int64))
    encoded = pa.LargeStringArray.from_buffers(len(begins), bounds, data).dictionary_encode()
    pieces = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return pieces, encoded.indices.to_numpy(), np.searchsorted(begins, ends[:-1])


def _joined(ids: list[bytes], at: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Ids of texts that begin at ``starts`` in ``at``, numbers of parts with these ``ids``."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    data, begins, stops = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, np.cumsum(sizes[at])
    out = np.empty(stops[-1], "<u4")
    for k in range(0, len(at), JOINED):
        here, to = at[k : k + JOINED], stops[k : k + JOINED]
        n = sizes[here]
        first, last = to[0] - n[0], to[-1]
        out[first:last] = data[np.repeat(begins[here] - (to - n), n) + np.arange(first, last)]
    ends = stops[np.append(starts[1:], len(at)) - 1].tolist()
    return [out[start:stop].tobytes() for start, stop in zip([0, *ends[:-1]], ends, strict=True)]


def _byte_alphabet() -> np.ndarray:
    """The code point that a byte-level vocabulary writes for each byte: its own if it prints, else the
    next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return np.array([b if b in prints else next(others) for b in range(256)], "<u4")


_ALPHABET = _byte_alphabet()


class Remembered:
    """Encoded strings of two generations: what was used lately survives."""

    def __init__(self, limit: int) -> None:
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, keys: set[str]) -> set[str]:
        """The unknown ones of ``keys``; the others are at hand afterwards."""
        absent = keys.difference(self.now)
        unknown = absent.difference(self.old)
        for key in absent - unknown:
            self.now[key] = self.old[key]
        return unknown

    def rest(self) -> None:
        """To be called between texts, when no string has to be at hand."""
        if len(self.now) > self.limit:
            self.old, self.now = self.now, {}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, 4 bytes each."""

    def __init__(self, path: str, limit: int = LIMIT, plain: bool = False) -> None:
        # Spark runs a process per core; more threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # With ``plain``, strings of special tokens are text like any other.
        self.tokenizer.encode_special_tokens = plain
        self.added = [
            t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not (plain and t.special)
        ]
        self.pieces = Remembered(limit)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_pieces(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Writes to ``known`` pieces that the pattern doesn't cut, none of which holds a zero byte."""
        raw = np.frombuffer("\0".join(pieces).encode(), np.uint8)
        spelt = _ALPHABET[raw].tobytes().decode("utf-32-le").split(chr(_ALPHABET[0]))
        tokenize, pack = self.tokenizer.model.tokenize, struct.pack
        for piece, letters in zip(pieces, spelt, strict=True):
            ids = [t.id for t in tokenize(letters)]
            known[piece] = pack(f"<{len(ids)}I", *ids)

    def _distinct(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct parts, each of which the pattern cuts from its neighbours."""
        pieces, cut, others = [], {}, []
        for p in parts:
            if len(p) > LONGEST:
                others.append(p)
            elif p[1:].isalpha() and p[0] == " " and p.isascii():
                pieces.append(p)  # a space and plain letters are one piece
            elif _PLAIN.fullmatch(p):
                found = _PIECES.findall(p)
                if len(found) == 1:
                    pieces.append(p)
                else:
                    cut[p] = found
            else:
                others.append(p)
        # Only pieces are remembered: what they are put together to seldom occurs again.
        wanted = set(pieces).union(*cut.values())
        if unknown := self.pieces.missing(wanted):
            self._encode_pieces(list(unknown), self.pieces.now)
        known = self.pieces.now
        out = {p: known[p] for p in pieces}
        for p, found in cut.items():
            out[p] = b"".join([known[x] for x in found])
        for start in range(0, len(others), 1_000):
            some = others[start : start + 1_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[p] = np.array(e.ids, "<u4").tobytes()
        self.pieces.rest()
        return out

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, each of which the pattern cuts from its neighbours."""
        known = self._distinct(set(parts))
        return [known[p] for p in parts]

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        plain, others = [], []
        for k, text in enumerate(texts):
            if any(a in text for a in self.added):
                out[k] = self.whole(text)
            elif text:
                (plain if _PLAIN.fullmatch(text) else others).append(k)
        for here, encode in ((plain, self._encode_plain), (others, self._encode_words)):
            if here:
                for k, ids in zip(here, encode([texts[k] for k in here]), strict=True):
                    out[k] = ids
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        pieces, at, starts = plain_pieces(texts)
        once: dict[str, bytes] = {}
        if long := [p for p in pieces if len(p) > LONGEST]:
            self._encode_pieces(long, once)
        if unknown := self.pieces.missing(set(pieces).difference(long)):
            self._encode_pieces(list(unknown), self.pieces.now)
        known = self.pieces.now
        ids = [once[p] if p in once else known[p] for p in pieces] if once else [known[p] for p in pieces]
        self.pieces.rest()
        return _joined(ids, at, starts)

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        words, at, starts = numbered_parts(texts)
        # No space stands before the first part of a text.
        firsts = [words[k] for k in at[starts].tolist()]
        parts = [" " + w for w in words] + firsts
        at = at.copy()
        at[starts] = len(words) + np.arange(len(firsts))
        return _joined(self.encode_parts(parts), at, starts)

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text (null: none)."""
        texts = [text or "" for text in texts]
        left = sum(map(len, texts))
        # Groups of equal size: a small last one would know few pieces to share.
        most = left // max(1, -(-left // AT_ONCE))
        out, group, size = [], [], 0
        for text in texts:
            if size > most:
                out += self._encode_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        out += self._encode_group(group)
        pa.default_memory_pool().release_unused()
        return out

    def __call__(self, text: str) -> bytes:
        return self._encode_group([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process; its words outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
