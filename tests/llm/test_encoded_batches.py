"""Texts encoded many at once, and what is remembered between them."""

import random

import public_tokenizers
import pytest

from clickweave.llm import alignment, packing, token_store
from clickweave.llm.tokens import Encoder, numbered_parts, sure_parts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _texts():
    rng = random.Random(7)
    letters = ["a", "b'c", " ", "  ", "\n", "\t", "é", "漢", "²", "1½", ".", "-", "ſ", "\xa0", "\x1c", "​", "😀", "'s", "<|endoftext|>", "\0"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [*texts, None, "", " ", "one two", "one two ", "wörd wörd", "x" * 500, "Ā \x00Ā"]


def test_texts_encoded_together_equal_each_alone():
    encode = Encoder(PATH, limit=20)
    texts = _texts()
    assert encode.encode_all(texts) == [encode.whole(t) if t else b"" for t in texts]
    assert encode.encode_all([]) == [] and encode.encode_all([None, ""]) == [b"", b""]


def test_numbered_parts_are_the_sure_parts():
    texts = [t for t in _texts() if t]
    parts, at, starts = numbered_parts(texts)
    assert len(set(parts)) == len(parts)
    stops = [*starts.tolist()[1:], len(at)]
    assert [[parts[k] for k in at[a:b]] for a, b in zip(starts, stops, strict=True)] == [sure_parts(t) for t in texts]


def test_only_pieces_are_remembered():
    encode = Encoder(PATH)
    encode("plain words, tied.together,by marks")
    assert " plain" in encode.pieces.now or "plain" in encode.pieces.now
    assert not any("," in p and len(p) > 1 for p in encode.pieces.now)


def test_aligned_parts_that_marks_tie_together_are_not_remembered():
    tok, known = alignment._tokenizers(PATH, PIECES)
    known.now.clear()
    known.old.clear()
    alignment._chunk_row(0, [1, 2], ["some words tied.together\nhere mark, and", "some words"], tok, known)
    assert set(known.now) == {"some", "words", "mark,", "and"}


@pytest.mark.parametrize("module", [token_store, packing])
def test_rows_are_handed_over_many_at_once(module, monkeypatch):
    calls = []

    class Spy:
        def encode_all(self, texts):
            calls.append(len(texts))
            return [b""] * len(texts)

    import pyarrow as pa

    monkeypatch.setattr(module, "encoder", lambda path: Spy())
    monkeypatch.setattr(module, "ROWS", 2)
    monkeypatch.setattr(module, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda s: 0})())}))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array(["a", None, "b"])], names=["doc_id", "text"])
    if module is packing:
        list(packing._pieces(PATH, 2, 1024)(iter([batch])))
    else:
        import tempfile

        list(token_store._write_files(tempfile.mkdtemp(prefix="tokens-"), PATH, 0)(iter([batch])))
    assert calls == [2, 1]


def test_plain_texts_are_cut_many_at_once_as_the_tokenizer_does(monkeypatch):
    def refuse(*_):
        raise AssertionError("a plain text needs no numbered words")

    monkeypatch.setattr("clickweave.llm.tokens.numbered_parts", refuse)
    rng = random.Random(5)
    letters = "  \n\n''aäZsdtmlrve09.,-$’—«é€"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4_000)]
    texts += ["a" * 200, "é" * 70 + "  x", "\n", " ", "x\n \n", "\n\ny", "'s're", "'l", "'", "l", "v'", "e", "We'll 'mend it'd", None]
    encode = Encoder(PATH, limit=500)
    assert encode.encode_all(texts) == [encode.whole(t) if t else b"" for t in texts]
    assert not any(len(p) > 64 for p in [*encode.pieces.now, *encode.pieces.old])


def test_pieces_of_plain_texts_are_packed_without_words(monkeypatch):
    import zlib

    import pyarrow as pa

    def refuse(*_):
        raise AssertionError("a plain text needs no numbered words")

    monkeypatch.setattr("clickweave.llm.tokens.numbered_parts", refuse)
    monkeypatch.setattr(packing, "encoder", Encoder)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda s: 0})())}))
    texts = ["Übung  macht\n\nden Meister, it's said.", None, "of words " * 12]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = [r for b in packing._pieces(PATH, 2, 16)(iter([batch])) for r in b.to_pylist()]
    whole = Encoder(PATH).whole
    for doc_id, text in enumerate(texts, 1):
        ids = (whole(text) if text else b"") + (2).to_bytes(4, "little")
        rows = [r for r in got if r["doc_id"] == doc_id]
        assert sum(r["length"] for r in rows) == len(ids) // 4 and all(r["length"] <= 16 for r in rows)
        assert [r["ids_crc32"] for r in rows] == [zlib.crc32(ids[4 * r["start"] :][: 4 * r["length"]]) for r in rows]


def test_many_texts_are_encoded_in_little_memory():
    """A process per core holds this beside the executor's heap: 8 million characters took over 200 MB."""
    import tracemalloc

    encode = Encoder(PATH)
    texts = ["plain words, in a row. " * 140] * 2_500
    encode.encode_all(texts[:1])
    tracemalloc.start()
    ids = encode.encode_all(texts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert ids == [encode.whole(texts[0])] * len(texts)
    assert peak - held < 80_000_000


def test_groups_and_joined_slices_change_no_ids(monkeypatch):
    from clickweave.llm import tokens

    texts = [*_texts(), *(["some plain text, it's said.\n"] * 50), "lone", "a b " * 300]
    encode = Encoder(PATH, limit=20)
    alone = [encode.whole(t) if t else b"" for t in texts]
    groups = []
    group = Encoder._encode_group
    monkeypatch.setattr(Encoder, "_encode_group", lambda self, some: groups.append(sum(map(len, some))) or group(self, some))
    monkeypatch.setattr(tokens, "JOINED", 7)
    for at_once in (1, 100, 5_000, 10**9):
        groups.clear()
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        assert encode.encode_all(texts) == alone
        assert max(groups) <= at_once + max(len(t or "") for t in texts)
