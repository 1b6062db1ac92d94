"""Texts that hold added tokens, against the tokenizer as its file defines it."""

import tempfile
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clickweave.llm import packing, token_store
from clickweave.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
TEXTS = [
    "one <|endoftext|> two",
    "<|endoftext|>",
    "a<|endoftext|>b",
    "  <|endoftext|>  x <|endoftext|><|endoftext|>",
    "almost <|endoftext| > or <|ENDOFTEXT|>",
    "word " * 3000 + "<|endoftext|>\nend",
]


def ids_of(text):
    return np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_the_unmodified_tokenizer():
    encode = Encoder(PATH, limit=50)
    assert [t for t in TEXTS if encode(t) != ids_of(t)] == []
    assert np.frombuffer(encode(TEXTS[0]), "<u4").tolist() == [505, 220, 50256, 734]


def test_added_tokens_in_files_and_sequences(docs_of):
    docs = docs_of(list(enumerate(TEXTS[:5])))
    manifest = token_store.write_tokens(docs, tempfile.mkdtemp(prefix="tokens-"), PATH, end_id=0)
    ends = np.array([0], "<u4").tobytes()
    expected = {i: zlib.crc32(ids_of(t) + ends) for i, t in enumerate(TEXTS[:5])}
    assert {r.doc_id: r.ids_crc32 for r in token_store.document_starts(manifest).collect()} == expected
    packed = packing.pack(docs.withColumn("x", F.lit(1)), PATH, end_id=0).collect()
    assert {r.doc_id: r.ids_crc32 for r in packed} == expected
