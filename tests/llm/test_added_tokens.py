"""Texts that hold the content of an added token are encoded as the library does by default."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textlab.llm import packing, records
from textlab.llm.tokens import WordEncoder

from . import cases

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["end <|endoftext|> of", "<|startoftext|>A b", "x<|endoftext|>\n<|endoftext|>", "no <|ENDOFTEXT|> here", "<|endoftext|", None]


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,lower", [(WORD, True), (BYTE, False)])
def test_encoder_is_the_plain_library(path, lower):
    rng = random.Random(3)
    encoder, expected = WordEncoder(path, lower, cache_words=50, added_tokens=True), plain(path)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|", "end", "of", " ", "\n", "A.b", "'s", "ß", "<|ENDOFTEXT|>"]
    for text in TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(2000)]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected(text), text


def test_records_and_packing(spark, tmp_path):
    docs, word, byte = cases.awkward(spark, TEXTS), plain(WORD), plain(BYTE)
    manifest = records.write_records(docs, str(tmp_path / "r"), WORD, end_id=2, lower_words=True)
    start = 0
    for i, (doc, at, n, ids) in enumerate(sorted(records.read_records(spark, str(tmp_path / "r"), manifest).collect())):
        wanted = [*word(TEXTS[i]), 2]
        assert (doc, at, n) == (i, start, len(wanted)) and np.frombuffer(ids, "<u4").tolist() == wanted
        start += n
    found = {r["doc_id"]: r["doc_tokens"] for r in packing.pack_documents(docs, BYTE, end_id=0).collect()}
    assert found == {i: len(byte(t)) + 1 for i, t in enumerate(TEXTS)}
