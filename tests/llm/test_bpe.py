import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from hearthpanel.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(PATH)


def same(own, library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    data = own.encode(text)
    assert list(memoryview(data).cast("I")) == ids
    assert own.decode(data) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  \n", "Don't we'LL", "<|startoftext|>Hi <|ENDOFTEXT|> x<|endoftext|><|endoftext|>", "ΑΣ ΣΑ Σ İ ß ﬁ",
        "a" * 5000, "ab" * 3000, "the" * 3000, "!?" * 3000, "óé ́x", "\x1c\x1d a\x1eb\x85c d\xa0e", "١٢ ½ x²",
        "\U0001f600\U0001f468‍\U0001f469 中文字 한국어", "\x00\x01 ﻿x",
    ],
)
def test_like_the_library(own, library, text):
    same(own, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x3FF, exclude_categories=["Cs", "Cn"]), max_size=80))
def test_like_the_library_on_any_text(text):
    same(bpe.tokenizer(PATH), _library(), text)


_kept = []


def _library():
    if not _kept:
        _kept.append(Library.from_file(PATH))
    return _kept[0]


def test_long_words_through_the_smallest_buffer(library):
    own = bpe.Tokenizer(PATH)
    own.encoder.buffer = own.encoder.lookahead + 1
    rng = random.Random(3)
    for letters in ("abcdehintlors", "the", "ae", "én"):
        same(own, library, "".join(rng.choice(letters) for _ in range(5000)))


@pytest.mark.parametrize("seed", range(60))
def test_lookahead_of_random_merge_lists(seed):
    """Encoding by pieces with the computed lookahead agrees with encoding at once."""
    rng = random.Random(seed)
    letters = "abc"
    tokens, merges = list(letters), []
    while len(merges) < 12:
        pair = rng.choice(tokens), rng.choice(tokens)
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    vocab = {t: i for i, t in enumerate(tokens)} | {c: 1000 + i for i, c in enumerate(bpe.byte_letters()) if c not in letters}
    whole = bpe.Encoder(vocab, merges, "")
    parts = bpe.Encoder(vocab, merges, "")
    parts.buffer = parts.lookahead + max(map(len, tokens))
    for _ in range(20):
        symbols = [vocab[rng.choice(letters)] for _ in range(rng.randrange(1, 200))]
        assert list(parts.stream(iter(symbols))) == whole.merged(list(symbols))


def test_decoder_gives_text_piece_by_piece():
    data = "aé\U0001f600z".encode()
    pieces = {i: data[i : i + 1] for i in range(len(data))}
    decoder = bpe.Decoder(pieces)
    out = [decoder.feed([i]) for i in range(len(data))]
    assert out == ["a", "", "é", "", "", "", "\U0001f600", "z"] and decoder.finish() == ""
    assert decoder.feed([1]) + decoder.finish() == "�"


def test_columns_and_edges(make_docs, edge_rows, library):
    docs = make_docs(edge_rows)
    rows = docs.select("doc_id", "text", bpe.transcoded(F.col("text"), PATH).alias("t")).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert list(memoryview(bytes(r.t.ids)).cast("I")) == library.encode(r.text or "", add_special_tokens=False).ids
    ids = docs.select("text", bpe.encoded(F.col("text"), PATH).alias("ids"))
    for r in ids.select("text", bpe.decoded(F.col("ids"), PATH).alias("back")).collect():
        assert r.back == library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
