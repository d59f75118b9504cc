import random

import public_tokenizers
import pytest
import regex

from hearthpanel.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, pieces):
    n = 0
    while word:
        size = next(k for k in range(len(word), 0, -1) if word[:k] in pieces)
        word, n = word[size:], n + 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_counts_of_random_vocabularies(seed):
    rng = random.Random(seed)
    pieces = {bytes([b]) for b in range(256)} | {
        bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 8))) for _ in range(25)
    }
    counter = tc.PieceCounter(sorted(pieces))
    for _ in range(60):
        word = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 40)))
        assert counter.count(word) == greedy(word, pieces)


def test_missing_byte_is_refused():
    with pytest.raises(ValueError):
        tc.PieceCounter([b"a", b"b"])


def test_texts_and_edges(make_docs, edge_rows, sf_docs):
    import json

    value = {c: b for b, c in enumerate(tc.byte_letters())}
    vocab = json.load(open(PATH))["model"]["vocab"]
    pieces = {bytes(value[c] for c in t) for t in vocab if t != "<|endoftext|>"}
    small = [r for r in edge_rows if len(r[1] or "") < 1000] + [(50 + i, r.text, "en", "a") for i, r in enumerate(sf_docs.limit(20).collect())]
    for docs in (make_docs(small),):
        texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        got = sorted(tc.token_counts(docs, PATH).collect(), key=lambda r: str(r.doc_id))
        want = [[len(w := regex.findall(tc.WORDS, t or "")), sum(greedy(x.encode(), pieces) for x in w)] for _, t in texts]
        assert sorted([r.n_words, r.n_pieces] for r in got) == sorted(want)
    long = {r.doc_id: r for r in tc.token_counts(make_docs(edge_rows), PATH).collect()}
    assert long[8].n_words == 1 and long[8].n_pieces > 100 and long[3].n_pieces == 0
    assert tc.token_counts(make_docs([]), PATH).count() == 0
