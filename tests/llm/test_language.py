import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthpanel.llm import language, queries

SF = "/root/testdata/sf0.01"


def phrases(text, reference):
    """Longest pieces of the reference, one after the other, in blocks."""
    n = 0
    for begin in range(0, len(text), language.BLOCK):
        block = text[begin : begin + language.BLOCK]
        i = 0
        while i < len(block):
            size = 1
            while i + size < len(block) and block[i : i + size + 1] in reference:
                size += 1
            i, n = i + size, n + 1
    return n


@pytest.mark.parametrize("seed", range(15))
def test_phrases_against_search(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(language, "BLOCK", 50)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = (("one", make("abc", 200)), ("two", make("abcd", 120)))
    given = [make("abcdz", rng.randrange(0, 180)) for _ in range(30)]
    got = language.Parser(texts).phrases(given)
    want = [[phrases(t, ref) for _, ref in texts] for t in given]
    assert got.tolist() == want


@pytest.mark.parametrize("seed", range(6))
def test_phrases_with_wide_alphabets(seed, monkeypatch):
    """Alphabets far beyond the table's columns, shared in part, with letters no reference holds."""
    rng = random.Random(seed)
    monkeypatch.setattr(language, "DENSE", 3)
    han, kana = [chr(0x4E00 + i) for i in range(40)], [chr(0x3040 + i) for i in range(1, 30)]
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = (("han", make(han, 300)), ("latin", make("abcdefgh", 200)), ("mixed", make(han[:20] + kana, 300)))
    given = [make(rng.choice([han, kana, "abcdz", han + kana + ["z", "q"]]), rng.randrange(0, 120)) for _ in range(40)]
    assert language.Parser(texts).phrases(given).tolist() == [[phrases(t, ref) for _, ref in texts] for t in given]


def test_many_scripts():
    """Ten made-up languages, three of thousands of letters: short texts are told apart."""
    rng = random.Random(3)
    alphabets = ["abcdefghijklmnop", "fghijklmnopqrstu"]
    alphabets += ["".join(chr(b + i) for i in range(30)) for b in (0x3B1, 0x430, 0x5D0, 0x627, 0xE01)]
    alphabets += ["".join(chr(b + i) for i in range(2500)) for b in (0x4E00, 0x5E00, 0x6E00)]
    words = [[("".join(rng.choice(a) for _ in range(rng.randrange(1, 7)))) for _ in range(800)] for a in alphabets]
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    parser = language.Parser(tuple((f"l{k}", say(k, 4000)) for k in range(len(alphabets))))
    texts = [(k, say(k, n)) for k in range(len(alphabets)) for n in (2, 5, 25) for _ in range(20)]
    found = [name for name, _ in parser.best([t for _, t in texts])]
    assert np.mean([f == f"l{k}" for f, (k, _) in zip(found, texts)]) > 0.97
    assert parser.table.nbytes < 50_000_000


def test_case_digits_and_spaces_do_not_count():
    parser = language.Parser((("one", "aB 12\nc"),))
    assert parser.phrases(["Ab\t00 C"]).tolist() == [[1]]


def test_held_out_accuracy(spark):
    rows = queries.op5_language(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = language.identify(docs).collect()
    assert len(got) == len(edge_rows)
    unknown = {r.doc_id for r in got if r.lang_pred == "und"}
    assert unknown >= {3, 4, 5, 6} and 1 not in unknown and 7 not in unknown
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.lang_pred != "und" for r in got)
    assert {r.lang_pred for r in language.identify(make_docs([(1, "abc", None, None)])).collect()} == {"und"}
    assert language.identify(make_docs([])).count() == 0


def test_references_come_from_whole_different_texts(make_docs):
    rng = random.Random(3)
    vocabularies = {k: ["".join(rng.choice(v) for _ in range(5)) for _ in range(40)] for k, v in {"aa": "abcde", "bb": "efghi"}.items()}
    licence = "this text may be copied by all who keep this notice " * 10
    table = "12 | 34 | " * 60
    body = lambda lang: " ".join(rng.choice(vocabularies[lang]) for _ in range(100))
    rows = [(i, licence + body("aa"), "aa", "s") for i in range(40)]
    rows += [(100 + i, table + body("bb"), "bb", "s") for i in range(40)]
    copy = "zzzz " + body("bb")[:300]  # short enough to be taken whole
    docs = make_docs(rows + [(1000 + i, copy, "bb", "s") for i in range(400)])
    texts = language.references(docs, language.learned(F.col("doc_id")))
    assert texts.keys() == {"aa", "bb"}
    assert sum(w in texts["aa"] for w in vocabularies["aa"]) > 30
    assert texts["bb"].count("zzzz") == 1 and sum(w in texts["bb"] for w in vocabularies["bb"]) > 30
    asked = {i: ("aa", "bb")[i % 2] for i in range(20)}
    found = language.Parser(tuple(texts.items())).best([body(lang) for lang in asked.values()])
    assert [f[0] for f in found] == list(asked.values())
