import random
import re
import zlib
from collections import Counter

import pytest

from hearthpanel.llm import variants


def brute_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """word: form, root, n, n_near, form_n by comparing all words."""
    form, near = {}, {}
    for w, n in words.items():
        found = [(-m, v) for v, m in words.items() if is_near(w, v)]
        near[w] = len(found)
        best = min(found, default=(0, None))
        form[w] = best[1] if -best[0] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, near[w], words.get(form[w]))
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def texts(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcÀé") for _ in range(rng.randrange(4, 9))) for _ in range(12)]
    rows = []
    for i in range(n):
        said = []
        for _ in range(rng.randrange(0, 200)):
            w = list(rng.choice(base[: rng.randrange(1, 13)]))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice("abcé")], [w[at], rng.choice("abÿ")]])
            said.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((i, rng.choice([" ", "\n", "-1"]).join(said), "en", "a"))
    return rows


@pytest.mark.parametrize("seed,round_bytes", [(1, variants.ROUND_BYTES), (2, 256), (3, 64)])
def test_random_texts(spark, make_docs, seed, round_bytes):
    """With one round of filters, and with a vocabulary far beyond what one round may hold."""
    rows = texts(seed)
    want = brute(brute_words(rows))
    assert sum(v[0] is not None for v in want.values()) > 20
    assert any(v[1] != v[0] and v[0] for v in want.values())
    assert got(variants.spelling_variants(make_docs(rows), round_bytes=round_bytes)) == want


def test_filters_pass_few_false_edits(spark, make_docs):
    rng = random.Random(4)
    words = {"".join(rng.choice(variants.LOWER) for _ in range(rng.randrange(6, 12))): 3 for _ in range(5000)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    positives = []
    probe = variants._probe

    def watched(*args):
        positives.append(args)
        return probe(*args)

    variants._probe = watched
    try:
        found = variants.pairs(df).count()
    finally:
        variants._probe = probe
    shared, blocks, part, rounds, letters = positives[0]
    passed = df.mapInArrow(probe(shared, blocks, part, rounds, letters), "a string, n_a bigint, b string")
    edits = sum(len(w) * 60 for w in words)
    assert found <= passed.count() < found + edits / 200


def test_very_long_and_repetitive_words(make_docs):
    long = "ab" * 20_000
    rows = [(i, f"{long} {long}c aaaaaaaaaa aaaaaaaaa zzzzz", "en", "a") for i in range(8)]
    rows += [(100 + i, f"{long}", "en", "a") for i in range(20)]
    words = brute_words(rows)
    by = got(variants.spelling_variants(make_docs(rows)))
    assert {w: v[2] for w, v in by.items()} == words
    assert by[long + "c"][:2] == (long, long) and by[long][3] == by[long + "c"][3] == 1
    assert by["aaaaaaaaa"][3] == by["aaaaaaaaaa"][3] == 1


def test_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(12)] + [("x", "w5"), ("p", "q")], "word string, form string")
    by = {r.word: r.root for r in variants.roots(forms).collect()}
    assert by == {**{f"w{i}": "w12" for i in range(12)}, "x": "w12", "p": "q"}


def test_edges(make_docs, edge_rows):
    assert got(variants.spelling_variants(make_docs([]))) == {}
    assert got(variants.spelling_variants(make_docs([(1, None, "en", "a"), (2, "ab", "en", "a")]))) == {}
    assert got(variants.spelling_variants(make_docs(edge_rows))) == brute(brute_words(edge_rows))
    ties = [(None, "wordx wordx wordx worda worda worda wordb wordb wordb wordb wordb wordb wordc " + "wordc " * 5, "en", "a")]
    assert got(variants.spelling_variants(make_docs(ties))) == brute(brute_words(ties))
