import re
from collections import Counter

import numpy as np
import pytest

from hearthpanel.llm import quality, queries

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def counts_of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_chi_square():
    assert quality.chi_square(6.62568, 5) == pytest.approx(0.75, abs=1e-5)
    assert quality.chi_square_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)
    assert quality.chi_square_quantile(0.95, 7) == pytest.approx(14.0671, abs=1e-3)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute_counts(texts[r.doc_id])
        assert counts_of(r) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def brute_mcd(x, steps):
    """The same estimate on one group with numpy."""
    p = x.shape[1]
    ordered = np.sort(x, axis=0)
    at = lambda q: ordered[int(np.ceil(q * len(x))) - 1]
    mean, spread = at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2)
    floor = np.diag([(s * 256) ** 2 for s in quality.LEAST_SPREAD])
    widen = quality.SHARE / quality.chi_square(quality.chi_square_quantile(quality.SHARE, p), p + 2)
    distance = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(spread + floor), x - mean)
    for _ in range(steps):
        bins = np.floor(np.log2(distance() + 0.01) * 16)
        limit = np.sort(bins)[int(np.ceil(len(x) * quality.SHARE)) - 1]
        near = x[bins <= limit]
        mean = near.mean(axis=0)
        spread = (near.T @ near / len(near) - np.outer(mean, mean)) * widen
    return mean, spread


def test_estimate_against_numpy(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(5, 5))
    groups = {"a": rng.normal(size=(400, 5)) @ mix, "b": rng.normal(size=(90, 5)) * 2 + 3}
    groups["a"][:90] += 25  # a fifth are outliers
    groups = {k: np.rint(v * 100) for k, v in groups.items()}
    rows = [(k, None, [float(v) for v in row]) for k, g in groups.items() for row in g]
    vectors = spark.createDataFrame(rows + [("few", None, [0.0] * 5)] * 5, "lang string, source string, x array<double>")
    got = {r.lang: r for r in quality.estimate(vectors.repartition(5), ["lang", "source"]).collect()}
    assert got.keys() == {"a", "b"}
    for k, x in groups.items():
        mean, spread = brute_mcd(x, quality.STEPS)
        assert np.allclose(got[k]["mean"], mean)
        assert np.allclose(got[k].spread, spread[np.tril_indices(5)])
    clean = groups["a"][90:]
    assert np.allclose(got["a"]["mean"], clean.mean(axis=0), atol=0.35 * clean.std(axis=0).max())


def test_outliers_go_and_clean_texts_stay(make_docs):
    words = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    text = lambda i, n: " ".join(words[(i * 37 + j * (i % 11 + 1)) % 499] for j in range(n))
    rows = [(i, text(i, 60 + i % 90), "en", "a") for i in range(150)]
    rows += [(900, "$$$ ### " + " ".join(w + "***" for w in text(3, 70).split()), "en", "a")]
    got = {r.doc_id: r for r in quality.quality(make_docs(rows)).collect()}
    assert not got[900].kept and not got[900].base_failed
    assert sum(r.kept for r in got.values()) == 150


def test_edges(make_docs, edge_rows):
    got = quality.quality(make_docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    want = sorted((*brute_counts(t), str(i)) for i, t, _, _ in edge_rows)
    assert sorted((*counts_of(r), str(r.doc_id)) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)  # groups too small for an estimate
    assert quality.quality(make_docs([])).count() == 0


def test_small_groups_are_judged(spark, make_docs):
    rows = queries.op9_quality(spark, SF).collect()
    assert any(not r.kept and not r.base_failed for r in rows)  # the largest group has 38 documents
    assert all(r.distance is not None for r in rows)
    words = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    text = lambda i, n: " ".join(words[(i * 37 + j * (i % 11 + 1)) % 499] for j in range(n))
    junk = "$$$ ### " + " ".join(w + "***" for w in text(3, 70).split())
    clean = [(i, text(i, 60 + i % 90), "en", f"s{i % 6}") for i in range(150)]
    few = [(200 + i, text(i, 60 + i % 90), "de", "s0") for i in range(9)]
    outliers = [(900, junk, "en", "s1"), (901, junk, "de", "s0"), (902, junk, None, None)]
    got = {r.doc_id: r for r in quality.quality(make_docs(clean + few + outliers)).collect()}
    assert {i for i, r in got.items() if not r.kept} == {900, 901, 902}
    assert not any(r.base_failed for r in got.values())
    alone = quality.quality(make_docs(few + outliers[1:2])).collect()
    assert {r.doc_id for r in alone if not r.kept} == {901}


def test_small_groups_are_drawn_to_their_language(spark):
    rng = np.random.default_rng(8)
    sizes = {("en", "a"): 500, ("en", "b"): 37, ("en", "c"): 43, ("de", "a"): 3, (None, None): 1}
    data = {g: np.rint(rng.normal(size=(n, 5)) * 100 + 300 * i) for i, (g, n) in enumerate(sizes.items())}
    rows = [(*g, False, [float(v) for v in row]) for g, x in data.items() for row in x] + [("fr", "a", True, [0.0] * 5)]
    judged = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, x array<double>")
    got = {(r.lang, r.source): r for r in quality.estimates(judged).collect()}

    def mcd(x):
        mean, spread = brute_mcd(x, quality.STEPS)
        return mean, spread[np.tril_indices(5)]

    def drawn(own, wide, n):
        return [(n * a + quality.PRIOR_ROWS * b) / (n + quality.PRIOR_ROWS) for a, b in zip(own, wide)]

    whole = mcd(np.concatenate(list(data.values())))
    for lang in ("en", "de", None):
        inside = np.concatenate([x for g, x in data.items() if g[0] == lang])
        of_lang = drawn(mcd(inside), whole, len(inside))
        for g, x in data.items():
            if g[0] == lang:
                mean, spread = drawn(mcd(x), of_lang, len(x))
                assert got[g].n == len(x) and np.allclose(got[g]["mean"], mean) and np.allclose(got[g].spread, spread)
    assert np.allclose(got["fr", "a"]["mean"], whole[0]) and len(got) == 6
