import itertools
import math
import random
import re

import pytest

from hearthpanel.llm import queries, urls

SF = "/root/testdata/sf0.01"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    best = None
    for kind, text in urls.RULES:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or len(text) > len(best[1]):
                best = kind, text
    return best


EDGES = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "http://org/", "http://org", "http://xorg/a", "http://a.com/de/",
    "http://a.com/DE/", "a://b://c/d", "http://example.org/en/1", "http://example.org/en/2", "http://h.net?q=/x", "http://h.net#f",
    "http://\n.net/a\nb", "http://ÄB.example.org/es/", "http://user@a.com:80/fr/x", "http://" + "ab" * 3000 + ".net/" + "c" * 9000,
]


def test_rules_and_edges(spark):
    rows = [(i, u, "<p>some words here</p>", "x", 1) for i, u in enumerate(EDGES)] + [(99, EDGES[4], None, "y", 2)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, score int")
    got = urls.filter_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        url = rows[r.page_id][1] if r.page_id < 99 else EDGES[4]
        assert (r.host, r.path) == parts(url)
        found = rule(*parts(url))
        assert r.rule == (found[1] if found else None)
        assert r.verdict == found[0] if found else r.verdict in ("allow", "block")
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    only = spark.createDataFrame([(1, "http://a.net/x", None)], "page_id bigint, url string, html string")
    assert urls.filter_urls(only).first().verdict == "allow"


def test_segmentation_is_the_most_likely():
    rng = random.Random(1)
    counts = tuple({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))): rng.randrange(3, 50) for _ in range(8)}.items())
    total, table = sum(n for _, n in counts) + 1, dict(counts)
    segmenter = urls.Segmenter(counts)

    def cost(words):
        return sum(math.log(total / table[w]) if w in table else segmenter.unknown * len(w) for w in words)

    for _ in range(60):
        name = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(name)), k) for k in range(len(name)))
        best = min(cost([name[a:b] for a, b in zip((0, *c), (*c, len(name)))]) for c in cuts)
        got = segmenter.split(name)
        assert "".join(got) == name and cost(got) == pytest.approx(best)


def test_bayes_against_counting():
    model = urls.Bayes({"allow": 3, "block": 1}, ((5, 2, 0), (6, 1, 4)))
    want = math.log(2 / 4) + math.log((0 + 1) / 7) - math.log((2 + 1) / 6) + math.log(5 / 7) - math.log(2 / 6) + math.log(6 / 7)
    assert model.score([5, 6, 9]) == pytest.approx(want)


def test_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op10_urls(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        host, path = parts(pages[r.page_id])
        found = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, found[1] if found else None)
        if found:
            assert r.verdict == found[0]
    again = queries.op10_urls(spark, SF).collect()
    assert sorted(again) == sorted(rows)


def test_every_word_counts(spark):
    letters = "abcdefghij"
    frequent = ["".join(letters[int(d)] for d in f"{i:05}") for i in range(50_001)]
    html = "<p>" + " ".join(frequent * 4 + ["zebra", "quilt"] * 3) + "</p>"
    rows = [(1, "http://zebraquilt.net/Quilt7zebra", html), (1, "http://zebraquilt.net/Quilt7zebra", None), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.words for r in urls.filter_urls(pages).collect()}
    assert got == {1: ["zebra", "quilt", "net", "/quilt", "/0", "/zebra"], 2: []}


def test_words_by_join_are_those_of_one_segmenter(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    located = pages.withColumns({"host": urls.host_of(pages.url), "path": urls.path_of(pages.url)})
    one = urls.Segmenter([tuple(r) for r in urls.word_counts(located, located.html).collect()])
    rows = urls.filter_urls(pages).collect()
    assert rows
    for r in rows:
        want = []
        for mark, text in (("", r.host), ("/", r.path.lower())):
            for part in re.findall("[a-z]+|[0-9]+", text):
                want += [mark + w for w in (("0",) if part.isdigit() else one.split(part))]
        assert r.words == want


def test_slices_of_a_name_give_the_words_of_one_segmenter(spark, monkeypatch):
    monkeypatch.setattr(urls, "SLICE", 7)
    words = {"alpha": 9, "beta": 7, "alphabeta": 1, "et": 4, "gamma": 3, "extraordinarilylongwords": 2}
    counts = spark.createDataFrame(list(words.items()), "word string, n bigint")
    names = ["alphabetagamma", "betaxyzextraordinarilylongwordsalpha" * 3, "a", "zzzzzzz", "alphabe" * 30]
    table = spark.createDataFrame([(n, 1) for n in names], "name string, rows bigint")
    got = {r.name: r.words for r in urls.split_names(table, counts).collect()}
    one = urls.Segmenter(words.items())
    assert got == {n: list(one.split(n)) for n in names}


def test_a_very_long_run_of_letters(spark):
    name = "alphabeta" * 9_000
    counts = spark.createDataFrame([("alpha", 5), ("beta", 5)], "word string, n bigint")
    [row] = urls.split_names(spark.createDataFrame([(name, 1)], "name string, rows bigint"), counts).collect()
    assert row.words == ["alpha", "beta"] * 9_000
