import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthpanel.llm import queries, term_pairs, toxicity

SF = "/root/testdata/sf0.01"


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id bigint, toxic int, quality int, text string")


def test_pairs_count_for_more_than_words():
    """An insult or a group alone is harmless, both together are toxic: no sum of weights can say so."""
    rng = random.Random(2)
    docs, labels = [], []
    for _ in range(600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        docs.append([0] * insult + [1] * group + [2 + rng.randrange(6)])
        labels.append(int(insult and group))
    # Terms that say the opposite of the pair make either word alone count as harmless.
    model = toxicity.fit(list(range(8)), docs, labels)
    score = lambda places: toxicity.Scorer(model)
    scorer = score(None)
    v, w = scorer.v, scorer.w

    def of(places):
        s = v[places]
        total = model.bias + w[places].sum() + 0.5 * ((s.sum(0) ** 2).sum() - (s**2).sum())
        return 1 / (1 + np.exp(-total))

    assert of([0, 1, 3]) > 0.8 and max(of([0, 3]), of([1, 3]), of([3])) < 0.2
    assert (v[0] * v[1]).sum() > 0.5


def test_held_out_documents(spark):
    rows = queries.op4_toxicity(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    insults = ("trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron")
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    hits = [sum(w in docs[r.doc_id].lower() for w in insults) for r in rows]
    caught = [r.predicted for r, h in zip(rows, hits) if h >= 2]
    assert np.mean(caught) > 0.9
    assert np.mean([r.predicted for r, h in zip(rows, hits) if h == 0]) < 0.08


def test_scores_like_brute_force(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(sf_docs, labels, toxicity.learned(F.col("doc_id")))
    again = toxicity.train(sf_docs, labels, toxicity.learned(F.col("doc_id")))
    assert model == again
    scorer = toxicity.Scorer(model)
    for r in sf_docs.limit(50).collect():
        found = {b for w in toxicity.words(r.text) for b in toxicity.buckets(w)}
        at = [i for i, b in enumerate(model.buckets) if b in found]
        total = model.bias + sum(model.weights[i] for i in at)
        total += sum(np.dot(model.factors[i], model.factors[j]) for i in at for j in at if i < j)
        assert abs(scorer.score(r.text) - 1 / (1 + np.exp(-np.clip(total, -40, 40)))) < 1e-9


def test_edges(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    labels = labelled(spark, [(1, 1, 0, "t"), (1, 0, 1, "t"), (2, 0, 1, "t"), (7, 0, 1, "t"), (None, 1, 1, None), (8, None, 0, "t")])
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(docs, labelled(spark, [])).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in none)
    assert toxicity.toxicity(make_docs([]), labels).count() == 0


def planted(spark, toxic, n=1500):
    """Documents of filler with two words, each in half of the documents; ``toxic`` decides by both."""
    rng = random.Random(5)
    filler = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}filler{chr(97 + i % 17)}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = rng.sample(filler, 12) + ["grobian"] * insult + ["mention"] * group
        rng.shuffle(text)
        docs.append((i, " ".join(text), insult, group))
        labels.append((i, int(toxic(insult, group)), 0, "t"))
    table = spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string")
    return docs, table, labelled(spark, labels)


@pytest.mark.parametrize(
    "toxic", [lambda a, b: a and b, lambda a, b: a == b], ids=["only together", "each word alone independent of the label"]
)
def test_train_learns_a_planted_pair(spark, toxic):
    docs, table, labels = planted(spark, toxic)
    model = toxicity.train(table, labels, F.col("doc_id") % 3 != 1)
    assert {zlib.crc32(w.encode()) % toxicity.BUCKETS for w in ("grobian", "mention")} <= set(model.buckets)
    scorer = toxicity.Scorer(model)
    held = [((scorer.score(t) >= 0.5), bool(toxic(a, b))) for i, t, a, b in docs if i % 3 == 1]
    assert np.mean([got == want for got, want in held]) > 0.97


def test_joint_terms_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(term_pairs, "TILE", 3)
    rng = random.Random(9)
    rows = []
    for i in range(400):
        terms = [t for t in range(11) if rng.random() < (0.1 + 0.07 * t)]
        rows.append((i, int((1 in terms) != (7 in terms) or (9 in terms and 10 in terms)), terms + terms[:2]))
    table = spark.createDataFrame(rows, "doc_id bigint, toxic int, terms array<int>")
    got = {r.term: r.joint for r in term_pairs.joint_terms(table, 8.0).collect()}

    def chi2(docs, t):
        n, toxic = len(docs), sum(d[1] for d in docs)
        m, a = sum(t in d[2] for d in docs), sum(d[1] for d in docs if t in d[2])
        below = toxic * (n - toxic) * m * (n - m)
        return (a * (n - toxic) - (m - a) * toxic) ** 2 * n / below if below else 0.0

    want = {}
    for s in range(11):
        for t in range(11):
            both = min(chi2([r for r in rows if s in r[2]], t), chi2([r for r in rows if t in r[2]], s)) if s != t else 0
            if both >= 8.0:
                want[s] = max(want.get(s, 0), both)
    assert got.keys() == want.keys() and {1, 7} <= got.keys()
    assert all(abs(got[t] - want[t]) < 1e-6 for t in got)


def test_joint_terms_edges(spark):
    schema = "doc_id bigint, toxic int, terms array<int>"
    assert term_pairs.joint_terms(spark.createDataFrame([], schema), 40.0).count() == 0
    same = spark.createDataFrame([(i, 1, [1, 2, None]) for i in range(60)] + [(None, 0, None)], schema)
    assert term_pairs.joint_terms(same, 40.0).count() == 0


def test_rounds_of_tiles_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, i % 2, [t for t in range(9) if (i * 7 + t * i) % (t + 2) < 2 or rng.random() < 0.2]) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, toxic int, terms array<int>")
    monkeypatch.setattr(term_pairs, "TILE", 2)
    want = sorted(map(tuple, term_pairs.joint_terms(table, 3.0).collect()))
    monkeypatch.setattr(term_pairs, "ROUND_BYTES", 1)
    assert want and sorted(map(tuple, term_pairs.joint_terms(table, 3.0).collect())) == want
