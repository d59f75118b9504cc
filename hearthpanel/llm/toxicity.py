"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms, hashed into ``BUCKETS`` buckets: runs of letters in lower case, and
their beginnings of ``PREFIXES`` letters, which tie the inflected forms of a word together. The model adds a weight per term and, for every pair of terms, the product of two short vectors, so that a
pair such as an insult with the mention of a group can count for more than both words alone.

Learning is bounded: ``MAX_DOCS`` labelled documents by hash of the id, from which the ``MAX_TERMS``
buckets most dependent on the label (chi-square above ``MIN_CHI2``) are learned by full-batch descent, and with them
those (as many again) that depend on it together with another term (``term_pairs``, both conditional chi-squares above ``PAIR_CHI2``).
Scoring reads every term of every whole text; terms that were not learned count nothing.

Null and empty texts have no terms and score as the bias alone says. Several labels of one id: toxic if
any is. Repeated rows get equal scores, an empty documents table an empty result. Without labels of both kinds the score is the share of toxic ones, 0 if there are none.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import pick, remainder
from hearthpanel.llm.term_pairs import joint_terms
from hearthpanel.workspace import materialize

BUCKETS = 1 << 20
MAX_DOCS = 20_000
MAX_TERMS = 2_000
MIN_CHI2 = 24.0
# A chi-square of n documents is n at most, so words in fewer documents of the sample have no pair.
PAIR_CHI2 = 200.0
FACTORS = 4
THRESHOLD = 0.7
PREFIXES = (4, 5, 7)
_TERM = re.compile(r"[^\W\d_]+")
_CACHED = 1 << 17


def buckets(word: str) -> list[int]:
    """Of a word and its beginnings."""
    found = [word, *[f"{word[:n]}*" for n in PREFIXES if n < len(word)]]
    return [zlib.crc32(t.encode()) % BUCKETS for t in found]


def words(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


class Model(NamedTuple):
    bias: float
    buckets: tuple[int, ...]
    weights: tuple[float, ...]
    factors: tuple[tuple[float, ...], ...]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(buckets: list[int], docs: list[list[int]], labels: list[int], steps: int = 400) -> Model:
    """Full-batch Adam on the logistic loss with small quadratic penalties. ``docs`` hold positions in
    ``buckets``; the result does not depend on anything but the arguments."""
    y = np.array(labels, np.float64)
    n, terms = len(y), len(buckets)
    row = np.repeat(np.arange(n), [len(d) for d in docs])
    col = np.array([t for d in docs for t in d], np.int64)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    w = np.zeros(terms + 1)
    w[-1] = np.log(share / (1 - share))
    v = np.random.default_rng(1).normal(0, 0.05, (terms, FACTORS))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]

    def by_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values, n)

    for step in range(1, steps + 1):
        sums = np.stack([by_doc(v[col, f]) for f in range(FACTORS)], 1)
        squares = by_doc((v[col] ** 2).sum(1))
        error = _sigmoid(w[-1] + by_doc(w[col]) + 0.5 * ((sums**2).sum(1) - squares)) - y
        gw = np.append(np.bincount(col, error[row], terms), error.sum()) / n
        gw[:-1] += 1e-5 * w[:-1]
        each = error[row][:, None] * (sums[row] - v[col])
        gv = np.stack([np.bincount(col, each[:, f], terms) for f in range(FACTORS)], 1) / n + 1e-5 * v
        for value, grad, k, rate in ((w, gw, 0, 0.1), (v, gv, 2, 0.03)):
            moments[k] += 0.1 * (grad - moments[k])
            moments[k + 1] += 0.01 * (grad**2 - moments[k + 1])
            value -= rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-9)
    return Model(float(w[-1]), tuple(buckets), tuple(w[:-1].tolist()), tuple(map(tuple, v.tolist())))


class Scorer:
    def __init__(self, model: Model):
        self.bias = model.bias
        self.place = {b: i for i, b in enumerate(model.buckets)}
        self.w = np.array(model.weights)
        self.v = np.array(model.factors).reshape(len(model.buckets), FACTORS)
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= _CACHED:
            self.known.clear()
        places = self.known[word] = tuple(self.place[b] for b in buckets(word) if b in self.place)
        return places

    def score(self, text: str | None) -> float:
        known = self.known.get
        found = {p if (p := known(w)) is not None else self._learn(w) for w in set(words(text))}
        places = set().union(*found)
        total = self.bias
        if places:
            at = sorted(places)
            v = self.v[at]
            total += self.w[at].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(_sigmoid(np.float64(total)))


@lru_cache(maxsize=1)
def scorer(model: Model) -> Scorer:
    return Scorer(model)


def hashed_terms(text: Column) -> Column:
    """The distinct buckets of a text, in order."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({b for w in set(words(x)) for b in buckets(w)}) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return run(text)


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic); ``learn`` chooses rows by doc_id."""
    marked = pick(labels, "doc_id", "toxic").filter(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marked.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        share = (toxic or 0) / n if n else 0.0
        return Model(float(np.log(share / (1 - share))) if 0 < share < 1 else 40.0 if share else -40.0, (), (), ())
    part = min(1.0, MAX_DOCS / n)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))
    texts = pick(docs, "doc_id", "text").filter(learn & drawn)
    # Only hashed terms are shuffled, not texts.
    hashed = texts.select("doc_id", hashed_terms(F.col("text")).alias("terms"))
    rows = materialize(hashed.join(marked.filter(drawn), "doc_id"), "terms")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return Model(-40.0, (), (), ())
    each = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term")
    counts = each.agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("m"))
    b = F.col("m") - F.col("a")
    gap = (F.col("a") * F.lit(n - toxic) - b * F.lit(toxic)).cast("double")
    chi2 = F.try_divide(gap * gap * float(n), F.lit(float(toxic) * (n - toxic)) * F.col("m") * (F.lit(n) - F.col("m")))
    best = counts.withColumn("chi2", F.coalesce(chi2, F.lit(0.0))).filter((F.col("chi2") >= MIN_CHI2) & (F.col("m") >= 3))
    alone = best.orderBy(F.desc("chi2"), "term").limit(MAX_TERMS).collect()
    joint = joint_terms(rows, PAIR_CHI2).orderBy(F.desc("joint"), "term").limit(MAX_TERMS).collect()
    chosen = sorted({r.term for r in alone} | {r.term for r in joint})
    place = {t: i for i, t in enumerate(chosen)}
    kept = F.array_intersect("terms", F.array(*[F.lit(t) for t in chosen]).cast("array<int>"))
    sample = rows.select("doc_id", "toxic", kept.alias("terms")).collect()
    sample.sort(key=lambda r: (r.doc_id, r.toxic, r.terms))
    return fit(chosen, [[place[t] for t in r.terms] for r in sample], [r.toxic for r in sample])


def scored(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        score = scorer(model).score
        return pa.array([score(t) for t in texts.to_pylist()], pa.float64())

    return run(text)


def learned(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return remainder(doc_id, 3) != 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, learned(F.col("doc_id")))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", (~learned(F.col("doc_id"))).alias("held_out"), scored(F.col("text"), model).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
