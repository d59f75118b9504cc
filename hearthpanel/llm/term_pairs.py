"""Terms whose dependence on a label shows only together with another term.

For a pair of terms two chi-square values are taken: of the label with the one term among the documents that hold
the other, and the other way round. A pair counts if both reach ``least``: a word that is frequent beside a
strong word says nothing more among the documents with the strong word, and the pair falls out; an insult and a
mention that are toxic only together pass, whatever they say alone. A chi-square of n documents is n at most, so terms
in fewer than ``least`` documents cannot pass and need not be compared; no other pair is left out.

Terms are the rows of a matrix of documents, in packed bits and tiles of ``TILE`` terms. Tiles meet in pairs and a
pair of tiles is two matrix products, one of all and one of the labelled documents. Tiles are broadcast in rounds of at
most ``ROUND_BYTES``, more rounds for more terms, so no pair of tiles is shuffled and a task holds two unpacked tiles.

Repeated terms of a document count once, null terms as none; without documents of both labels nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import with_ordinal
from hearthpanel.workspace import materialize

TILE = 512
ROUND_BYTES = 32 << 20


def _chi2(a: np.ndarray, m: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of label and term where ``n`` documents hold ``toxic`` labelled ones, ``m`` the term and ``a`` both."""
    below = toxic * (n - toxic) * m * (n - m)
    gap = a * (n - toxic) - (m - a) * toxic
    return np.divide(gap * gap * n, below, out=np.zeros_like(gap), where=below > 0)


def synergies(first: np.ndarray, second: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The lesser of both conditional chi-squares of all pairs of rows; arrays of 0 and 1, documents as columns."""
    x, y = first.astype(np.float32), second.astype(np.float32)
    # Counts of a bounded sample are whole numbers that single precision holds exactly.
    m = (x @ y.T).astype(np.float64)
    a = ((x * labels.astype(np.float32)) @ y.T).astype(np.float64)
    n1, n2 = x.sum(1, dtype=np.float64)[:, None], y.sum(1, dtype=np.float64)[None, :]
    t1, t2 = (x @ labels.astype(np.float32)).astype(np.float64)[:, None], (y @ labels.astype(np.float32)).astype(np.float64)[None, :]
    ones = np.ones_like(m)
    return np.minimum(_chi2(a, m, t1 * ones, n1 * ones), _chi2(a, m, t2 * ones, n2 * ones))


def joint_terms(rows: DataFrame, least: float) -> DataFrame:
    """term and ``joint``, its largest value in a pair that passes; ``rows`` (doc_id, toxic, terms) are a bounded sample."""
    docs = materialize(with_ordinal(rows, F.col("doc_id")), "labelled")
    n = docs.count()
    marks = docs.select("ordinal", "toxic").sort("ordinal").collect()
    labels = np.array([r.toxic for r in marks], np.uint8)
    each = docs.select("ordinal", F.explode(F.array_distinct("terms")).alias("term")).filter("term is not null")
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= least)
    frequent = materialize(with_ordinal(counts.select("term"), F.col("term")).withColumnRenamed("ordinal", "place"), "frequent")
    tiled = each.join(frequent, "term").withColumn("tile", F.floor(F.col("place") / TILE))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        terms, at = np.unique(part["term"].to_numpy(), return_inverse=True)
        bits = np.zeros((len(terms), n), np.uint8)
        bits[at, part["ordinal"].to_numpy()] = 1
        lines = np.packbits(bits, axis=1)
        return pd.DataFrame({"tile": [int(part["tile"].iloc[0])], "terms": [terms.tolist()], "bits": [lines.tobytes()]})

    tiles = materialize(tiled.groupBy("tile").applyInPandas(packed, "tile bigint, terms array<int>, bits binary"), "tiles")
    last = tiles.agg(F.coalesce(F.max("tile"), F.lit(-1))).first()[0]
    other = tiles.select(F.col("tile").alias("other"), F.col("terms").alias("terms2"), F.col("bits").alias("bits2"))
    # A row of a tile is a bit per document and the number of its term.
    step = max(1, ROUND_BYTES // (TILE * ((n + 7) // 8 + 4)))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                t1, t2 = np.asarray(r.terms), np.asarray(r.terms2)
                b1, b2 = [np.frombuffer(b, np.uint8).reshape(len(t), -1) for b, t in ((r.bits, t1), (r.bits2, t2))]
                both = synergies(np.unpackbits(b1, axis=1, count=n), np.unpackbits(b2, axis=1, count=n), labels)
                i, j = np.nonzero(both >= least)
                yield pd.DataFrame({"term": np.concatenate([t1[i], t2[j]]), "joint": np.tile(both[i, j], 2)})

    found = docs.sparkSession.createDataFrame([], "term int, joint double")
    spread = tiles.repartition(max(1, min(last + 1, 400)), "tile")
    for begin in range(0, last + 1, step):
        # A tile meets itself and those after it.
        some = F.broadcast(other.filter(F.col("other").between(begin, begin + step - 1)))
        pairs = spread.join(some, F.col("tile") <= F.col("other"))
        hits = pairs.mapInPandas(compared, "term int, joint double").groupBy("term").agg(F.max("joint").alias("joint"))
        found = found.unionByName(materialize(hits, "joint"))
    return found.groupBy("term").agg(F.max("joint").alias("joint"))
