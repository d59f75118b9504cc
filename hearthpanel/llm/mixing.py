"""Mixing sources to target weights.

Targets follow capped water-filling: every source gets its weight's share of the budget; sources
above their cap (a number of epochs) are clamped, and the excess is shared again by weight until no
source is above. A source's target is taken as whole repetitions of all its documents and a seeded
part of one more.

The part is the documents first in the order of a seeded hash, as long as they fit; two passes then
fill what is left with the largest document that fits. Where the order is cut is found by counting
per hash prefix, so no source is ever sorted or gathered as a whole, however many rows it has.

Null texts have size 0, null sources are a source of their own, null ids hash as empty text, equal
rows are taken or left together, an empty table gives an empty mix. Sources of size 0 get target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.llm.common import numbered, pick, renamed, with_ordinal, word_count
from hearthpanel.operators.keyed import null_safe_join
from hearthpanel.workspace import materialize

SEED = 7
FILL_PASSES = 2
# Hash digits read per counting pass: a source has at most 16 ** DIGITS cells in a pass.
DIGITS, PASSES = 3, 2


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``sources`` with a ``weight``: the given ones repeated over the sources by code point, null last."""
    values = F.array(*[F.lit(float(w)) for w in weights])
    ordered = with_ordinal(sources, F.col("source").isNull(), F.col("source"))
    return ordered.withColumn("weight", values[F.pmod("ordinal", F.lit(len(weights))).cast("int")]).drop("ordinal")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``; targets add up to ``share`` of all sizes
    as far as the caps of ``max_epochs`` allow. Each round is one aggregation to one row."""
    cap, weight = F.col("source_size") * max_epochs, F.col("weight")
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = 0.0, -1
    while True:
        over = cap < weight * F.lit(level) if clamped >= 0 else F.lit(False)
        held, free, n = sources.agg(
            F.sum(F.when(over, cap)), F.sum(F.when(over, 0.0).otherwise(weight)), F.count(F.when(over, 1))
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (budget - (held or 0.0)) / free
    if clamped >= 0 and not free:
        return sources.withColumn("target", cap)
    return sources.withColumn("target", F.least(cap, weight * F.lit(level)))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the seeded ``key`` of every document."""
    return pick(docs, "doc_id", "text", "source").select("doc_id", "source", word_count(F.col("text")).alias("size"))


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _place() -> Column:
    return F.struct("key", "doc_id", "size")


def _cut(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """source, place: the first place in the seeded order that does not fit; no row if all fit."""
    left = sources.filter("need > 0").select("source", "need")
    rows = groups
    for i in range(PASSES):
        prefix = F.substring("key", 1, DIGITS * (i + 1))
        cells = rows.withColumn("cell", prefix).groupBy("source", "cell").agg(F.sum("total").alias("total"))
        # At most 16 ** DIGITS cells of a source.
        running = Window.partitionBy("source").orderBy("cell")
        over = (
            null_safe_join(cells, left, ["source"], "inner")
            .withColumn("upto", F.sum("total").over(running))
            .filter("upto > need")
            .groupBy("source")
            .agg(F.min_by(F.struct("cell", (F.col("need") - F.col("upto") + F.col("total")).alias("need")), "cell").alias("c"))
            .select("source", "c.cell", "c.need")
        )
        left = materialize(over, "cells")
        rows = null_safe_join(rows, left.withColumnsRenamed({"cell": "_cell"}).drop("need"), ["source"], "inner")
        rows = rows.filter(prefix == F.col("_cell")).drop("_cell")
        left = left.drop("cell")
    # What shares all digits read: a 16 ** -(DIGITS * PASSES) part of a source.
    running = Window.partitionBy("source").orderBy("place")
    last = null_safe_join(rows.withColumn("place", _place()), left, ["source"], "inner")
    last = last.withColumn("upto", F.sum("total").over(running)).filter("upto > need")
    return last.groupBy("source").agg(F.min("place").alias("cut"))


def plan(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int = SEED) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, ``cut`` (places before it are taken
    once more; null: none or all, see ``all_more``) and ``filled`` (further places taken once more)."""
    groups = materialize(
        sizes.groupBy("source", "doc_id", "size").agg((F.col("size") * F.count(F.lit(1))).alias("total"))
        .withColumn("key", _key(F.col("doc_id"), seed)),
        "groups",
    )
    sources = groups.groupBy("source").agg(F.sum("total").alias("source_size"))
    sources = materialize(water_fill(materialize(cyclic_weights(sources, weights), "sources"), share, max_epochs), "sources")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long"))
    sources = sources.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    chosen = materialize(
        null_safe_join(sources, _cut(groups, sources), ["source"]).withColumn(
            "filled", F.array().cast("array<struct<key:string,doc_id:bigint,size:bigint>>")
        ),
        "cuts",
    )
    for _ in range(FILL_PASSES):
        rows = null_safe_join(groups.withColumn("place", _place()), chosen, ["source"], "inner")
        taken = F.sum(F.when(more(F.col("place")), F.col("total")))
        gaps = rows.filter("need > 0").groupBy("source").agg((F.first("need") - F.coalesce(taken, F.lit(0))).alias("gap"))
        fits = null_safe_join(rows, materialize(gaps, "gaps"), ["source"], "inner")
        fits = fits.filter(~more(F.col("place")) & (F.col("total") > 0) & (F.col("total") <= F.col("gap")))
        best = fits.groupBy("source").agg(F.max_by("place", F.struct("total", "place")).alias("best"))
        added = F.when(F.col("best").isNull(), F.col("filled")).otherwise(F.array_append("filled", F.col("best")))
        chosen = materialize(null_safe_join(chosen, best, ["source"]).withColumn("filled", added).drop("best"), "filled")
    return chosen


def more(place: Column) -> Column:
    """Whether a document at ``place`` is taken once more than its source's whole repetitions."""
    before = F.coalesce(place < F.col("cut"), F.lit(True))
    return F.coalesce((F.col("need") > 0) & (before | F.array_contains("filled", place)), F.lit(False))


def with_copies(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with ``source_size``, ``target`` and ``copies``."""
    keyed = rows.withColumn("key", _key(F.col("doc_id"), seed)).withColumn("place", _place())
    joined = null_safe_join(keyed, sources.drop("weight"), ["source"])
    copies = F.col("whole") + more(F.col("place")).cast("long")
    return joined.withColumn("copies", copies).drop("key", "place", "whole", "need", "cut", "filled")


def mix_counts(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    sizes = materialize(sized(docs), "sizes")
    rows = with_copies(sizes, plan(sizes, weights, share, max_epochs))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with the columns of ``docs``."""
    sizes = materialize(sized(docs), "sizes")
    sources = plan(sizes, weights, share, max_epochs)
    plain, names = numbered(docs)
    at = {n: F.col(f"c{names.index(n)}") for n in ("doc_id", "text", "source")}
    wide = plain.withColumns({"doc_id": at["doc_id"], "source": at["source"], "size": word_count(at["text"])})
    rows = with_copies(wide, sources).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return renamed(rows.filter("copies > 0"), names)
