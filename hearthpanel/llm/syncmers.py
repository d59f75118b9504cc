"""Document fingerprints from closed syncmers.

A run of ``K`` words is an anchor if, of the hashes of the word pairs inside, one at an edge is the
smallest. That depends on nothing outside the run, so an edit changes only anchors that overlap it, and
every stretch of ``K - 1`` words or more that two texts share holds the same anchors in both. A
fingerprint is the list of all anchors of the whole text, in order, each with the number of its first word,
so that texts with the same parts in another order differ and shared parts can be placed. How alike two
texts are is the share of the distinct anchors of both that they have in common, over all anchors.

All of it is array functions on one row at a time. Texts too short for an anchor have one: all their
words; null texts and texts without a word have an empty fingerprint, which is like an empty one (1)
and unlike any other (0). Repeated rows count once in the order of documents and get equal results;
null ids come first (the smallest 64-bit integer stands for them and is no id), equal ids are ordered by a
hash of the text. The document after the last is the
first; a single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import WORD, pick, with_ordinal
from hearthpanel.workspace import materialize

K = 6
_NO_ID = -(1 << 63)


def _pairs(df: DataFrame, text: str) -> DataFrame:
    """``df`` with _words (hashes) and _pairs (hashes of two words each) of a text column."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), 0)
    hashed = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    two = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1))
    pairs = F.when(F.size("_words") >= K, F.transform(F.sequence(F.lit(0), F.size("_words") - 2), two))
    return hashed.withColumn("_pairs", pairs)


def _at_edge(i: Column) -> Column:
    inside = [F.get("_pairs", i + j) for j in range(1, K - 2)]
    return F.least(F.get("_pairs", i), F.get("_pairs", i + (K - 2))) <= F.least(*inside)


def _anchor(i: Column) -> Column:
    return F.xxhash64(*[F.get("_pairs", i + j) for j in range(0, K, 2)])


def with_anchors(df: DataFrame, text: str = "text", to: str = "anchors") -> DataFrame:
    """``df`` with an array of (position, hash): the anchors of a text and the number of their first word."""
    places = F.filter(F.sequence(F.lit(0), F.size("_words") - K), _at_edge)
    found = F.when(F.size("_words") >= K, F.transform(places, lambda i: F.struct(i.alias("position"), _anchor(i).alias("hash"))))
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64("_words").alias("hash")))
    rows = _pairs(df, text).withColumn(to, found)
    none = F.coalesce(F.size(to), F.lit(0)) <= 0
    either = F.when(F.size("_words") == 0, F.array().cast(rows.schema[to].dataType)).when(none, whole).otherwise(F.col(to))
    return rows.withColumn(to, either).drop("_words", "_pairs")


def _short(hash64: Column) -> Column:
    return F.shiftrightunsigned(hash64, 33).cast("int")


def with_marks(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the array of (position, hash of 31 bits) of a text column."""
    rows = with_anchors(df, text, to)
    return rows.withColumn(to, F.transform(to, lambda a: F.struct(a["position"], _short(a["hash"]).alias("hash"))))


def hashes(marks: str) -> Column:
    return F.array_distinct(F.col(f"{marks}.hash"))


def written(marks: str) -> Column:
    """Anchors as text: position and hash of each, hexadecimal."""
    one = lambda a: F.concat_ws(":", F.lower(F.hex(a["position"])), F.lpad(F.lower(F.hex(a["hash"])), 8, "0"))
    return F.array_join(F.transform(marks, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among the distinct ones of both texts; two without any are alike."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(all_, F.lit(1))).cast("double")


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
    )


def neighbours(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """id, mark, to_id, to_mark, to_half: for every document the one before it in the ring of ids, and
    half that one's length; and whether rows repeat. Only ids and lengths are sorted."""
    rows = keyed.groupBy("id", "mark").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("copies"))
    ring = materialize(with_ordinal(rows, F.col("id"), F.col("mark")), "ring")
    total, copies = ring.agg(F.count(F.lit(1)), F.max("copies")).first()
    before = F.pmod(F.col("ordinal") - 1, F.lit(max(1, total)))
    half = F.floor(F.col("n") / 2).cast("int")
    to = ring.select(F.col("id").alias("to_id"), F.col("mark").alias("to_mark"), half.alias("to_half"), "ordinal")
    joined = ring.select("id", "mark", before.alias("ordinal")).join(to, "ordinal").drop("ordinal")
    return materialize(joined, "neighbours"), (copies or 0) > 1


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: every
    document against its text with the second half taken from the next document, and against that one."""
    keyed = _keyed(docs)
    ring, repeated = neighbours(keyed)
    # Texts are shuffled once: both uses of ``rows`` need the same columns by the same keys, so they read
    # the same exchange; the next document's beginning comes to them.
    rows = keyed.select("id", "mark", "text")
    heads = with_marks(rows.join(ring, ["id", "mark"]), "text", "marks").select(
        F.col("to_id").alias("id"), F.col("to_mark").alias("mark"),
        F.expr("substring(text, 1, to_half)").alias("head"), hashes("marks").alias("next_hashes"),
    )
    if repeated:
        heads = heads.dropDuplicates(["id", "mark"])
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - floor(length(text) / 2))"), "head")
    both = rows.join(heads, ["id", "mark"])
    both = both.select(F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), n.cast("long").alias("n_chars"), "text", "next_hashes", edited.alias("edited"))
    done = with_marks(with_marks(both, "text", "marks"), "edited", "edited_marks")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("marks").alias("fingerprint"),
        written("edited_marks").alias("edited_fingerprint"),
        likeness(hashes("marks"), hashes("edited_marks")).alias("near_edited"),
        likeness(hashes("marks"), F.col("next_hashes")).alias("near_next"),
    )
