"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

The vocabulary is counted over whole texts. Every word's neighbourhood (each deletion, and each replacement
of a letter by a larger one) is generated as hashes only and probed against Bloom filters of the vocabulary.
Filters are sharded by word length, as an edit's length is known, and blocked: a key's ``BITS`` bits lie in one
block of 512, so a probe reads one place. Edits the filters know are written out as strings and joined with
the vocabulary, which removes the false positives. Each pair is generated once, from its longer or smaller
word, and counted for both.

All filters of one round have ``ROUND_BYTES`` at most: a larger vocabulary is sliced by hash and probed in so
many rounds, each broadcasting the filters of one slice. What is broadcast therefore never grows with the
data, and neither does the rate of false positives. The neighbours of a word are bounded by its length and
the letters, so no join key is hot. Hashes are polynomials over the code points, so that an edit's hash
follows from the word's by one addition; a word of any length is handled piece by piece.

Nulls have no words; an unknown document id counts as empty text. Repeated rows count again. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import pick
from hearthpanel.workspace import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What a lower-cased run can hold, in code-point order.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
SHORTEST, FEWEST = 5, 3
DAMAGE = 97
ROUND_BYTES = 32 << 20
BITS_PER_WORD, BITS = 16, 8
_BLOCK = 512
_AT_ONCE = 1 << 20  # edits hashed together

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: letter runs of all texts, some damaged, that are long and frequent enough."""
    rows = pick(docs, "doc_id", "text")
    # Shorter runs cannot give a word, whether damaged or not.
    found = F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), 0)
    runs = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.pmod(h, F.lit(DAMAGE)) == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= FEWEST)


@lru_cache(maxsize=64)
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64))
    return out


def _by_length(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places of its words, and their code points as rows."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == n)
        step = max(1, _AT_ONCE // n)
        for some in (places[b : b + step] for b in range(0, len(places), step)):
            joined = "".join([words[i] for i in some]).encode("utf-32-le")
            yield some, np.frombuffer(joined, np.uint32).reshape(-1, n)


def hashes(points: np.ndarray) -> np.ndarray:
    return (points.astype(np.uint64) * _powers(points.shape[1])).sum(axis=1, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slot(h: np.ndarray, blocks: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, block, and the key's bits within the block as ``BITS`` numbers below 512."""
    mixed = _mixed(h)
    again = _mixed(mixed ^ _BASE)
    part = (mixed >> np.uint64(32)) % np.uint64(rounds)
    block = (mixed & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)
    steps = np.arange(BITS, dtype=np.uint64)
    first, step = again & np.uint64(511), (again >> np.uint64(9)) & np.uint64(511) | np.uint64(1)
    return part, block.astype(np.int64), (first[:, None] + steps * step[:, None]) & np.uint64(511)


def _edits(points: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Neighbours of equally long words, in pieces: length, hash, word (row), position, letter (0: deleted)."""
    rows, n = points.shape
    powers = _powers(n)
    terms = points.astype(np.uint64) * powers
    whole = terms.sum(axis=1, dtype=np.uint64)
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    shorter = upto - terms + (whole[:, None] - upto) * _BACK
    # Within a run of one letter every deletion gives the same word.
    new = np.ones(points.shape, bool)
    new[:, 1:] = points[:, 1:] != points[:, :-1]
    row, at = np.nonzero(new)
    yield n - 1, shorter[row, at], row, at, np.zeros(len(row), np.uint32)
    width = max(1, _AT_ONCE // max(1, rows * len(letters)))
    for begin in range(0, n, width):
        old = points[:, begin : begin + width]
        larger = letters[None, None, :] > old[:, :, None]
        row, at, which = np.nonzero(larger)
        letter = letters[which]
        change = (letter.astype(np.uint64) - old[row, at].astype(np.uint64)) * powers[begin + at]
        yield n, whole[row] + change, row, begin + at, letter


def _filter_rows(blocks: dict[int, int], rounds: int) -> Callable:
    """Partial filters of a partition: slice, length, block, place of the 64 bits in it, and the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, points in _by_length(batch.column(0).to_pylist()):
                n = points.shape[1]
                part, block, bits = _slot(hashes(points), blocks[n], rounds)
                cell = (part.astype(np.int64) * blocks[n] + block)[:, None] * 8 + (bits >> np.uint64(6)).astype(np.int64)
                order = np.argsort(cell, axis=None, kind="stable")
                cells = cell.ravel()[order]
                marks = np.uint64(1) << (bits.ravel()[order] & np.uint64(63))
                begin = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
                found.append((np.full(len(begin), n), cells[begin], np.bitwise_or.reduceat(marks, begin).view(np.int64)))
            columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["length", "cell", "bits"])

    return run


def _probe(filters, blocks: dict[int, int], part: int, rounds: int, letters: str) -> Callable:
    """Edits of a partition's words that the filters of one slice know."""
    alphabet = np.frombuffer(letters.encode("utf-32-le"), np.uint32)

    def known(length: int, h: np.ndarray) -> np.ndarray:
        table = filters.value.get(length)
        if table is None:
            return np.zeros(0, np.int64)
        mixed = _mixed(h)
        places = np.arange(len(h))
        if rounds > 1:
            places = places[(mixed >> np.uint64(32)) % np.uint64(rounds) == np.uint64(part)]
            mixed = mixed[places]
        block = ((mixed & np.uint64(0xFFFFFFFF)) % np.uint64(blocks[length])).astype(np.int64) * 8
        again = _mixed(mixed ^ _BASE)
        bit, step = again & np.uint64(511), (again >> np.uint64(9)) & np.uint64(511) | np.uint64(1)
        for _ in range(BITS):  # most are out after one or two bits
            hit = (table[block + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            places, block, step, bit = places[hit], block[hit], step[hit], bit[hit]
            bit = (bit + step) & np.uint64(511)
        return places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            step = max(1, _AT_ONCE // len(letters))
            for places, points in _by_length(words):
                per = max(1, step // points.shape[1])
                for begin in range(0, len(places), per):
                    for length, h, row, at, letter in _edits(points[begin : begin + per], alphabet):
                        hit = known(length, h)
                        if len(hit):
                            source = places[begin + row[hit]]
                            own = [words[i] for i in source.tolist()]
                            edits = [
                                w[:i] + (chr(c) if c else "") + w[i + 1 :]
                                for w, i, c in zip(own, at[hit].tolist(), letter[hit].tolist())
                            ]
                            columns = [pa.array(own), pa.array(counts[source]), pa.array(edits)]
                            yield pa.RecordBatch.from_arrays(columns, names=["a", "n_a", "b"])

    return run


def pairs(words: DataFrame, letters: str = LETTERS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """a, n_a, b, n_b: words (word, n) that differ by exactly one inserted, deleted or replaced letter, each
    pair once. ``letters`` are all letters words can hold. ``words`` is read several times: give a written table."""
    spark = words.sparkSession
    # One row per length of a word, a handful.
    sizes = {r.length: r.words for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("words")).collect()}
    total = sum(-(-w * BITS_PER_WORD // _BLOCK) * _BLOCK // 8 for w in sizes.values())
    rounds = max(1, -(-total // round_bytes))
    blocks = {n: -(-w * BITS_PER_WORD // (_BLOCK * rounds)) for n, w in sizes.items()}
    cells = words.select("word").mapInArrow(_filter_rows(blocks, rounds), "length bigint, cell bigint, bits bigint")
    cells = cells.groupBy("length", "cell").agg(F.bit_or("bits").alias("bits"))
    if rounds > 1:
        cells = materialize(cells, "filters")
    found = None
    for part in range(rounds):
        filters = {}
        for n, b in blocks.items():
            filters[n] = np.zeros(b * 8, np.uint64)
        low = F.create_map(*[F.lit(x) for n, b in blocks.items() for x in (n, part * b * 8)])[F.col("length")]
        high = F.create_map(*[F.lit(x) for n, b in blocks.items() for x in (n, (part + 1) * b * 8)])[F.col("length")]
        mine = cells.filter((F.col("cell") >= low) & (F.col("cell") < high)) if rounds > 1 else cells
        # At most ROUND_BYTES of filters, which are then broadcast.
        table = mine.select("length", "cell", "bits").toArrow()
        lengths, places, bits = (c.to_numpy() for c in table.columns)
        for n, b in blocks.items():
            own = lengths == n
            filters[n][places[own] - part * b * 8] = bits[own].view(np.uint64)
        shared = spark.sparkContext.broadcast(filters)
        probe = _probe(shared, blocks, part, rounds, letters)
        some = words.select("word", "n").mapInArrow(probe, "a string, n_a bigint, b string")
        if rounds > 1:
            some = materialize(some, "positives")
        found = some if found is None else found.unionByName(some)
    return found.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def neighbours(words: DataFrame, letters: str = LETTERS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n_near, form and form_n of the words that have near words; the form may be too rare to count."""
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("near")).alias("other")),
            F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("m"), F.col("a").alias("near")).alias("other")),
        )
    )
    sides = pairs(words, letters, round_bytes).select(both.alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows (word, form): forms followed to the last.

    Level by level from the last forms down: a word is resolved after its form. Each form has a bounded
    number of words (its neighbours), so no join key is hot; counts double at every step, so there are no
    more levels than the logarithm of the largest count.
    """
    open_ = forms.select("word", "form")
    words = open_.select(F.col("word").alias("form"))
    solved = materialize(open_.join(words, "form", "left_anti").select("word", F.col("form").alias("root")), "roots")
    open_ = materialize(open_.join(words, "form", "left_semi").select("word", "form"), "forms")
    out = last = solved
    while open_.limit(1).count():
        known = last.select(F.col("word").alias("form"), "root")
        both = materialize(open_.join(known, "form", "left"), "level")
        last = both.filter("root is not null").select("word", "root")
        open_ = both.filter("root is null").select("word", "form")
        out = out.unionByName(last)
    return out


def spelling_variants(docs: DataFrame, letters: str = LETTERS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = materialize(word_counts(docs), "words")
    near = words.join(neighbours(words, letters, round_bytes), "word", "left")
    counts = F.col("form_n") >= 2 * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(counts, F.col("form")).alias("form"), F.when(counts, F.col("form_n")).alias("form_n"),
    )
    near = materialize(near, "near")
    found = roots(near.filter("form is not null"))
    return near.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
