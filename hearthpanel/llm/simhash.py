"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of equal texts are compared once. Two fingerprints within ``RADIUS`` bits agree in two of
``BLOCKS`` blocks of bits at least, so only fingerprints that share two blocks need comparing, and no
pair is missed. What shares two blocks is a bucket; a bucket of more than ``TILE`` fingerprints is cut
into tiles by population count and hash, and every pair of tiles whose population counts differ by no
more than the radius is compared, each pair of tiles in whatever task it falls to. The comparison is
exclusive-or and bit count on numpy arrays. A task reports not all its links but one link less than members
per set that they connect, so dense groups, which meet in many buckets and pairs of tiles, stay small. Connected components of the links are found
by alternating star contraction, a few joins over written tables.

Nulls and texts without a word have fingerprint zero and are linked like any other. Null ids are never
the smallest id; a component of null ids only has a null id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import numbered, pick, renamed
from hearthpanel.operators.keyed import attach
from hearthpanel.workspace import materialize

RADIUS = 3
SHINGLE = 3
BLOCKS = (13, 13, 13, 13, 12)
TILE = 2048
LINKS_HELD = 1 << 20
_HASHED_AT_ONCE, _SENT_AT_ONCE = 1 << 16, 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of XXH64 (seed 42) over the text's word shingles, unsigned."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if n > 1 else iter([b" ".join(words)])
    hashes = map(partial(xxhash.xxh64_intdigest, seed=42), joined)
    counts = np.zeros(64, np.int64)
    for begin in range(0, n, _HASHED_AT_ONCE):
        some = np.fromiter(hashes, np.uint64, min(_HASHED_AT_ONCE, n - begin))
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint's 64 bits as a signed integer."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64)
        return pa.array(found.view(np.int64), pa.int64())

    return run(text)


def _bucket_keys(bits: Column) -> Column:
    """One number for every choice of two blocks and what they hold."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    parts = [F.shiftrightunsigned(bits, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCKS)]
    chosen = enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(parts[i], BLOCKS[j])).bitwiseOR(parts[j]) for n, (i, j) in chosen]
    return F.array(*keys)


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """bucket, pair, bits: every member in each pair of tiles it is compared in; pair 0 is a whole bucket."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    marked = attach(members, sizes, ["bucket"], "n").filter("n is not null")
    few = marked.filter(F.col("n") <= tile).select("bucket", F.lit(0).cast("long").alias("pair"), "bits")
    many = marked.filter(F.col("n") > tile).select("bucket", "bits", F.bit_count("bits").cast("long").alias("ones"))
    # A tile is a part by hash of the members with one population count; some 64 rows per large bucket.
    tiles = many.groupBy("bucket", "ones").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("parts"))
    tiles = materialize(tiles, "tiles")
    mine = many.join(tiles, ["bucket", "ones"]).withColumn("part", F.pmod(F.xxhash64("bits"), "parts")).drop("parts")
    near = F.explode(F.sequence(F.col("ones") - RADIUS, F.col("ones") + RADIUS))
    met = mine.withColumn("other", near).join(tiles.withColumnRenamed("ones", "other"), ["bucket", "other"])
    met = met.withColumn("other_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    one, two = [F.col(a) * (1 << 24) + F.col(b) for a, b in (("ones", "part"), ("other", "other_part"))]
    pair = F.shiftleft(F.least(one, two), 31).bitwiseOR(F.greatest(one, two)) + 1
    return few.unionByName(met.select("bucket", pair.alias("pair"), "bits"))


def forest(bits: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within the radius: the root and the other member."""
    ones = np.bitwise_count(bits).astype(np.int16)
    order = np.argsort(ones, kind="stable")
    bits, ones = bits[order], ones[order]
    low = np.searchsorted(ones, ones - radius, "left")
    high = np.searchsorted(ones, ones + radius, "right")
    free = np.ones(len(bits), bool)
    roots, others = [], []
    for start in range(len(bits)):
        if not free[start]:
            continue
        free[start] = False
        waiting = [start]
        while waiting:
            i = waiting.pop()
            a, b = low[i], high[i]
            near = a + np.flatnonzero(free[a:b] & (np.bitwise_count(bits[a:b] ^ bits[i]) <= radius))
            if len(near):
                free[near] = False
                waiting += near.tolist()
                roots.append(np.full(len(near), bits[start]))
                others.append(bits[near])
    empty = np.zeros(0, np.uint64)
    return np.concatenate(roots or [empty]), np.concatenate(others or [empty])


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connected sets with one link less than members each, from the smallest member to the others."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while len(a):
        while (top[top] != top).any():
            top = top[top]
        a, b = top[a], top[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        a, b = low[low != high], high[low != high]
        np.minimum.at(top, b, a)
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[top[below]], nodes[below]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by bucket and pair; a pair of tiles may go on in the next batch.

    A dense group meets in many buckets and pairs of tiles. A task therefore unites what it finds before it
    reports it, one link per member; it holds ``LINKS_HELD`` links beside these.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    count = limit = 0
    for u, v in _links_found(batches):
        found.append((u, v))
        count += len(u)
        if count > LINKS_HELD + limit:
            found = [contracted(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))]
            count = limit = len(found[0][0])
    if count:
        u, v = contracted(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))
        for b in range(0, len(u), _SENT_AT_ONCE):
            columns = [pa.array(c[b : b + _SENT_AT_ONCE]) for c in (u, v)]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "v"])


def _links_found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held = [np.zeros(0, np.int64)] * 3

    def links(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        bucket, pair, signed = columns
        bits = signed.view(np.uint64)
        ends = np.flatnonzero((bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])) + 1
        begin = np.concatenate([[0], ends]).astype(np.int64)
        size = np.diff(np.append(begin, len(bits)))
        two = begin[size == 2]
        two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= RADIUS]
        found = [(bits[two], bits[two + 1])]
        found += [forest(bits[b : b + n]) for b, n in zip(begin[size > 2], size[size > 2])]
        return tuple(np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))

    for batch in batches:
        columns = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
        if not len(columns[0]):
            continue
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
        done = len(last) - int(last.sum())
        held = [c[done:] for c in columns]
        if done:
            yield links([c[:done] for c in columns])
    if len(held[0]):
        yield links(held)


def links(bits: DataFrame, tile: int = TILE) -> DataFrame:
    """u, v: links between the distinct ``bits``, enough to connect all that are within the radius."""
    members = bits.select("bits", F.explode(_bucket_keys(F.col("bits"))).alias("bucket"))
    sorted_rows = _tiled(members, tile).repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    return sorted_rows.select("bucket", "pair", "bits").mapInArrow(_compared, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node connected with each node that has an edge (u, v)."""

    def stored(rows: DataFrame) -> tuple[DataFrame, tuple]:
        rows = materialize(rows.filter("u < v").distinct(), "edges")
        return rows, tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now, mark = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    while True:
        # Every node hands its smallest neighbour to the larger ones ...
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"), F.count(F.lit(1)).alias("n"))
        larger = attach(both, least, ["u"], "n").filter("v > u").select(F.col("low").alias("u"), "v")
        larger = materialize(larger.filter("u < v").distinct(), "larger")
        # ... and then to the smaller ones.
        least = larger.groupBy("v").agg(F.min("u").alias("low"), F.count(F.lit(1)).alias("n"))
        smaller = attach(larger, least, ["v"], "n")
        ends = F.explode(F.array("u", "v"))
        then, new_mark = stored(smaller.select(F.col("low").alias("u"), ends.alias("v")))
        if new_mark == mark:
            return then.select(F.col("v").alias("node"), F.col("u").alias("root"))
        now, mark = then, new_mark


def grouped(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (doc_id, mark, bits) of every document, ``mark`` a hash of its text, and
    (bits, component_id, first, n): per fingerprint its component's smallest id, the place of the
    component's first document as (id is null, id, mark), and the number of its documents."""
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("mark"), fingerprints(F.col("text"), shingle).alias("bits")
    )
    rows = materialize(rows, "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")
    nodes = rows.groupBy("bits").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes, "nodes")
    found = components(links(nodes.select("bits")))
    rooted = nodes.join(found.withColumnRenamed("node", "bits"), "bits", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "bits"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("of_all"), F.count(F.lit(1)).alias("members"))
    best = attach(rooted, firsts, ["root"], "members")
    return rows, best.select("bits", F.col("of_all.doc_id").alias("component_id"), F.col("of_all").alias("first"), "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    rows, groups = grouped(docs)
    joined = attach(rows, groups.select("bits", "component_id", "n"), ["bits"], "n")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of every component, the first by id, with all its columns."""
    rows, groups = grouped(docs, shingle)
    kept = materialize(groups.select("first").distinct().select("first.unknown", "first.doc_id", "first.mark"), "kept")
    keys = ["unknown", "key", "mark"]
    id_key = F.coalesce("doc_id", F.lit(0)).alias("key")
    kept = kept.select("unknown", id_key, "mark")
    plain, names = numbered(docs)
    at = {n: F.col(f"c{names.index(n)}") for n in ("doc_id", "text")}
    wide = plain.withColumns(
        {"unknown": at["doc_id"].isNull(), "key": F.coalesce(at["doc_id"], F.lit(0)), "mark": F.xxhash64(at["text"])}
    )
    chosen = wide.join(kept, keys, "left_semi")
    narrow = rows.select(F.col("doc_id").isNull().alias("unknown"), id_key, "mark").join(kept, keys, "left_semi")
    # Rows that repeat id and text are all first; only then another pass is needed.
    if narrow.count() > kept.count():
        chosen = chosen.dropDuplicates(keys)
    return renamed(chosen, names)
