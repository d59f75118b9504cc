import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hearthpanel.llm import queries, simhash

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    """Smallest value connected with each."""
    values = sorted(values)
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {v: top(v) for v in values}


def clusters(seed, n=40):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.add(v)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                v ^= 1 << b
    return out


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("seed,tile", [(1, 2048), (2, 4), (3, 1)])
def test_components_of_random_fingerprints(spark, seed, tile):
    values = clusters(seed)
    df = spark.createDataFrame([(signed(v),) for v in values], "bits bigint")
    found = simhash.components(simhash.links(df, tile)).collect()
    got = {}
    for r in found:
        got.setdefault(r.root, {r.root}).add(r.node)
    want = {}
    for v, root in brute_components(values).items():
        want.setdefault(root, set()).add(signed(v))
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_one_dense_group(spark):
    """Thousands within the radius of each other, many tiles: one component, few links."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    df = spark.createDataFrame([(signed(v),) for v in values], "bits bigint").repartition(8)
    links = simhash.links(df, 128)
    assert links.count() < 60 * len(values)
    assert simhash.components(links).select("root").distinct().count() == 1


def test_a_task_reports_one_link_a_member(spark, monkeypatch):
    """Whatever buckets and pairs of tiles a dense group meets in; with and without uniting on the way."""
    rng = random.Random(6)
    centre = rng.getrandbits(63)
    values = sorted({centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(60) for b in range(a)})
    df = spark.createDataFrame([(v,) for v in values], "bits bigint").coalesce(1)
    members = df.select("bits", F.explode(simhash._bucket_keys(F.col("bits"))).alias("bucket"))
    rows = simhash._tiled(members, 64).coalesce(1).sortWithinPartitions("bucket", "pair").toArrow()
    rows = rows.select(["bucket", "pair", "bits"])
    for held in (1 << 20, 100):
        monkeypatch.setattr(simhash, "LINKS_HELD", held)
        out = [b for b in simhash._compared(iter(rows.to_batches(max_chunksize=333)))]
        u, v = (np.concatenate([b.column(i).to_numpy() for b in out]) for i in (0, 1))
        assert len(u) == len(values) - 1 and set(u) == {values[0]} and set(v) == set(values[1:])


def test_contracted_links():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    a, b = simhash.contracted(u, v)
    top = {int(x): int(x) for x in np.concatenate([u, v])}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, y in zip(u.tolist(), v.tolist()):
        low, high = sorted((root(x), root(y)))
        top[high] = low
    assert {(int(x), int(y)) for x, y in zip(a, b)} == {(root(x), x) for x in top if root(x) != x}
    assert len(simhash.contracted(u[:0], v[:0])[0]) == 0


def test_forest_connects_what_is_near():
    values = np.array(sorted(clusters(9)), np.uint64)
    a, b = simhash.forest(values)
    want = brute_components(map(int, values))
    assert len(a) == len(values) - len(set(want.values()))
    assert all(want[int(x)] == want[int(y)] for x, y in zip(a, b))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 100), (200, 201), (200, 201)], "u bigint, v bigint")
    got = {(r.node, r.root) for r in simhash.components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(201, 200)}


def test_query(spark):
    rows = queries.op6_simhash(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bits = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = brute_components(set(bits.values()))
    first = {}
    for i in sorted(bits, reverse=True):
        first[root[bits[i]]] = i
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{b:016x}", first[root[b]]) for i, b in bits.items()
    }


def test_edges(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(edge_rows)
    by = {r.doc_id: r for r in got}
    assert {i for i, r in by.items() if r.fingerprint == "0" * 16} >= {3, 4, 6}
    assert by[3].component_id == by[4].component_id == by[6].component_id == 3
    assert by[1].component_id == by[2].component_id == 1
    for r, (_, text, _, _) in zip(sorted(got, key=str), sorted(edge_rows, key=str)):
        assert r.fingerprint == f"{brute_fingerprint(text):016x}" or r.doc_id is None
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    components = {r.component_id for r in got}
    assert sorted(map(str, ids)) == sorted(map(str, components))
    assert simhash.near_duplicates(make_docs([])).count() == 0 == simhash.keep_first(make_docs([])).count()
    unknown = make_docs([(None, "a b c d", "en", "a"), (None, "q r s t u", "en", "a")])
    assert simhash.keep_first(unknown).count() == 2
