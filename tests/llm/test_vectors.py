import time

import numpy as np
import pytest

from hearthpanel.llm import vectors
from hearthpanel.llm.common import prepare_workers

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, links int, copies string, place int, first int"


def made(spark, rows):
    prepare_workers(spark)
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "k", 2, "c", 3, 4) for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of all pairs, in double precision."""
    able = [
        v is not None and len(v) > 0 and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) != 0 for x in v)
        for _, v in rows
    ]
    units = [vectors.unit(np.array([v], np.float32))[0] if a else None for (_, v), a in zip(rows, able)]
    near = [[] for _ in rows]
    for size in {len(u) for u in units if u is not None}:
        at = [i for i, u in enumerate(units) if u is not None and len(u) == size]
        x = np.array([units[i] for i in at])
        for i, row in zip(at, x @ x.T >= cosine):
            near[i] = [at[j] for j in np.flatnonzero(row) if at[j] != i]
    out, root = [], {}
    for i in range(len(rows)):
        if i in root:
            continue
        seen, waiting = {i}, [i]
        while waiting:
            for j in near[waiting.pop()]:
                if j not in seen:
                    seen.add(j)
                    waiting.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        root.update(dict.fromkeys(seen, min(ids, default=None)))
    for i, (vec_id, _) in enumerate(rows):
        out.append((vec_id, len(near[i]), root[i], vec_id == root[i]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def clustered(seed, n, groups, d=32, noise=0.06):
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(n, d)))
    for size in groups:
        centre = rng.normal(size=d)
        rows += list(centre + rng.normal(size=(size, d)) * rng.choice([noise, 0.3], size=(size, 1)))
    rng.shuffle(rows)
    return [(i, list(np.float32(r))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed,shards,beam", [(1, None, 48), (2, 1, 8), (3, 5, 4)])
def test_random_groups(spark, seed, shards, beam):
    """Small groups, one of hundreds, loose members near the threshold; narrow beams must widen."""
    rows = clustered(seed, 1200, [2] * 60 + [20] * 10 + [400])
    want = brute(rows)
    found = got(vectors.near_vectors(made(spark, rows), shards=shards, beam=beam))
    links = sum(r[1] for r in want)
    assert [r[0] for r in found] == [r[0] for r in want]
    assert all(a[1] <= b[1] for a, b in zip(found, want))  # none that is not there
    assert sum(r[1] for r in found) >= 0.99 * links
    assert sum(a == b for a, b in zip(found, want)) >= 0.97 * len(want)


def test_recall_of_the_graph(spark):
    """The graph itself, without widening: the nearest members of random vectors."""
    rng = np.random.default_rng(5)
    x = vectors.unit(rng.normal(size=(4000, 24)))
    graph = vectors.Graph(x)
    q = vectors.unit(x[:500] + rng.normal(size=(500, 24)) * 0.1).astype(np.float32)
    ids, sims = graph.search(q, 64)
    truth = np.argsort(-(q @ graph.x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, truth)]) > 0.97
    assert (np.diff(sims, axis=1) <= 0).all() and all(len(set(r)) == 64 for r in ids)
    assert all((links >= -1).all() for links in graph.layers) and len(graph.layers) > 2


def test_audit_widens(monkeypatch):
    """A beam of one finds one link; the audit widens it until it finds all."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 16))
    x = np.repeat(centres, 8, axis=0) + rng.normal(size=(2400, 16)) * 0.05
    shard = vectors.Shard(np.arange(2400), np.ones(2400, np.int64), np.float32(x), 0.9, 1)
    for b in range(0, 2400, 512):
        shard.ask_members(b, min(b + 512, 2400))
    u = vectors.unit(np.float32(x))
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert shard.beam > 1 or shard.exhaustive or (shard.links == want).all()
    assert shard.links.sum() >= 0.99 * want.sum()


def test_copies_are_one_class(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(500 + i, [1.0, 2.0, 3.1]) for i in range(40)] + [(900, [-1.0, 0.0, 0.0])]
    assert got(vectors.near_vectors(made(spark, rows))) == brute(rows)
    assert vectors.classes(made(spark, rows).select("vec_id", "embedding")).count() == 3


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    assert got(vectors.near_vectors(made(spark, []))) == []
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]),
        (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None), (10, [-0.0, 5.0]),
        (11, [1e-30, 1e-38]), (12, [3e38, 3e30]), (13, [0.9, 0.4358898943540673]), (14, None), (15, [0.0, 5.0]),
    ]
    assert got(vectors.near_vectors(made(spark, rows))) == brute(rows)
    assert got(vectors.near_vectors(made(spark, [(None, [1.0]), (None, [2.0])]))) == [(None, 1, None, True)] * 2
    doubles = spark.createDataFrame([(1, [1.0, 1e-9]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert got(vectors.near_vectors(doubles)) == [(1, 1, 1, True), (2, 1, 1, False)]


def grouped(seed, n, groups, noise, d=64):
    """Loose vectors and groups of near copies."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=(n - sum(groups), d))]
    x += [rng.normal(size=(1, d)) + rng.normal(size=(size, d)) * noise for size in groups]
    return np.float32(rng.permutation(np.concatenate(x)))


def asked(shard, block):
    for b in range(0, len(shard.keys), block):
        shard.ask_members(b, b + block)
    return shard


def test_work_of_a_shard():
    """Building a graph and asking it takes less time than to compare all pairs a few times."""
    x = grouped(11, 20_000, [100] * 100, 0.1)
    u = vectors.unit(x).astype(np.float32)
    before = time.process_time()
    want = np.concatenate([(u[b : b + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for b in range(0, len(u), 1000)])
    all_pairs, before = time.process_time() - before, time.process_time()
    shard = asked(vectors.Shard(np.arange(len(x)), np.ones(len(x), np.int64), x, 0.9, vectors.BEAM), vectors.BLOCK)
    assert time.process_time() - before < 3 * all_pairs
    assert abs(shard.links.sum() - want.sum()) <= 0.001 * want.sum()


@pytest.mark.parametrize("marks", [None, 1000])
def test_group_wider_than_the_beam(monkeypatch, marks):
    """A group over most nodes: beams go on until they have it all, and no pair counts twice."""
    if marks:
        monkeypatch.setattr(vectors, "_FLAGS", marks)
        monkeypatch.setattr(vectors, "_TILE", 4 * marks)
    x = grouped(12, 6000, [3000, 2, 2], 0.02)
    copies = np.random.default_rng(1).integers(1, 4, 6000)
    shard = asked(vectors.Shard(np.arange(6000), copies, x, 0.9, 4), 700)
    u = vectors.unit(x)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert not shard.exhaustive
    assert (shard.links == near @ copies).all()
    assert len(np.unique(shard._top(np.flatnonzero(near.sum(axis=1) == 2999)))) == 1


def test_queries_of_another_shard():
    """Links of queries and members, by cells and by a comparison with all."""
    x = grouped(13, 4000, [40] * 20, 0.05)
    want = vectors.unit(x[:1000]) @ vectors.unit(x[1000:]).T >= 0.9
    copies = np.random.default_rng(2).integers(1, 4, 4000)
    for beam in (6, 4000):
        shard = vectors.Shard(np.arange(1000, 4000), copies[1000:], x[1000:], 0.9, beam)
        u, v, links = shard.ask(np.arange(1000), copies[:1000], x[:1000])
        assert shard.exhaustive == (beam == 4000)
        assert (u == np.flatnonzero(want.any(axis=1))).all() and want[u, v - 1000].all()
        assert (links == (want @ copies[1000:])[u]).all()
        assert (shard.links == copies[:1000] @ want).all()


def test_audit_leaves_out_the_member_itself():
    """Members always find themselves; that must not hide the links that a beam misses."""
    rng = np.random.default_rng(14)
    x = vectors.unit(rng.normal(size=(3000, 64)))
    away = rng.normal(size=x.shape)
    away = vectors.unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    x = np.float32(rng.permutation(np.concatenate([x, 0.91 * x + np.sqrt(1 - 0.91**2) * away])))
    shard = asked(vectors.Shard(np.arange(6000), np.ones(6000, np.int64), x, 0.9, 1), 2000)
    u = vectors.unit(x)
    assert shard.links.sum() >= 0.98 * ((u @ u.T >= 0.9).sum() - 6000)


def test_upper_layers(monkeypatch):
    """With layers too large to be compared as a whole, beams go through all of them."""
    monkeypatch.setattr(vectors, "FLAT", 50)
    monkeypatch.setattr(vectors, "RATIO", 10)
    x = grouped(15, 5000, [], 1)
    graph = vectors.Graph(vectors.unit(x))
    assert len(graph.layers) == 4 and all((np.sort(a) == np.arange(len(a))).all() for a in graph.layers)
    ids, sims = graph.search(graph.x[:500], 20)
    assert np.mean(ids[:, 0] == np.arange(500)) > 0.97 and (np.diff(sims, axis=1) <= 0).all()
    near = graph.closest(graph.x[:500], 48, 1)[0]
    truth = np.argsort(-(graph.x[:500] @ graph.points[1].T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(near, truth)]) > 0.95


def test_best_columns():
    rng = np.random.default_rng(16)
    graph = vectors.Graph(np.ones((1, 1)))
    for k, width in [(1000, 5), (1003, 5), (100, 48), (48, 48), (30, 48), (1000, 1)]:
        sims = np.round(rng.normal(size=(40, k)), 1).astype(np.float32)  # many ties
        at, found = graph._best(sims, width)
        assert (found == -np.sort(-sims, axis=1)[:, :width]).all() and (found == np.take_along_axis(sims, at, 1)).all()
        assert all(len(set(row)) == min(k, width) for row in at)
