"""Near-duplicate vectors by hierarchical navigable graphs, one per shard.

Equal vectors are one class. Classes are spread over shards by key; a shard's task builds the graph of its
members and then answers queries as they stream by: every vector queries its own shard, and of any two shards
one sends its vectors to the other, so every pair is looked for once. All searches of a block step together
through the graph in numpy: a beam of the closest nodes of each layer, down to their members. The queries that
open the same node are compared with its members in one matrix product.

Beams widen until they hold all links. A search that finds links in the farther quarter of its beam goes on
with four times the beam. When the graph is built, and of every block, some queries are also compared with all
members of the shard; if the beams found less than ``RECALL`` of these links, or of those of the mean query,
the shard's beam is doubled. Where a beam would reach a quarter of the nodes the queries are compared with all
members instead, which is exact.

Found pairs are verified by cosine in double precision. A task reports sums, not pairs: the number of links
of each vector, and a spanning forest, one row per vector at most. Components of the forests are united by
the star contraction that the SimHash operator uses.

Vectors that are null, empty or zero or hold null or non-finite components link with nothing, and vectors of
different length never link. Repeated vectors link with each other. Unknown ids are never the smallest; a
component of unknown ids only has a null id and keeps all. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import pick
from hearthpanel.llm.simhash import components
from hearthpanel.operators.keyed import attach
from hearthpanel.workspace import materialize

COSINE = 0.9
# Shards: at least so many, and one more for each so many vectors a task can hold with their graph.
SHARDS, CAPACITY = 6, 1 << 20
# Members a node; layers of up to so many nodes are compared with as a whole.
RATIO, FLAT = 60, 1 << 14
BEAM, BUILD_BEAM = 48, 48
RECALL, AUDITED, FITTED = 0.99, 64, 1024
BLOCK = 8192
_MARGIN = 1e-4  # single precision of the search
_FLAGS = 4 << 20  # marks of opened cells at a time
_TILE = 4 << 20  # similarities at a time


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, safe for very large and small components."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


class Graph:
    """A navigable layered graph over unit vectors.

    Layer 0 has all members, every further layer one of ``RATIO`` members of the layer below, drawn. A node of
    a layer is linked with those members of the layer below that it is the closest node of, its cell: in
    ``layers[k]`` the members of layer k stand cell by cell, ``begins[k]`` tells where the cells begin.
    """

    def __init__(self, exact: np.ndarray, seed: int = 1) -> None:
        self.exact, self.x = exact, exact.astype(np.float32)
        drawn = np.random.default_rng(seed).permutation(len(exact))
        sizes = [len(exact)]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // RATIO))
        self.points = [self.x, *(self.x[drawn[:n]] for n in sizes[1:])]
        self.layers = [np.zeros(n, np.int64) for n in sizes[:-1]]
        self.begins = [np.array([0, n]) for n in sizes[:-1]]
        for layer in range(len(sizes) - 2, -1, -1):
            at = self.closest(self.points[layer], 1, layer + 1)[0][:, 0]
            self.layers[layer] = np.argsort(at, kind="stable")
            self.begins[layer] = np.searchsorted(at[self.layers[layer]], np.arange(sizes[layer + 1] + 1))

    def _best(self, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values of the highest of each row, best first."""
        if width == 1:
            at = sims.argmax(axis=1)[:, None]
            return at, np.take_along_axis(sims, at, 1)
        n, k = sims.shape
        if k >= 16 * width:  # folded on one another, ``width`` columns reach a bound, so at least as many do here
            fold = k // 8
            folded = sims[:, : 8 * fold].reshape(n, 8, fold).max(axis=1)
            row, col = np.nonzero(sims >= np.partition(folded, fold - width, axis=1)[:, fold - width, None])
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
            at = np.zeros((n, place.max(initial=0) + 1), np.int64)
            found = np.full(at.shape, -np.inf, np.float32)
            at[row, place] = col
            found[row, place] = sims[row, col]
        else:
            cut = max(0, k - width)
            at = np.argpartition(sims, cut, axis=1)[:, cut:]
            found = np.take_along_axis(sims, at, 1)
        order = np.argsort(-found, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(at, order, 1), np.take_along_axis(found, order, 1)

    def closest(self, q: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of a layer and similarities, best first; missing members are -1."""
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -np.inf, np.float32)
        points = self.points[layer]
        flat = layer == len(self.points) - 1 or (layer > 0 and len(points) <= FLAT)
        rows = max(1, _TILE // (len(points) if flat else max(width, BUILD_BEAM) * RATIO))
        for b in range(0, len(q), rows):
            some = q[b : b + rows]
            at, found = self._best(some @ points.T, width) if flat else self._below(some, width, layer)
            ids[b : b + rows, : at.shape[1]] = at
            sims[b : b + rows, : at.shape[1]] = found
        return ids, sims

    def _below(self, q: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The closest members in the cells of the closest nodes of the layer above."""
        up = self.closest(q, max(width, BUILD_BEAM), layer + 1)[0]
        sizes = np.where(up >= 0, np.diff(self.begins[layer])[up], 0)
        ends = np.cumsum(sizes, axis=1)
        ids = np.full((len(q), max(1, int(ends[:, -1].max(initial=0)))), -1, np.int64)
        sims = np.full(ids.shape, -np.inf, np.float32)
        for rows, slots, members in self.cells(up, layer):
            at = (ends - sizes)[rows, slots][:, None] + np.arange(len(members))
            ids[rows[:, None], at] = members
            sims[rows[:, None], at] = q[rows] @ self.points[layer][members].T
        at, found = self._best(sims, width)
        return np.take_along_axis(ids, at, 1), found

    def cells(self, nodes: np.ndarray, layer: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Cells of the layer that ``nodes`` open: the rows that open it, at which of their places, its members."""
        begins = self.begins[layer]
        narrow = nodes.ravel().astype(np.int16 if len(begins) < 1 << 15 else np.int32)
        order = np.argsort(narrow, kind="stable")
        bounds = np.searchsorted(narrow[order], np.arange(len(begins), dtype=narrow.dtype))
        for node in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(begins) > 0)).tolist():
            members = self.layers[layer][begins[node] : begins[node + 1]]
            opened = order[bounds[node] : bounds[node + 1]]
            step = max(1, _TILE // len(members))
            for b in range(0, len(opened), step):
                yield *np.divmod(opened[b : b + step], nodes.shape[1]), members

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self.closest(q, width, 0)


class Block:
    """Queries: unit vectors, and which member each is (-1: none)."""

    def __init__(self, exact: np.ndarray, own: np.ndarray) -> None:
        self.exact, self.own = exact, own

    @cached_property
    def q(self) -> np.ndarray:
        return self.exact.astype(np.float32)

    def some(self, n: int) -> Block:
        at = np.unique(np.linspace(0, len(self.own) - 1, min(n, len(self.own))).astype(np.int64))
        return Block(self.exact[at], self.own[at])


class Shard:
    """Members of one shard: their links so far, and the sets they are united in."""

    def __init__(self, keys: np.ndarray, copies: np.ndarray, vectors: np.ndarray, cosine: float, beam: int) -> None:
        self.keys, self.copies, self.cosine, self.beam = keys, copies, cosine, beam
        self.graph = Graph(unit(vectors))
        self.cells = len(self.graph.begins[0]) - 1 if self.graph.layers else 0
        self.links = np.zeros(len(keys), np.int64)
        self.parent = np.arange(len(keys))
        self.exhaustive = self._all(beam)
        self.audited = np.zeros(4)
        self._audit(Block(self.graph.exact, np.arange(len(keys))), FITTED)

    def _all(self, beam: int) -> bool:
        """Is so wide a beam a comparison with all members?"""
        return beam * 4 >= self.cells

    def _near(self, block: Block, rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Which of ``rows`` and ``members`` link, as a table; no member links with itself."""
        sims = block.q[rows] @ self.graph.x[members].T
        near = sims >= self.cosine - _MARGIN
        if near.any():
            near &= block.own[rows][:, None] != members
            unsure = np.flatnonzero(near & (sims < self.cosine + _MARGIN))
            for b in range(0, len(unsure), 1 << 15):
                at = unsure[b : b + (1 << 15)]
                row, col = np.divmod(at, len(members))
                two = block.exact[rows[row]], self.graph.exact[members[col]]
                near.ravel()[at] = np.einsum("ij,ij->i", *two) >= self.cosine
        return near

    def _scan(self, block: Block) -> Iterator[tuple[np.ndarray, ...]]:
        """Tables of all queries and all members."""
        for a in range(0, len(block.q), BLOCK // 8):
            rows = np.arange(a, min(a + BLOCK // 8, len(block.q)))
            step = _TILE // len(rows)
            for b in range(0, len(self.keys), step):
                members = np.arange(b, min(b + step, len(self.keys)))
                yield rows, members, self._near(block, rows, members)

    def _search(self, block: Block) -> Iterator[tuple[np.ndarray, ...]]:
        """Tables (queries, members, do they link) with something in them, every pair in one of them at most.

        A beam whose farther quarter of cells still has links is widened: the cells not opened yet follow.
        """
        if self.exhaustive:
            yield from (t for t in self._scan(block) if t[2].any())
            return
        step = max(1, _FLAGS // self.beam)
        for b in range(0, len(block.q), step):
            rows = np.arange(b, min(b + step, len(block.q)))
            nodes = self.graph.closest(block.q[rows], self.beam, 1)[0]
            wider = np.zeros(len(rows), bool)
            yield from self._open(block, rows, nodes, wider, self.beam - -(-self.beam // 4))
            left = np.flatnonzero(wider)
            few = max(1, _FLAGS // self.cells)
            for c in range(0, len(left), few):
                yield from self._widen(block, rows[left[c : c + few]], nodes[left[c : c + few]])

    def _open(
        self, block: Block, left: np.ndarray, nodes: np.ndarray, wider: np.ndarray, far: int
    ) -> Iterator[tuple[np.ndarray, ...]]:
        """Tables of the queries ``left`` with the cells of their nodes; ``wider`` marks links from place ``far`` on."""
        for rows, slots, members in self.graph.cells(nodes):
            near = self._near(block, left[rows], members)
            if near.any():
                wider[rows] |= (slots >= far) & near.any(axis=1)
                yield left[rows], members, near

    def _widen(self, block: Block, left: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        opened = np.zeros((len(left), self.cells), bool)
        beam = self.beam
        while len(left):
            row, col = np.nonzero(nodes >= 0)
            opened[row, nodes[row, col]] = True
            last, beam = beam, beam * 4
            if self._all(beam):
                nodes = np.broadcast_to(np.arange(self.cells), opened.shape)
            else:
                nodes = self.graph.closest(block.q[left], beam, 1)[0]
            fresh = (nodes >= 0) & ~np.take_along_axis(opened, np.maximum(nodes, 0), 1)
            wider = np.zeros(len(left), bool)
            yield from self._open(block, left, np.where(fresh, nodes, -1), wider, beam - (beam - last) // 4)
            if self._all(beam):
                break
            left, nodes, opened = left[wider], nodes[wider], opened[wider]

    def _count(self, tables: Iterator[tuple[np.ndarray, ...]], n: int) -> np.ndarray:
        counts = np.zeros(n, np.int64)
        for rows, _, near in tables:
            counts[rows] += near.sum(axis=1)
        return counts

    def _audit(self, block: Block, n: int) -> None:
        """Compare some queries with all members; double the beam until it finds enough of these links, and of
        those of the mean query, over all queries since the beam was last widened."""
        if self.exhaustive:
            return
        some = block.some(n)
        wanted = self._count(self._scan(some), len(some.q))
        any_ = wanted > 0
        while True:
            held = self._count(self._search(some), len(some.q))
            share = (held[any_] / wanted[any_]).sum()
            self.audited += wanted.sum(), held.sum(), any_.sum(), share
            want, have, asked, shares = self.audited
            if have >= RECALL * want and shares >= RECALL * asked:
                return
            self.beam *= 2
            self.audited[:] = 0
            self.exhaustive = self._all(self.beam)
            if self.exhaustive:
                return

    def _top(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = self.parent[up]

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite members pairwise: the larger root goes below the smaller until all pairs share one."""
        while len(a):
            a, b = self._top(a), self._top(b)
            differ = a != b
            low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
            np.minimum.at(self.parent, high, low)
            a, b = low, high

    def _meet(self, tables: Iterator[tuple[np.ndarray, ...]], one: np.ndarray, copies: np.ndarray | None) -> np.ndarray:
        """Links of each query. ``one`` is a member of each query's set, -1 if there is none yet; members linked
        with a query are united with it, and ``copies`` of the query, if given, are added to their links."""
        counts = np.zeros(len(one), np.int64)
        for rows, members, near in tables:
            some = near.any(axis=1)
            rows, near = rows[some], near[some]
            counts[rows] += near @ self.copies[members]
            if copies is not None:
                self.links[members] += copies[rows] @ near
            new = one[rows] < 0
            one[rows[new]] = members[near[new].argmax(axis=1)]
            row, col = np.nonzero(near & (self._top(one[rows])[:, None] != self._top(members)))
            self._unite(one[rows[row]], members[col])
        return counts

    def ask_members(self, begin: int, end: int) -> None:
        exact = self.graph.exact[begin:end]
        block = Block(exact, np.arange(begin, begin + len(exact)))
        self._audit(block, AUDITED)
        self.links[block.own] += self._meet(self._search(block), block.own.copy(), None)

    def ask(self, keys: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Columns u, v, links of a block of queries: each linked one with one member."""
        block = Block(unit(vectors), np.full(len(keys), -1))
        self._audit(block, AUDITED)
        one = np.full(len(keys), -1, np.int64)
        counts = self._meet(self._search(block), one, copies)
        linked = np.flatnonzero(one >= 0)
        return keys[linked], self.keys[one[linked]], counts[linked]

    def rest(self) -> tuple[np.ndarray, ...]:
        """The members' own links, and each with the root it is united with."""
        at = np.flatnonzero(self.links > 0)
        return self.keys[at], self.keys[self._top(at)], self.links[at]


def _linked(cosine: float, beam: int) -> Callable:
    """Links from rows sorted by shard, members (role 0) before queries."""

    def frame(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, shard = None, None
        held: list[tuple] = []  # members, or the queries of a block that is not full

        def joined() -> tuple[np.ndarray, ...]:
            out = tuple(np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            return out

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if shard is None and held:
                build()
            elif held:
                yield frame(shard.ask(*joined()))
            if shard is not None:
                yield frame(shard.rest())
            shard = None

        def build() -> None:
            nonlocal shard
            shard = Shard(*joined(), cosine, beam)
            for b in range(0, len(shard.keys), BLOCK):
                shard.ask_members(b, b + BLOCK)

        for batch in batches:
            place, role, keys, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(place):
                continue
            ends = np.flatnonzero((place[1:] != place[:-1]) | (role[1:] != role[:-1])) + 1
            for b, e in zip(np.r_[0, ends].tolist(), np.r_[ends, len(place)].tolist()):
                if place[b] != where:
                    yield from close()
                    where = place[b]
                elif role[b] == 1 and shard is None and held:
                    build()
                if role[b] == 1 and shard is None:
                    continue  # a shard without members
                some = batch.column(4).slice(b, e - b)
                vectors = some.flatten().to_numpy(zero_copy_only=False).reshape(e - b, -1)
                held.append((keys[b:e], copies[b:e], vectors))
                if role[b] == 1 and sum(len(h[0]) for h in held) >= BLOCK:
                    yield frame(shard.ask(*joined()))
        yield from close()

    return run


def classes(rows: DataFrame) -> DataFrame:
    """Distinct usable vectors of (vec_id, embedding): key, embedding, first (smallest id), copies."""
    able = F.size("embedding") > 0
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    usable = rows.filter(F.coalesce(able & finite & some, F.lit(False)))
    groups = usable.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return materialize(groups.withColumn("key", F.monotonically_increasing_id()), "vectors")


def links(found: DataFrame, cosine: float = COSINE, shards: int | None = None, beam: int = BEAM) -> DataFrame:
    """u, v, links: rows whose ``links`` add up to the linked vectors of u outside its class, and whose
    (u, v) connect all classes that are linked directly or indirectly."""
    s = shards or max(SHARDS, -(-found.count() // CAPACITY))
    # Of two shards one is asked: the one that comes up to half the circle later; of opposite ones the higher.
    shard = F.pmod(F.xxhash64("embedding"), F.lit(s))
    others = [F.pmod(shard + d, F.lit(s)) for d in range(1, (s - 1) // 2 + 1)]
    if s % 2 == 0:
        others.append(F.when(shard < s // 2, shard + s // 2))
    member = F.struct(shard.alias("shard"), F.lit(0).alias("role"))
    queries = [F.when(o.isNotNull(), F.struct(o.alias("shard"), F.lit(1).alias("role"))) for o in others]
    sent = found.select(F.explode(F.array_compact(F.array(member, *queries))).alias("to"), "key", "copies", "embedding")
    # Vectors of another length are another space.
    place = F.shiftleft(F.size("embedding").cast("long"), 32).bitwiseOR(F.col("to.shard")).alias("place")
    sent = sent.select(place, "to.role", "key", "copies", "embedding")
    # Four ranges a shard, so that two shards hardly ever meet in one.
    ordered = sent.repartitionByRange(4 * s, "place").sortWithinPartitions("place", "role", F.xxhash64("embedding"))
    out = ordered.mapInArrow(_linked(cosine, beam), "u bigint, v bigint, links bigint")
    return materialize(out, "links")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, shards: int | None = None, beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = pick(embeddings, "vec_id", "embedding")
    found = classes(rows)
    linked = links(found, cosine, shards, beam)
    counts = linked.groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(linked.select("u", "v")).withColumnRenamed("node", "key")
    own = found.select("key", "first", "copies").join(counts, "key", "left").join(roots, "key", "left")
    own = materialize(own.withColumn("root", F.coalesce("root", "key")), "rooted")
    firsts = own.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    best = attach(own, firsts, ["root"], "members")
    best = best.select("key", "component_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    by_vector = best.join(found.select("key", "embedding"), "key").drop("key")
    # Sorted by a number first: vectors are only compared where their hashes agree.
    mark = F.xxhash64("embedding")
    told = attach(rows.withColumn("mark", mark), by_vector.withColumn("mark", mark), ["mark", "embedding"], "copies")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return told.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
