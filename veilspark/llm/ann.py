"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard, searched by beams.

Vectors are dealt into shards of about one size by a hash of their id.  In a shard, greedy searches through the graph
as it stands propose neighbours for each vector; pruning keeps a neighbour only if no nearer one that was kept is, by
the factor alpha, nearer to it still, so that edges lead in diverse directions.  Every query searches every shard; the
cluster sets how many there are, so work grows with the vectors and, by the searches, with the logarithm of a shard.

A crowd of vectors that nearly agree would fill a beam and shut other ways.  It is one node: the nearest of a sample
of the shard leads it, and its members are looked at where the leader is met; a large crowd has a graph of its own,
of its members' differences from the leader.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, materialise


@dataclass(frozen=True)
class Settings:
    """shards: None for the cluster's cores.  least, most: vectors in a shard, if there are enough, and at most.
    degree: edges of a node.  build_beam, search_beam: candidates that a search keeps.  entries: nodes where searches
    begin, beside the middle one.  near: square of the distance, as a share of the leader's length squared, within which
    vectors join its crowd; crowd: members that make one; scanned: members that are compared one by one."""

    shards: int | None = None
    least: int = 5000
    most: int = 500_000
    degree: int = 32
    build_beam: int = 64
    search_beam: int = 160
    alpha: float = 1.2
    entries: int = 31
    batch: int = 256
    wide: int = 4
    near: float = 0.1
    crowd: int = 16
    scanned: int = 4096


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the `beam` nodes with the largest inner products that the search meets, best first.

    Returns (nodes, products); where fewer are met, nodes are -1.
    """
    n, b = len(x), len(q)
    rows = np.arange(b)[:, None]
    nodes = np.full((b, beam), -1, np.int64)
    value = np.full((b, beam), -np.inf, np.float32)
    entries = entries[:beam]
    nodes[:, : len(entries)], value[:, : len(entries)] = entries, q @ x[entries].T
    first = np.argsort(-value, axis=1, kind="stable")
    nodes, value = nodes[rows, first], value[rows, first]
    done = nodes < 0
    seen = np.zeros((b, n + 1), bool)  # the last column stands for "no node"
    seen[:, entries] = True
    seen[:, n] = True
    while not done.all():
        pick = np.argsort(done, axis=1, kind="stable")[:, :wide]
        open_ = ~done[rows, pick]
        done[rows, pick] = True
        near = np.where(open_[:, :, None], graph[np.where(open_, nodes[rows, pick], 0)], n).reshape(b, -1)
        near = np.where(seen[rows, near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[rows, near] = True
        fresh = np.where(near < n, np.einsum("bkd,bd->bk", x[np.minimum(near, n - 1)], q, optimize=True), -np.inf).astype(np.float32)
        nodes, value, done = np.concatenate([nodes, np.where(near < n, near, -1)], 1), np.concatenate([value, fresh], 1), np.concatenate([done, near >= n], 1)
        best = np.argpartition(-value, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(value, best, 1), axis=1, kind="stable"), 1)
        nodes, value, done = nodes[rows, best], value[rows, best], done[rows, best]
    return nodes, value


def robust_prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of the nodes `own` out of their candidates (-1: none): (nodes, degree), padded with len(x).

    All vectors have one length, so the square of a distance is twice (that length's square less the inner product).
    """
    n, rows = len(x), np.arange(len(own))
    candidates = np.sort(np.where(candidates < 0, n, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
    candidates[candidates == own[:, None]] = n
    there = x[np.minimum(candidates, n - 1)]
    length = (x[own[:1]] ** 2).sum()
    far = np.where(candidates < n, np.maximum(length - np.einsum("bkd,bd->bk", there, x[own], optimize=True), 0), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far, there = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(there, order[:, :, None], 1)
    alive = candidates < n
    out = np.full((len(own), degree), n, np.int64)
    for k in range(degree):
        if not alive.any():
            break
        first = alive.argmax(1)
        some = alive[rows, first]
        out[some, k] = candidates[rows, first][some]
        between = np.maximum(length - np.einsum("bkd,bd->bk", there, there[rows, first], optimize=True), 0)
        alive &= ~(some[:, None] & (alpha * alpha * between <= far))
        alive[rows, first] = False
    return out


class Graph:
    """The graph of one shard.  Equal vectors are one row with several ids; a node is a row, or a crowd's leader."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, s: Settings):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.s = s
        self.vectors, first, row = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        by_row = np.argsort(row.ravel(), kind="stable")
        self.ids = np.split(ids[by_row], np.cumsum(np.bincount(row.ravel(), minlength=len(first)))[:-1])
        x = self.vectors.astype(np.float64)
        top = np.abs(x).max() or 1.0
        x /= top  # so that squares stay within the range of the search's numbers
        self.crowds: dict[int, tuple[np.ndarray, Graph | None]] = {}  # by node
        self.rows = self._crowds(x)
        x = x[self.rows]
        squares = (x**2).sum(1)
        # one more component gives all vectors one length; queries have 0 there, so their inner products stay
        self.x = np.concatenate([x, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], 1).astype(np.float32)
        middle = int((self.x @ self.x.mean(0)).argmax())
        others = np.random.default_rng(7).permutation(len(self.x))[: s.entries]
        self.entries = np.array([middle, *others[others != middle]])
        self.graph = self._build()

    def _crowds(self, x: np.ndarray) -> np.ndarray:
        """The rows that are nodes; fills self.crowds."""
        n, s = len(x), self.s
        lead = np.full(n, -1)
        if n > s.scanned // 4:
            # a crowd that could fill half a beam has a member in the sample, all but surely
            sample = np.sort(np.random.default_rng(11).permutation(n)[: max(1024, 16 * n // s.search_beam)])
            y, squares = x[sample].astype(np.float32), (x[sample] ** 2).sum(1)
            for a in range(0, n, 4096):
                part = x[a : a + 4096]
                far = (part**2).sum(1)[:, None] + squares - 2 * (part.astype(np.float32) @ y.T)
                fits = far <= s.near * squares
                lead[a : a + 4096] = np.where(fits.any(1), sample[fits.argmax(1)], -1)
        leaders, count = np.unique(lead[lead >= 0], return_counts=True)
        leaders = set(leaders[count >= s.crowd].tolist())
        members: dict[int, list[int]] = {}
        for i in np.flatnonzero(lead >= 0).tolist():
            if lead[i] in leaders:
                members.setdefault(int(lead[i]), []).append(i)
        inside = np.zeros(n, bool)
        for own in members.values():
            inside[own] = True
        inside[list(members)] = False  # leaders are nodes, whatever crowd they fell to themselves
        rows = np.flatnonzero(~inside)
        node = dict(zip(rows.tolist(), range(len(rows))))
        for leader, own in members.items():
            own_rows = np.array([i for i in own if inside[i]], np.int64)
            within = self.vectors[own_rows].astype(np.float64) - self.vectors[leader].astype(np.float64)
            self.crowds[node[leader]] = own_rows, Graph(np.arange(len(own_rows)), within, s) if len(own_rows) > s.scanned else None
        return rows

    def _build(self) -> np.ndarray:
        n, s, x = len(self.x), self.s, self.x
        rng = np.random.default_rng(n)
        degree = min(s.degree, max(n - 1, 1))
        graph = np.full((n, s.degree), n, np.int64)
        graph[:, : min(degree, 8)] = rng.integers(0, n, (n, min(degree, 8)))  # something to walk on at first
        turn = rng.permutation(n)
        for a in range(0, n, s.batch):
            own = turn[a : a + s.batch]
            found, _ = beam_search(x, graph, self.entries, x[own], min(s.build_beam, n), s.wide)
            graph[own] = robust_prune(x, own, np.concatenate([found, np.where(graph[own] < n, graph[own], -1)], 1), s.degree, s.alpha)
            # edges back, of which a node that has too many keeps the diverse ones
            to, back = graph[own].ravel(), np.repeat(own, s.degree)
            back, to = back[to < n], to[to < n]
            order = np.argsort(to, kind="stable")
            to, back = to[order], back[order]
            nodes, start, count = np.unique(to, return_index=True, return_counts=True)
            for b in range(0, len(nodes), s.batch):
                some = nodes[b : b + s.batch]
                wide = int(count[b : b + s.batch].max())
                at = start[b : b + s.batch, None] + np.arange(wide)
                incoming = np.where(np.arange(wide) < count[b : b + s.batch, None], back[np.minimum(at, len(back) - 1)], -1)
                both = np.concatenate([np.where(graph[some] < n, graph[some], -1), incoming], 1)
                graph[some] = robust_prune(x, some, both, s.degree, s.alpha)
        return self._reachable(graph)

    def _reachable(self, graph: np.ndarray) -> np.ndarray:
        """The graph with edges more, so that every node is reached from the entries."""
        n = len(self.x)
        reached = np.zeros(n, bool)
        front = self.entries
        extra: dict[int, list[int]] = {}
        while True:
            while len(front):
                reached[front] = True
                front = np.unique(graph[front])
                front = front[front < n]
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            found, _ = beam_search(self.x, graph, self.entries, self.x[lost[:1]], min(self.s.build_beam, n), self.s.wide)
            near = next(v for v in found[0].tolist() if v >= 0 and reached[v])
            extra.setdefault(near, []).append(int(lost[0]))
            front = lost[:1]
        if extra:
            wide = np.full((n, max(map(len, extra.values()))), n, np.int64)
            for v, to in extra.items():
                wide[v, : len(to)] = to
            graph = np.concatenate([graph, wide], 1)
        return graph

    def candidates(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows that a search meets: its beam's, and the members of the crowds in it."""
        s = self.s
        scaled = q / np.maximum(np.abs(q).max(1, keepdims=True), 1e-300)
        padded = np.concatenate([scaled, np.zeros((len(q), 1))], 1).astype(np.float32)
        nodes, _ = beam_search(self.x, self.graph, self.entries, padded, min(max(s.search_beam, 2 * k), len(self.x)), s.wide)
        out = []
        for i, found in enumerate(nodes):
            found = found[found >= 0]
            rows = [self.rows[found]]
            for c in found.tolist() if self.crowds else ():
                if c in self.crowds:
                    own, graph = self.crowds[c]
                    rows.append(own if graph is None else np.unique(np.concatenate([own[graph.ids[r]] for r in graph.candidates(q[i : i + 1], k)[0]])))
            out.append(np.concatenate(rows))
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
        """(query, id, score) of the k nearest found for each query, itself left out; scores in double precision."""
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        for a in range(0, len(queries), self.s.batch):
            q = queries[a : a + self.s.batch].astype(np.float64)
            for i, rows in enumerate(self.candidates(q, k)):
                own = int(query_ids[a + i])
                exact = (self.vectors[rows].astype(np.float64) * q[i]).sum(1)
                best: list[tuple[float, int]] = []
                last = np.inf
                for r in np.argsort(-exact, kind="stable").tolist():
                    if len(best) >= k and exact[r] < last:
                        break  # all rows of the last score are in, so that the smallest ids among them are
                    last = exact[r]
                    # of equal vectors the k + 1 smallest ids are as many as can be among the k nearest
                    best += [(-last, v) for v in self.ids[rows[r]][: k + 1].tolist() if v != own]
                for score, v in sorted(best)[:k]:
                    out[0].append(own)
                    out[1].append(v)
                    out[2].append(-score)
        return out


def _shards(k: int, s: Settings):
    """Rows sorted by (shard, kind): a shard's vectors (kind 0) are gathered, its queries (kind 1) streamed through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, graph = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, kinds, found = batch.column("shard").to_numpy(), batch.column("kind").to_numpy(), batch.column("id").to_numpy()
            lists = batch.column("vector")
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                rows = flat[offsets[a] : offsets[b]].reshape(b - a, -1)
                if keys[a] != shard:
                    shard, ids, vectors, graph = keys[a], [], [], None
                if kinds[a] == 0:
                    ids.append(found[a:b])
                    vectors.append(rows)
                    continue
                if not ids:
                    continue
                graph = graph or Graph(np.concatenate(ids), np.concatenate(vectors), s)
                q, v, score = graph.search(found[a:b], rows, k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): of each query its k nearest found by inner product, itself left out.

    is_query: a condition on df.  Ties go to the smaller id; with fewer candidates, all of them.  Vectors that are
    null, empty, all zero or hold a null or non-finite component take no part, nor do rows with a null id; vectors of
    different dimensions never meet.  Rows that repeat an id are candidates each, but not for queries of that id; of the
    vectors of a query's repeated id the smallest asks.  Floats are searched as they are, other numbers as doubles.
    Scores beyond the range of doubles are infinite.  An empty table gives an empty table.
    """
    s = settings or Settings()
    kind = "float" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    vector = col(vector_col).cast(f"array<{kind}>")
    fit = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = materialise(df.where(F.coalesce(fit, F.lit(False)) & col(id_col).isNotNull()).select(col(id_col).cast("long").alias("id"), vector.alias("vector"), F.size(vector).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("query")))
    cores = s.shards or df.sparkSession.sparkContext.defaultParallelism
    dims = {r[0]: max(min(-(-r[1] // s.least), cores), -(-r[1] // s.most)) for r in rows.groupBy("dim").count().collect()}
    if not dims:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    # shards are numbered through: those of each dimension follow one another
    pieces, first, at = F.lit(1), F.lit(0), 0
    for dim, n in sorted(dims.items()):
        pieces, first = F.when(F.col("dim") == dim, F.lit(n)).otherwise(pieces), F.when(F.col("dim") == dim, F.lit(at)).otherwise(first)
        at += n
    own = rows.select((first + F.pmod(F.xxhash64("id"), pieces)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "vector")
    asking = rows.where("query").groupBy("id").agg(F.min(F.struct("vector", "dim")).alias("q")).select("id", "q.vector", "q.dim")
    asked = asking.select(F.explode(F.sequence(first, first + pieces - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "vector")
    dealt = own.unionByName(asked).repartitionById(at, F.col("shard")).sortWithinPartitions("shard", "kind", "id")
    found = dealt.mapInArrow(_shards(k, s), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
