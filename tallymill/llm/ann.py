"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, merged results.

To search for the largest inner product, vectors get one more component that makes them equally long, queries a zero there.
Centroids, fitted on a bounded sample of the distinct vectors, part a dimension into cells, and cells of more than SHARD_ROWS
vectors are dealt on by hash, so every shard is of bounded size. A shard's graph is built in one task and stored as flat
neighbour arrays in one row of the index table, which is written out; every row of the input is indexed, equal vectors as one
node that carries the smallest ids that any query could need. Equal queries are searched once, in the cells nearest to them
alone: as many as hold ROUTED of the true neighbours within the sample, whose neighbours lie further apart than those in the
whole table. When a shard is built, a few vectors of its own and a few of the sample, which may lie outside, are searched exactly
too, and the beam is widened until the graph finds FOUND of their neighbours; the width is stored with the shard. A shard's
candidates are scored in double precision on the original vectors, and the best of all shards are kept, ties to the smaller id.

Vectors that are null, zero, empty, or hold null or non-finite components take no part, as rows and as queries, nor do rows
without an id. Ids become longs. Queries see vectors of their own dimension. Repeated rows count as one neighbour; an id with
several vectors is a candidate with each, and searched by the least, past all of its own. Vectors may be of any length. An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import first_hashes, look_up, map_parts, settle

LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 64, 64
SHARD_ROWS, BLOCK_QUERIES = 20_000, 4000
#: Cells of a dimension, at least (if it has FEW vectors or more), and of all dimensions together, at most.
LEAST_CELLS, MOST_CELLS, FEW = 6, 4096, 600
#: Centroids are fitted on about twice so many vectors, of no more than so many bytes; the cells that a query visits are to hold
#: this share of its neighbours.
SAMPLE, SAMPLE_BYTES, ROUTED = 10_000, 32 << 20, 0.98
#: Share of the neighbours of PROBES vectors that a shard's graph must find.
FOUND, PROBES = 0.97, 24
#: Sampled vectors compared with all others at once.
AT_ONCE = 64


class Graph:
    """HNSW over unit vectors. Level 0 is one flat array of 2 * LINKS neighbours a node; upper levels list their nodes."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS):
        self.vectors, self.links = vectors, links
        n = len(vectors)
        self.near = [np.full((n, 2 * links), -1, np.int32)]
        self.used = [np.zeros(n, np.int32)]
        self.stamp, self.now, self.entry = np.zeros(n, np.int64), 0, 0

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 5) -> Graph:
        g = cls(vectors, links)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(rng.random(len(vectors)) + 1e-12) / np.log(links)).astype(int), 8)
        for _ in range(levels.max(initial=0)):
            g.near.append(np.full((len(vectors), links), -1, np.int32))
            g.used.append(np.zeros(len(vectors), np.int32))
        top = -1
        for i, level in enumerate(levels.tolist()):
            if top < 0:
                top, g.entry = level, i
                continue
            q, at = vectors[i], [g.entry]
            for k in range(top, level, -1):
                at = [g.search(q, at, 1, k)[0][1]]
            for k in range(min(top, level), -1, -1):
                found = g.search(q, at, width, k)
                at = [j for _, j in found]
                for j in g.chosen([j for _, j in found], [s for s, _ in found], links):
                    g.connect(i, j, k)
                    g.connect(j, i, k)
            if level > top:
                top, g.entry = level, i
        return g

    def chosen(self, nodes: list[int], sims: list[float], most: int) -> list[int]:
        """Nearest first, each nearer to the node than to any chosen before; then the rest fills up."""
        between = self.vectors[nodes] @ self.vectors[nodes].T
        picked, closest = [], np.full(len(nodes), -2.0, np.float32)
        for k in range(len(nodes)):
            if sims[k] > closest[k]:
                picked.append(k)
                if len(picked) == most:
                    break
                np.maximum(closest, between[k], out=closest)
        if len(picked) < most:
            taken = set(picked)
            picked += [k for k in range(len(nodes)) if k not in taken][: most - len(picked)]
        return [nodes[k] for k in picked]

    def connect(self, a: int, b: int, level: int) -> None:
        near, used = self.near[level], self.used[level]
        if used[a] < near.shape[1]:
            near[a, used[a]] = b
            used[a] += 1
            return
        nodes = np.append(near[a], b)
        sims = self.vectors[nodes] @ self.vectors[a]
        order = np.argsort(-sims, kind="stable")
        kept = self.chosen(nodes[order].tolist(), sims[order].tolist(), near.shape[1] - 2)
        near[a] = -1
        near[a, : len(kept)] = kept
        used[a] = len(kept)

    def search(self, q: np.ndarray, entries: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """(similarity, node), nearest first, of at most ``width`` nodes."""
        near, used, vectors, stamp = self.near[level], self.used[level], self.vectors, self.stamp
        self.now += 1
        stamp[entries] = self.now
        best = [(s, j) for s, j in zip((vectors[entries] @ q).tolist(), entries)]
        todo = [(-s, j) for s, j in best]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            s, j = heapq.heappop(todo)
            if len(best) == width and -s < best[0][0]:
                break
            more = near[j, : used[j]]
            more = more[stamp[more] != self.now]
            if not len(more):
                continue
            stamp[more] = self.now
            for t, k in zip((vectors[more] @ q).tolist(), more.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (t, k))
                    heapq.heappush(todo, (-t, k))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, k))
                    heapq.heappush(todo, (-t, k))
        return sorted(best, reverse=True)

    def nearest(self, q: np.ndarray, width: int) -> list[int]:
        at = [self.entry]
        for k in range(len(self.near) - 1, 0, -1):
            at = [self.search(q, at, 1, k)[0][1]]
        return [j for _, j in self.search(q, at, width, 0)]

    def flat(self) -> tuple[bytes, bytes, bytes, int]:
        """Level 0; nodes of each upper level with their number, and their neighbours; entry."""
        nodes, lists = [np.array([len(self.near) - 1], np.int32)], []
        for near, used in zip(self.near[1:], self.used[1:]):
            there = np.flatnonzero(used).astype(np.int32)
            nodes += [np.array([len(there)], np.int32), there]
            lists.append(near[there].ravel())
        return self.near[0].tobytes(), np.concatenate(nodes).tobytes(), np.concatenate([np.zeros(0, np.int32), *lists]).tobytes(), self.entry

    @classmethod
    def load(cls, vectors: np.ndarray, level0: bytes, nodes: bytes, lists: bytes, entry: int, links: int = LINKS) -> Graph:
        g = cls(vectors, links)
        n = len(vectors)
        g.near[0] = np.frombuffer(level0, np.int32).reshape(n, 2 * links)
        g.used[0] = (g.near[0] >= 0).sum(axis=1).astype(np.int32)
        named, all_lists, at, done = np.frombuffer(nodes, np.int32), np.frombuffer(lists, np.int32).reshape(-1, links), 1, 0
        for _ in range(int(named[0])):
            there = named[at + 1 : at + 1 + named[at]]
            near, at = np.full((n, links), -1, np.int32), at + 1 + len(there)
            near[there] = all_lists[done : done + len(there)]
            done += len(there)
            g.near.append(near)
            g.used.append((near >= 0).sum(axis=1).astype(np.int32))
        g.entry = entry
        return g


def calibrated(graph: Graph, vectors: np.ndarray, probes: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> int:
    """The width at which a search finds FOUND of the k nearest of the probes; the whole graph at the most."""
    k = min(k, len(vectors))
    exact = [set(np.argpartition(-(vectors @ p), k - 1)[:k].tolist()) for p in probes]
    units = directions(probes)
    while width < len(vectors):
        held = sum(len(set(sorted(graph.nearest(u, width), key=lambda j: -float(vectors[j] @ p))[:k]) & e) for u, p, e in zip(units, probes, exact))
        if held >= FOUND * k * len(probes):
            break
        width *= 2
    return min(width, max(len(vectors), k))


def equal_length(x: np.ndarray, most: float | None = None) -> np.ndarray:
    """Unit vectors whose inner products with (q, 0) order as those of x with q; ``most`` is the largest squared length."""
    norms = (x**2).sum(axis=1)
    most = most or norms.max(initial=0) or 1.0
    return np.concatenate((x, np.sqrt(np.maximum(most - norms, 0))[:, None]), axis=1).astype(np.float32) / np.float32(np.sqrt(most))


def directions(x: np.ndarray) -> np.ndarray:
    """Queries as they meet vectors of equal length."""
    return np.concatenate((x / np.sqrt((x**2).sum(axis=1))[:, None], np.zeros((len(x), 1))), axis=1).astype(np.float32)


def stacked(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


class Cells:
    """Centroids of one dimension, and how many cells a query visits."""

    def __init__(self, centroids: np.ndarray, most: float, visited: int, probes: np.ndarray):
        self.centroids, self.most, self.visited, self.probes = centroids, most, visited, probes

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, most: float, k: int, rounds: int = 8) -> Cells:
        unit = equal_length(x, most)
        made = cls(unit[:cells].copy(), most, cells, x[:PROBES].copy())
        for _ in range(rounds):
            at = made.of(unit)
            sums, counts = np.zeros_like(made.centroids), np.bincount(at, minlength=cells)
            np.add.at(sums, at, unit)
            made.centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        at, ranks, k = made.of(unit), [], min(k, len(x) - 1)
        for lo in range(0, min(512, len(x)), AT_ONCE):
            asked = x[lo : min(lo + AT_ONCE, 512)]
            scores = asked @ x.T
            scores[np.arange(len(asked)), lo + np.arange(len(asked))] = -np.inf
            near = np.argpartition(scores, len(x) - k, axis=1)[:, len(x) - k :]
            order = np.argsort(np.argsort(-(directions(asked) @ made.centroids.T), axis=1, kind="stable"), axis=1)
            ranks.append(np.take_along_axis(order, at[near], axis=1).ravel())
        taken = np.sort(np.concatenate(ranks))
        made.visited = int(taken[min(len(taken) - 1, int(np.ceil(ROUTED * len(taken))))]) + 1
        return made

    def of(self, unit: np.ndarray) -> np.ndarray:
        half = (self.centroids**2).sum(axis=1) / 2
        return np.concatenate([np.zeros(0, int), *((unit[at : at + 1024] @ self.centroids.T - half).argmax(axis=1) for at in range(0, len(unit), 1024))])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(directions(x) @ self.centroids.T), axis=1, kind="stable")[:, : self.visited]


def prepared(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, vector, norm): usable vectors as little-endian doubles, and their squared lengths."""

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for v in b.column(1).to_pylist():
                x = None if not v or None in v else np.array(v, "<f8")
                made.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
            dims = pa.array([None if x is None else len(x) for x in made], pa.int32())
            norms = pa.array([None if x is None else float(x @ x) for x in made], pa.float64())
            return pa.record_batch([b.column(0), dims, pa.array([None if x is None else x.tobytes() for x in made], pa.binary()), norms], ["id", "dim", "vector", "norm"])

        return part

    rows = map_parts(table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), make, "id long, dim int, vector binary, norm double", 2048)
    return rows.where("vector is not null and id is not null")


def fit_cells(nodes: DataFrame, k: int) -> dict[int, Cells]:
    """The cells of each dimension that has more than one. What reaches the driver is bounded: there are at most MOST_CELLS cells,
    and so dimensions with cells, and the sample is cut by a hash."""
    total, widest = nodes.agg(F.count("*"), F.max("dim")).first()
    if not total:
        return {}
    n = F.col("n")
    wanted = F.least(F.greatest(F.ceil(n / SHARD_ROWS), F.lit(LEAST_CELLS)), F.floor(n * MOST_CELLS / total)).cast("int")
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most")).withColumn("cells", wanted)
    large = {r["dim"]: r for r in sizes.where((n >= FEW) & (F.col("cells") > 1)).collect()}
    if not large:
        return {}
    sample = first_hashes(nodes.withColumn("h", F.xxhash64("vector", F.lit("sample"))), "h", min(SAMPLE, SAMPLE_BYTES // (8 * widest)), total)
    drawn: dict[int, list] = {}
    for r in sample.where(F.col("dim").isin(list(large))).select("dim", "h", "vector").collect():
        drawn.setdefault(r["dim"], []).append((r["h"], bytes(r["vector"])))
    fitted = {}
    for dim, rows in drawn.items():
        cells = min(int(large[dim]["cells"]), len(rows) // 4)
        if cells > 1:
            fitted[dim] = Cells.fit(stacked([v for _, v in sorted(rows)]), cells, float(large[dim]["most"]), k)
    return fitted


def by_dimension(b: pa.RecordBatch):
    """(dimension, positions, vectors) of a batch."""
    dims, vectors = np.asarray(b.column("dim")), b.column("vector").to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, stacked([vectors[i] for i in at])


def placed(nodes: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(place, dim, vector, ids): place names dimension and cell."""

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            places = np.empty(b.num_rows, object)
            for dim, at, x in by_dimension(b):
                c = cells.get(dim)
                places[at] = [f"{dim}/{i}" for i in (c.of(equal_length(x, c.most)) if c else np.zeros(len(at), int)).tolist()]
            return pa.record_batch([pa.array(places.tolist(), pa.string()), *b.columns], ["place", "dim", "vector", "ids"])

        return part

    return map_parts(nodes.select("dim", "vector", "ids"), make, "place string, dim int, vector binary, ids array<long>", 2048)


def routed(queries: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(query, several, vector, place): a row for each cell that a query visits."""

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            rows, places = [], []
            for dim, at, x in by_dimension(b):
                visits = cells[dim].nearest(x) if dim in cells else np.zeros((len(at), 1), int)
                rows.append(np.repeat(at, visits.shape[1]))
                places += [f"{dim}/{i}" for i in visits.ravel().tolist()]
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64))
            return pa.record_batch([*(b.column(c).take(at) for c in ("query", "several", "vector")), pa.array(places, pa.string())], ["query", "several", "vector", "place"])

        return part

    return map_parts(queries.select("query", F.col("not_id").isNotNull().alias("several"), "dim", "vector"), make, "query long, several boolean, vector binary, place string", 512)


def index(nodes: DataFrame, cells: dict[int, Cells], k: int) -> DataFrame:
    """One row a shard: its vectors, the flat graph, the width of a search, and the ids of each node."""
    outside = {dim: c.probes for dim, c in cells.items()}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(least=[x[0] for x in pdf["ids"]]).sort_values("least", kind="stable")
        vectors = stacked(list(pdf["vector"]))
        graph = Graph.build(equal_length(vectors))
        level0, upper, lists, entry = graph.flat()
        probes = [vectors[:: max(1, len(vectors) // PROBES)][:PROBES], *[p for p in [outside.get(vectors.shape[1])] if p is not None]]
        width = calibrated(graph, vectors, np.concatenate(probes), k)
        ids = [np.asarray(x, np.int64) for x in pdf["ids"]]
        sizes = np.array([len(x) for x in ids], np.int32).tobytes()
        return pd.DataFrame({"place": [key[0]], "sub": [key[1]], "vectors": [vectors.tobytes()], "level0": [level0], "upper": [upper], "lists": [lists], "entry": [entry], "width": [width], "ids": [np.concatenate(ids).tobytes()], "sizes": [sizes]})

    dealt = nodes.withColumn("sub", F.pmod(F.xxhash64("vector"), "subs").cast("int")).select("place", "sub", "vector", "ids").repartition("place", "sub")
    return dealt.groupBy("place", "sub").applyInPandas(one, "place string, sub int, vectors binary, level0 binary, upper binary, lists binary, entry int, width int, ids binary, sizes binary")


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, id, score: the k nearest rows of each query row, itself left out. ``is_query`` sees the column ``id``."""
    rows = settle(prepared(table, id_col, vector_col))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = settle(numbered.groupBy("dim", "vector").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.max("norm").alias("norm")))
    cells = fit_cells(nodes, k)
    there = placed(nodes, cells)

    # equal queries are one, named by the least id; an id with several vectors is a query of its own that passes all of them
    asking = rows.where(is_query).groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("v"), F.max(F.struct("dim", "vector")).alias("w"))
    members = settle(asking.select("id", "v.dim", "v.vector", F.when(F.col("v") != F.col("w"), F.col("id")).alias("not_id")))
    queries = settle(members.groupBy("dim", "vector", "not_id").agg(F.min("id").alias("query")))
    visits = routed(queries, cells)

    # one row a cell: its shards, and the blocks in which queries come to it
    shards = there.groupBy("place").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("subs"))
    blocks = visits.groupBy("place").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    places = settle(shards.join(blocks, "place", "left"))

    built = settle(index(look_up(there, "place", "vector", places), cells, k))
    asked = look_up(visits, "place", "query", places).where("subs is not null").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int"))
    asked = asked.select("query", "several", "vector", "place", "block", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    held = built.join(places.where("blocks is not null").select("place", "blocks"), "place").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def one(key: tuple, shard: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(shard) and len(qs):
            s = shard.iloc[0]
            vectors = np.frombuffer(s["vectors"], "<f8").reshape(-1, int(key[0].split("/")[0]))
            graph = Graph.load(equal_length(vectors), s["level0"], s["upper"], s["lists"], int(s["entry"]))
            sizes = np.frombuffer(s["sizes"], np.int32)
            ends = np.cumsum(sizes)
            ids = np.frombuffer(s["ids"], np.int64)
            x = stacked(list(qs["vector"]))
            for q, several, v, unit in zip(qs["query"], qs["several"], x, directions(x)):
                wide = max(width, int(s["width"]), k + 1)
                while True:
                    at = graph.nearest(unit, wide)
                    scores = vectors[at] @ v
                    found = sorted((-sc, int(i)) for sc, node in zip(scores.tolist(), at) for i in ids[ends[node] - sizes[node] : ends[node]] if not several or i != q)
                    if not several or len(found) >= k or wide >= len(vectors):
                        break
                    wide *= 2
                out += [(int(q), i, -sc) for sc, i in found[: k + 1]]
        return pd.DataFrame(out, columns=["query", "id", "score"]).astype({"query": "int64", "id": "int64", "score": "float64"})

    by = ["place", "sub", "block"]
    found = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(one, "query long, id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k + 1)
    near = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    single, several = F.col("not_id").isNull(), F.col("not_id").isNotNull()
    told = look_up(members.where(single).select("id", "vector"), "vector", "id", queries.where(single).join(near, "query").select("vector", "near"))
    told = told.unionByName(members.where(several).select("id", "vector").join(near.withColumnRenamed("query", "id"), "id", "left"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return told.select(F.col("id").alias("query_id"), F.posexplode(others)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias(id_col), F.col("col.score").alias("score"))
