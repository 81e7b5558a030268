"""Near-duplicate embeddings: links of cosine 0.93 or more within a label, found in robust-pruned flat graphs.

Equal vectors are one class. Dense groups of classes become balls first: a ball's members lie within half the linking angle of
its centre, so they are all linked and are counted, never paired; balls that lie together become one, round by round. A graph
has one node for each ball and each class outside balls.

Centroids, fitted on a bounded sample, part a large label into cells; a node goes to the nearest few, so cells overlap, and a
cell is dealt in shards of bounded size. Every shard builds a flat graph in one task: nodes are inserted in growing batches, each
takes the robustly pruned neighbours of a beam search, and gives edges back. A node's lists from all its shards are united. Then every
node searches its cells' shards over the united lists, from the shard's medoids and its own neighbours: a beam, then outwards
from all that is within reach until nothing new is. What it meets is verified in double precision. Balls are
linked as a whole if their angle and radii leave no doubt, not at all if they leave none, and member by member else, in tiles.

A bounded sample of nodes is held against all nodes of their labels: if less than AUDITED of their links were found, all is
searched again with wider beams and more overlap, and ``audit`` tells the share.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without a label; vectors of
other lengths do not meet. Every row is returned: repeated ids are rows of their own, and both are kept if theirs is the least; a
null id is never the name of a component with other ids. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import connected_components
from .tables import first_hashes, look_up, map_parts, settle

LINKED = 0.93
#: Nodes of a shard; edges that a node takes and may have; nodes inserted or searched side by side.
SHARD_ROWS, EDGES, MOST_EDGES, SIDE_BY_SIDE = 2048, 16, 24, 512
#: How much longer a way round must be for an edge to stay, squared.
ALPHA = 1.2**2
#: Points from which a shard is searched.
MEDOIDS = 16
#: (cells of a node, width of a beam), in the order in which they are tried.
EFFORTS = ((2, 32), (4, 64), (8, 128))
#: How many times as many cells a ball goes to.
BALL_COPIES = 4
#: Share of an audit's links that must be found, and nodes audited.
AUDITED, AUDIT_NODES = 0.98, 512
#: Classes that make a ball; points around which balls are looked for at a time.
LEAST_BALL, PIVOTS = 8, 64
#: Cells at most, and vectors on which about twice so many centroids are fitted.
MOST_CELLS, SAMPLE, SAMPLE_BYTES = 4096, 10_000, 32 << 20
#: Classes of a tile of members.
TILE = 2048
#: Angles closer than this are not told apart by triangles.
CLOSE = 1e-7


def floats(vectors: list[bytes], dim: int) -> np.ndarray:
    """Vectors of singles or doubles as doubles of length one, without overflow on the way."""
    x = np.empty((len(vectors), dim))
    for i, v in enumerate(vectors):
        x[i] = np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8")
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=1e-300))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Flat:
    """A flat graph over unit vectors: a list of neighbours a node, filled up with -1."""

    def __init__(self, x: np.ndarray, near: np.ndarray, medoids: np.ndarray):
        self.x, self.near, self.medoids = x.astype(np.float32), near, medoids

    @classmethod
    def build(cls, x: np.ndarray, width: int, seed: int = 7) -> Flat:
        n, rng = len(x), np.random.default_rng(seed)
        g = cls(x, np.full((n, MOST_EDGES), -1, np.int32), medoids(x, rng))
        m = g.medoids
        g.near[m, : len(m) - 1] = [[b for b in m if b != a] for a in m]
        order = np.concatenate((m, np.setdiff1d(rng.permutation(n), m, assume_unique=True)))
        rng.shuffle(order[len(m) :])
        at = len(m)
        while at < n:
            step = min(at, SIDE_BY_SIDE)
            g.insert(order[at : at + step], width)
            at += step
        for at in range(0, n, SIDE_BY_SIDE):  # now everybody can meet
            g.insert(order[at : at + SIDE_BY_SIDE], width)
        return g

    def insert(self, nodes: np.ndarray, width: int) -> None:
        found, _, _ = self.beam(self.x[nodes], np.broadcast_to(self.medoids, (len(nodes), len(self.medoids))), width)
        out = self.pruned(nodes, np.concatenate((found, self.near[nodes]), axis=1))
        self.near[nodes] = -1
        self.near[nodes, : out.shape[1]] = out
        to, back = out.ravel(), np.repeat(nodes, out.shape[1])
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        targets, starts, counts = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(targets), SIDE_BY_SIDE):
            t, s, c = (a[lo : lo + SIDE_BY_SIDE] for a in (targets, starts, counts))
            given = np.full((len(t), int(c.max())), -1, np.int32)
            row = np.repeat(np.arange(len(t)), c)
            col = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            given[row, col] = back[np.repeat(s, c) + col]
            both = self.sorted(t, np.concatenate((self.near[t], given), axis=1))[0]
            full = (both >= 0).sum(axis=1) > MOST_EDGES
            self.near[t[~full]] = both[~full, :MOST_EDGES]
            if full.any():
                cut = self.pruned(t[full], both[full])
                self.near[t[full]] = -1
                self.near[t[full], : cut.shape[1]] = cut

    def sorted(self, nodes: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's candidates once, without itself, nearest first, and their similarities."""
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[found == nodes[:, None]] = -1
        sims = np.einsum("qd,qcd->qc", self.x[nodes], self.x[found])
        sims[found < 0] = -3
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(found, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def pruned(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The nearest candidate stays and drops those that are much nearer to it than to the node, and so on."""
        found, sims = self.sorted(nodes, found)
        found, sims = found[:, : 2 * MOST_EDGES], sims[:, : 2 * MOST_EDGES]
        x = self.x[found]
        apart = 2 - 2 * np.matmul(x, x.transpose(0, 2, 1))
        alive, rows = found >= 0, np.arange(len(nodes))
        out = np.full((len(nodes), EDGES), -1, np.int32)
        for k in range(EDGES):
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[some, k] = found[some, pick[some]]
            alive &= ~(ALPHA * apart[rows, pick] <= 2 - 2 * sims)
            alive[rows, pick] = False
        return out

    def beam(self, q: np.ndarray, starts: np.ndarray, width: int, limit=None) -> tuple[np.ndarray, np.ndarray, list]:
        """The nodes that a greedy search keeps for each query, which ones it saw at all, and (query, node) of those within a limit."""
        n_q = len(q)
        seen = np.zeros((n_q, len(self.x)), bool)
        ids, sims, done = np.full((n_q, width), -1, np.int32), np.full((n_q, width), -3, np.float32), np.ones((n_q, width), bool)
        live, more, met = np.arange(n_q), np.asarray(starts), []
        while len(live):
            fresh = (more >= 0) & ~seen[live[:, None], more]
            row, col = np.nonzero(fresh)
            seen[live[row], more[row, col]] = True
            s = np.full(more.shape, -3, np.float32)
            s[row, col] = np.einsum("pd,pd->p", q[live[row]], self.x[more[row, col]])
            if limit:
                a, b = live[row], more[row, col].astype(np.int64)
                good = s[row, col] >= limit(a, b)
                met.append((a[good], b[good]))
            all_ids = np.concatenate((ids[live], np.where(fresh, more, -1)), axis=1)
            all_sims, all_done = np.concatenate((sims[live], s), axis=1), np.concatenate((done[live], ~fresh), axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live], sims[live] = np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_sims, order, axis=1)
            own = np.take_along_axis(all_done, order, axis=1)
            pick = (~own).argmax(axis=1)
            go = ~own[np.arange(len(live)), pick]
            own[np.arange(len(live)), pick] = True
            done[live] = own
            live, pick = live[go], pick[go]
            more = self.near[ids[live, pick]]
        return ids, seen, met

    def within(self, q: np.ndarray, starts: np.ndarray, reach: np.ndarray, radius: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all pairs met whose angle is within the query's reach and the node's radius: a beam, then ever further
        out from what is within reach."""
        limit = lambda a, b: np.cos(np.minimum(reach[a] + radius[b], math.pi)) - 1e-5
        _, seen, found = self.beam(q, starts, width, limit)
        (row, node), n = (np.concatenate([f[i] for f in found]) for i in (0, 1)), len(self.x)
        while len(row):
            further = []
            for lo in range(0, len(row), 4096):
                a = np.repeat(row[lo : lo + 4096], self.near.shape[1])
                b = self.near[node[lo : lo + 4096]].ravel().astype(np.int64)
                open_ = (b >= 0) & ~seen[a, b]
                a, b = np.divmod(np.unique(a[open_] * n + b[open_]), n)
                seen[a, b] = True
                for at in range(0, len(a), 65536):
                    x, y = a[at : at + 65536], b[at : at + 65536]
                    good = np.einsum("pd,pd->p", q[x], self.x[y]) >= limit(x, y)
                    further.append((x[good], y[good]))
            row, node = (np.concatenate([f[i] for f in further]) if further else np.zeros(0, np.int64) for i in (0, 1))
            found.append((row, node))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def medoids(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The nodes nearest to the means of a shard's parts."""
    pivots = x[rng.choice(len(x), min(MEDOIDS, len(x)), replace=False)]
    part = (x @ pivots.T).argmax(axis=1)
    return np.unique([own[(x[own] @ x[own].mean(axis=0)).argmax()] for own in (np.flatnonzero(part == p) for p in range(len(pivots))) if len(own)])


def angle(cosine: np.ndarray | float) -> np.ndarray | float:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def gathered(x: np.ndarray, radius: np.ndarray, weight: np.ndarray, theta: float, least: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(members, centre, radius) of dense groups: whatever a member stands for lies within theta / 2 of the centre."""
    rng, free, made = np.random.default_rng(11), np.arange(len(x)), []
    while len(free) >= least:
        pivots = x[rng.choice(free, min(PIVOTS, len(free)), replace=False)]
        sims = x[free] @ pivots.T
        best, formed = sims.argmax(axis=1), []
        for p in np.unique(best).tolist():
            own = free[(best == p) & (angle(sims[:, p]) + radius[free] <= theta * 0.75)]
            for _ in range(3):  # the mean lies nearer to all than any of them does
                if len(own) < least:
                    break
                centre = (x[own] * weight[own, None]).sum(axis=0)
                centre /= np.sqrt(centre @ centre)
                reach = angle(x[own] @ centre) + radius[own]
                if (reach <= theta / 2 - CLOSE).all():
                    formed.append((own, centre, float(reach.max())))
                    break
                own = own[reach <= theta / 2 - CLOSE]
        if not formed:
            return made
        made += formed
        free = np.setdiff1d(free, np.concatenate([f[0] for f in formed]), assume_unique=True)
    return made


def classes_of(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key) and classes (node, grp, dim, vector, m, least): label and vector as one key, null where nothing can link."""
    kind = table.schema[vector_col].dataType
    code = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            vectors, dims = [], []
            for v, label in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                x = None if not v or label is None or None in v else np.array(v, code)
                good = x is not None and np.isfinite(x).all() and x.any()
                vectors.append(x.tobytes() if good else None)
                dims.append(len(x) if good else None)
            return pa.record_batch([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], ["id", "label", "dim", "vector"])

        return part

    read = map_parts(table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")), make, "id long, label string, dim int, vector binary", 2048)
    grp = F.concat_ws("/", "dim", "label")
    rows = read.withColumn("key", F.when(F.col("vector").isNotNull(), F.sha2(F.concat(F.encode(F.concat(grp, F.lit("/")), "UTF-8"), F.col("vector")), 256)))
    made = rows.where("key is not null").groupBy("key").agg(F.first(grp).alias("grp"), F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.count("*").alias("m"), F.min("id").alias("least"))
    return settle(rows.select("id", "key")), settle(made.withColumn("node", F.monotonically_increasing_id()))


class Cells:
    """Centroids of the dimensions that have large labels."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids = centroids

    @classmethod
    def fit(cls, nodes: DataFrame, rounds: int = 6) -> Cells:
        sizes = nodes.groupBy("grp", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("most"))
        # dimensions with a label that needs cells; a table of numbers this long has few lengths, and MOST_CELLS bounds them
        large = {r["dim"]: r["most"] for r in sizes.where(F.col("most") > SHARD_ROWS).orderBy(F.desc("most")).limit(MOST_CELLS // 2).collect()}
        if not large:
            return cls({})
        there = nodes.where(F.col("dim").isin(list(large)))
        total, widest = there.agg(F.count("*"), F.max("dim")).first()
        drawn: dict[int, list] = {}
        for r in first_hashes(there.withColumn("h", F.xxhash64("vector", F.lit("sample"))), "h", min(SAMPLE, SAMPLE_BYTES // (8 * widest)), total).select("dim", "h", "vector").collect():
            drawn.setdefault(r["dim"], []).append((r["h"], bytes(r["vector"])))
        made = {}
        for dim, rows in drawn.items():
            x = floats([v for _, v in sorted(rows)], dim).astype(np.float32)
            cells = min(math.ceil(2 * large[dim] / SHARD_ROWS), MOST_CELLS // len(large), len(x) // 8)
            if cells > 1:
                c = x[:cells].copy()
                for _ in range(rounds):
                    at = np.concatenate([(x[lo : lo + 1024] @ c.T).argmax(axis=1) for lo in range(0, len(x), 1024)])
                    sums = np.zeros_like(c)
                    np.add.at(sums, at, x)
                    norms = np.sqrt((sums**2).sum(axis=1))
                    c[norms > 1e-6] = (sums / np.maximum(norms, 1e-6)[:, None])[norms > 1e-6]
                made[dim] = c
        return cls(made)

    def dealt(self, nodes: DataFrame, copies: int, grouped: DataFrame, most: int) -> DataFrame:
        """(node, place, subs, sub), once for each of a node's nearest cells; balls, which reach further, go to more of them.
        ``grouped`` has the size of each label."""
        centroids = self.centroids

        def make():
            def part(b: pa.RecordBatch) -> pa.RecordBatch:
                dims, ns, radius = (np.asarray(b.column(c)) for c in ("dim", "n", "radius"))
                vectors, grps = b.column("vector").to_pylist(), b.column("grp").to_pylist()
                at, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    large = own[ns[own] > most] if dim in centroids else own[:0]
                    rest = np.setdiff1d(own, large, assume_unique=True)
                    at, cell = [*at, rest], [*cell, np.full(len(rest), -1)]
                    if len(large):
                        x = floats([vectors[i] for i in large], dim).astype(np.float32)
                        order = np.argsort(-(x @ centroids[dim].T), axis=1, kind="stable")
                        k = np.minimum(np.where(radius[large] > 0, BALL_COPIES, 1) * copies, order.shape[1])
                        at, cell = [*at, np.repeat(large, k)], [*cell, order[np.arange(order.shape[1])[None, :] < k[:, None]]]
                at, cell = pa.array(np.concatenate(at).astype(np.int64)), np.concatenate(cell).tolist()
                places = [f"{grps[i]}/{c}" for i, c in zip(at.to_pylist(), cell)]
                return pa.record_batch([b.column("node").take(at), pa.array(places, pa.string())], ["node", "place"])

            return part

        sized = look_up(nodes.select("node", "grp", "dim", "vector", "radius"), "grp", "node", grouped)
        placed = map_parts(sized.select("node", "grp", "dim", "vector", "radius", "n"), make, "node long, place string", 2048)
        shards = placed.groupBy("place").agg(F.ceil(F.count("*") / most).cast("int").alias("subs"))
        return look_up(placed, "place", "node", shards).withColumn("sub", F.pmod(F.xxhash64("node"), "subs").cast("int"))


def with_balls(classes: DataFrame, theta: float) -> tuple[DataFrame, DataFrame]:
    """Membership (node, unit) of all classes, and units (node, grp, dim, vector, radius, classes, w): balls, and classes outside them."""
    units = classes.select("node", "grp", "dim", "vector", F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("classes"), F.col("m").alias("w"))
    schema = "node long, unit long, grp string, dim int, vector binary, radius double, classes long, w long"

    def round_of(units: DataFrame, least: int) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
            x, radius, w = floats(list(pdf["vector"]), int(pdf["dim"].iloc[0])), pdf["radius"].to_numpy(), pdf["w"].to_numpy()
            out = pdf[["node", "grp", "dim", "vector", "radius", "classes", "w"]].copy()
            out.insert(1, "unit", out["node"])
            for own, centre, reach in gathered(x, radius, w.astype(float), theta, least):
                name = int(own[0])
                out.loc[own, "unit"] = int(pdf["node"].iloc[name])
                out.at[name, "vector"], out.at[name, "radius"] = centre.astype("<f8").tobytes(), reach
                out.at[name, "classes"], out.at[name, "w"] = int(pdf["classes"].iloc[own].sum()), int(w[own].sum())
            # what a ball is stands in the row of its name alone
            out.loc[out["node"] != out["unit"], "vector"] = None
            return out

        sizes = units.groupBy("grp").agg(F.count("*").alias("n"))
        dealt = Cells.fit(units).dealt(units, 1, sizes, SHARD_ROWS)
        return settle(dealt.select("node", "place", "sub").join(units, "node").groupBy("place", "sub").applyInPandas(one, schema))

    made = round_of(units, LEAST_BALL)
    members, units = made.select("node", "unit"), made.where("node = unit").drop("unit")
    balls = units.where("classes > 1")
    n = balls.count()
    while n > 1:
        again = round_of(balls, 2)
        joined = again.where("node = unit").drop("unit")
        left = joined.count()
        if left == n:
            break
        further = again.select(F.col("node").alias("unit"), F.col("unit").alias("further"))
        members = settle(look_up(members, "unit", "node", further).select("node", F.coalesce("further", "unit").alias("unit")))
        units = settle(units.where("classes = 1").unionByName(joined))
        balls, stop, n = joined, left > 0.7 * n, left
        if stop:
            break
    return members, units


def shard_nodes(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
    return pdf, floats(list(pdf["vector"]), int(pdf["dim"].iloc[0]))


def graph_of(shards: DataFrame, width: int) -> DataFrame:
    """(node, near): each node's united neighbours."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = shard_nodes(pdf)
        nodes = pdf["node"].to_numpy()
        near = Flat.build(x, width).near
        return pd.DataFrame({"node": nodes, "near": [nodes[r[r >= 0]] for r in near]})

    lists = shards.groupBy("place", "sub").applyInPandas(one, "node long, near array<long>")
    return settle(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))


def searched(shards: DataFrame, graph: DataFrame, theta: float, width: int) -> DataFrame:
    """(a, b, sure): pairs of nodes, a below b, that are linked or, where balls leave it open, may be."""

    def one(key: tuple, base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "sure": np.zeros(0, bool)})
        if not len(base) or not len(asked):
            return out
        base, x = shard_nodes(base)
        nodes, radius = base["node"].to_numpy(), base["radius"].to_numpy()

        def local(lists: pd.Series) -> np.ndarray:
            sizes = np.array([0 if v is None else len(v) for v in lists])
            flat = np.concatenate([np.zeros(0, np.int64), *[v for v in lists if v is not None]])
            at = np.minimum(np.searchsorted(nodes, flat), len(nodes) - 1)
            made = np.full((len(lists), max(1, int(sizes.max(initial=0)))), -1, np.int32)
            made[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(nodes[at] == flat, at, -1)
            return made

        graph = Flat(x, local(base["near"]), medoids(x, np.random.default_rng(7)))
        asked, y = shard_nodes(asked)
        names, reach = asked["node"].to_numpy(), asked["radius"].to_numpy()
        found = [out]
        for lo in range(0, len(asked), SIDE_BY_SIDE):
            block = slice(lo, lo + SIDE_BY_SIDE)
            own = local(asked["near"].iloc[block])
            starts = np.concatenate((np.broadcast_to(graph.medoids, (len(own), len(graph.medoids))), own), axis=1)
            starts = np.sort(starts, axis=1)
            starts[:, 1:][starts[:, 1:] == starts[:, :-1]] = -1
            q, node = graph.within(y[block].astype(np.float32), starts, theta + reach[block], radius, width)
            q = q + lo
            other = names[q] != nodes[node]
            q, node = q[other], node[other]
            cosine = np.concatenate([np.zeros(0), *(np.einsum("pd,pd->p", y[q[at : at + 65536]], x[node[at : at + 65536]]) for at in range(0, len(q), 65536))])
            radii = reach[q] + radius[node]
            between = angle(cosine)
            sure = np.where(radii == 0, cosine >= LINKED, between + radii <= theta - CLOSE)
            kept = sure | (radii > 0) & (between - radii <= theta + CLOSE)
            a, b = names[q[kept]], nodes[node[kept]]
            found.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure[kept]}).drop_duplicates(["a", "b"]))
        return pd.concat(found, ignore_index=True)

    base = shards.join(graph, "node", "left")
    # every shard of a cell sees all nodes of the cell
    asked = base.drop("sub").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).toDF("node", "place", "subs", "dim", "vector", "radius", "near", "sub")
    cols = ["place", "sub", "node", "dim", "vector", "radius", "near"]
    pairs = base.select(*cols).groupBy("place", "sub").cogroup(asked.select(*[F.col(c).alias(c) for c in cols]).groupBy("place", "sub")).applyInPandas(one, "a long, b long, sure boolean")
    return settle(pairs.groupBy("a", "b").agg(F.bool_or("sure").alias("sure")))


def audit(units: DataFrame, pairs: DataFrame, theta: float) -> tuple[int, int]:
    """How many possible links a sample of nodes has with all others, and how many of them ``pairs`` has."""
    total = units.count()
    rows = first_hashes(units.withColumn("h", F.xxhash64("node", F.lit("audit"))), "h", AUDIT_NODES // 2, total).select("node", "grp", "dim", "vector", "radius").limit(2 * AUDIT_NODES).collect()
    asked: dict[str, list] = {}
    for r in rows:
        asked.setdefault(r["grp"], []).append((r["node"], r["dim"], bytes(r["vector"]), r["radius"]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = {g: (np.array([s[0] for s in some]), floats([s[2] for s in some], some[0][1]), np.array([s[3] for s in some])) for g, some in asked.items()}
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                grps, nodes, radius, vectors = np.array(b.column("grp").to_pylist(), object), np.asarray(b.column("node")), np.asarray(b.column("radius")), b.column("vector").to_pylist()
                for g in set(grps.tolist()) & told.keys():
                    own = np.flatnonzero(grps == g)
                    names, x, r = told[g]
                    cosine = floats([vectors[i] for i in own], x.shape[1]) @ x.T
                    radii = radius[own][:, None] + r[None, :]
                    near = np.where(radii == 0, cosine >= LINKED, angle(cosine) - radii <= theta + CLOSE)
                    n += int((near & (nodes[own][:, None] != names[None, :])).sum())
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    there = units.select("grp", "node", "radius", "vector").mapInArrow(task, "n long").agg(F.sum("n")).first()[0] or 0
    names = [r["node"] for r in rows]
    held = pairs.select(F.col("a").isin(names).cast("long").alias("x"), F.col("b").isin(names).cast("long").alias("y")).agg(F.sum(F.col("x") + F.col("y"))).first()[0] or 0
    return there, held


def verified(open_: DataFrame, units: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """What open pairs of nodes come to, member by member: (node, n) links of a class, and (a, b) for pairs with a link."""
    sizes = units.select("node", "classes")
    pairs = open_.join(sizes.toDF("a", "ca"), "a").join(sizes.toDF("b", "cb"), "b")
    large = (F.col("ca") > F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b")))
    pairs = settle(pairs.select(F.when(large, F.col("a")).otherwise(F.col("b")).alias("ball"), F.when(large, F.col("b")).otherwise(F.col("a")).alias("other"), F.least("ca", "cb").alias("n"), F.greatest("ca", "cb").alias("size")))
    own = classes.select("node", "dim", "vector", "m").join(members, "node")
    tiles = pairs.groupBy("ball").agg(F.ceil(F.max("size") / TILE).cast("int").alias("left"), F.ceil(F.sum("n") / TILE).cast("int").alias("right"))
    meets = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")

    inside = look_up(own.join(tiles.select(F.col("ball").alias("unit")), "unit", "left_semi"), "unit", "node", tiles.withColumnRenamed("ball", "unit"))
    inside = inside.withColumn("i", dealt("left")).withColumn("j", meets("right")).select(F.col("unit").alias("ball"), "i", "j", "node", "dim", "vector", "m")
    against = own.join(pairs.select(F.col("other").alias("unit"), "ball"), "unit")
    against = look_up(against, "ball", "node", tiles).withColumn("j", dealt("right")).withColumn("i", meets("left")).select("ball", "i", "j", "unit", "node", "dim", "vector", "m")

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"node": [], "n": [], "a": [], "b": []}
        if len(left) and len(right):
            x, y = (floats(list(t["vector"]), int(t["dim"].iloc[0])) for t in (left, right))
            mine = np.zeros(len(left), np.int64)
            theirs = np.zeros(len(right), np.int64)
            for lo in range(0, len(right), SIDE_BY_SIDE):
                linked = y[lo : lo + SIDE_BY_SIDE] @ x.T >= LINKED
                mine += right["m"].to_numpy()[lo : lo + SIDE_BY_SIDE] @ linked
                theirs[lo : lo + SIDE_BY_SIDE] = linked @ left["m"].to_numpy()
            edges = np.unique(right["unit"].to_numpy()[theirs > 0])
            a, b = np.minimum(edges, key[0]), np.maximum(edges, key[0])
            nodes = np.concatenate((left["node"].to_numpy()[mine > 0], right["node"].to_numpy()[theirs > 0]))
            out = {"node": [*nodes.tolist(), *[None] * len(edges)], "n": [*mine[mine > 0].tolist(), *theirs[theirs > 0].tolist(), *[None] * len(edges)], "a": [*[None] * len(nodes), *a.tolist()], "b": [*[None] * len(nodes), *b.tolist()]}
        return pd.DataFrame(out).astype("Int64")

    by = ["ball", "i", "j"]
    against = against.toDF(*against.columns)
    return settle(inside.groupBy(*by).cogroup(against.groupBy(*by)).applyInPandas(one, "node long, n long, a long, b long"))


def join(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    theta = float(angle(LINKED))
    rows, classes = classes_of(table, id_col, vector_col, label_col)
    members, units = with_balls(classes, theta)
    grouped = settle(units.groupBy("grp").agg(F.count("*").alias("n")))
    cells = Cells.fit(units)
    for copies, width in EFFORTS:
        shards = settle(cells.dealt(units, copies, grouped, SHARD_ROWS).select("node", "place", "sub", "subs").join(units.select("node", "dim", "vector", "radius"), "node"))
        pairs = searched(shards, graph_of(shards, width), theta, width)
        there, held = audit(units, pairs, theta)
        if held >= AUDITED * there:
            break

    sure, open_ = pairs.where("sure").select("a", "b"), pairs.where("not sure").select("a", "b")
    if open_.limit(1).count():
        told = verified(open_, units, members, classes)
        sure_edges = sure.unionByName(told.where("a is not null").select("a", "b"))
        singly = told.where("node is not null").groupBy("node").agg(F.sum("n").alias("singly"))
    else:
        sure_edges, singly = sure, classes.sparkSession.createDataFrame([], "node long, singly long")
    both = sure.unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wholly = both.join(units.select(F.col("node").alias("b"), "w"), "b").groupBy("a").agg(F.sum("w").alias("wholly"))
    labels = connected_components(sure_edges)
    at = units.select(F.col("node").alias("unit"), "w").join(wholly.withColumnRenamed("a", "unit"), "unit", "left").join(labels.withColumnRenamed("node", "unit"), "unit", "left")
    at = at.select("unit", (F.col("w") - 1 + F.coalesce("wholly", F.lit(0))).alias("links"), F.coalesce("component", "unit").alias("component"))
    own = look_up(members, "unit", "node", at).select("node", "links", "component").join(singly, "node", "left").join(classes.select("node", "key", "least"), "node")
    own = settle(own.select("key", "least", "component", (F.col("links") + F.coalesce("singly", F.lit(0))).alias("n_links")))
    names = own.groupBy("component").agg(F.min("least").alias("component_id"))
    own = look_up(own, "component", "key", names).select("key", "n_links", "component_id")
    out = look_up(rows.withColumn("by", F.monotonically_increasing_id()), "key", "by", own)
    name = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.col("id").eqNullSafe(name).alias("kept"))
