"""Centroid clustering in whole numbers: a tournament of bisectors names each vector's nearest centroid, exactly.

A vector x is nearer to centroid i than to j as ``2 (cj - ci) . x`` is below ``|cj|^2 - |ci|^2``. These normals and thresholds are
worked out once for all pairs of centroids; k - 1 of the tests, in a knock-out, leave one centroid, and a zero favours the
smaller number. Only then a distance is taken. A task sums its own vectors by centroid, so k sums a task are shuffled and k
centroids reach the driver, whatever the size of the table.

Whole numbers below 2**22 or so are exact in doubles; a batch with larger ones is worked out in Python's integers.

Vectors that are null, of another length, or hold null or non-finite components (also after scaling) are left out; every other
row counts, repeated ids and equal vectors too. First centroids with equal hashes (repeated ids) go by their components; a null
id hashes as an empty one. Fewer rows than ``k`` make as many centroids as there are rows, and an empty table gives an
empty one. Distances and sums that no long can hold are null. Other columns are ignored. There are no texts here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settle

#: Vectors that meet in one step of the tournament; bits of a part of a sum.
AT_ONCE, LIMB = 1024, 62
LONG = 1 << 63


def whole_numbers(table: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(id, x): floor(scale * component) as doubles, which hold these exactly."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(at, AT_ONCE)
                v = b.column(1)
                counts = np.asarray(v.value_lengths().fill_null(-1))
                fits = np.flatnonzero(counts == size)
                flat = v.take(pa.array(fits)).flatten()
                x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), "f8").reshape(-1, size)
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(x * scale)
                good = np.isfinite(x).all(axis=1)
                x = x[good]
                offsets = np.arange(0, size * len(x) + 1, size, dtype=np.int32)
                yield pa.record_batch([b.column(0).take(pa.array(fits[good])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], ["id", "x"])

    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(task, "id long, x array<double>")


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.k = len(centroids)
        self.whole = np.empty((self.k, len(centroids[0])), object)
        self.whole[:] = centroids
        self.largest = max((abs(c) for row in centroids for c in row), default=0)
        self.made: dict[bool, tuple] = {}

    def of(self, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroids, normals[i, j] and thresholds[i, j], in doubles or in Python's integers."""
        if exact not in self.made:
            c = self.whole if exact else self.whole.astype("f8")
            squares = (c * c).sum(axis=1)
            self.made[exact] = c, 2 * (c[None, :, :] - c[:, None, :]), squares[None, :] - squares[:, None]
        return self.made[exact]

    def needs_integers(self, x: np.ndarray) -> bool:
        """Whether a sum could leave the whole numbers that doubles hold exactly."""
        most = max(self.largest, int(np.abs(x).max(initial=0)))
        return x.shape[1] * 4 * most * most >= 1 << 53

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, and their squared distance."""
        exact = self.needs_integers(x)
        c, normals, thresholds = self.of(exact)
        if exact:
            x = np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
        alive = np.broadcast_to(np.arange(self.k), (len(x), self.k))
        first = True
        while alive.shape[1] > 1:
            m = alive.shape[1]
            left, right = alive[:, 0 : m - 1 : 2], alive[:, 1:m:2]
            if first:  # everybody's pairs are the same
                side = x @ normals[left[0], right[0]].T if len(x) else np.zeros(left.shape)
            else:
                side = (x[:, None, :] * normals[left, right]).sum(axis=2) if exact else np.einsum("nd,nmd->nm", x, normals[left, right])
            won = np.where(side <= thresholds[left, right], left, right)
            alive = np.concatenate((won, alive[:, m - 1 :]), axis=1) if m % 2 else won
            first = False
        nearest = alive[:, 0]
        return nearest, ((x - c[nearest]) ** 2).sum(axis=1)


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size in parts of 62 bits, the last one signed; their sums are parts of the sum."""
    k = 0
    while not -(1 << LIMB) <= total < 1 << LIMB:
        yield k, total & ((1 << LIMB) - 1)
        total, k = total >> LIMB, k + 1
    yield k, total


def batches_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            b = batch.slice(at, AT_ONCE)
            yield b, np.asarray(b.column("x").flatten(), "f8").reshape(-1, size)


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: each the floor of its vectors' mean, or what it was if it has none."""
    size = len(centroids[0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors, counts = Bisectors(centroids), [0] * len(centroids)
        sums = np.zeros((len(centroids), size), object)
        for _, x in batches_of(batches, size):
            at, _ = bisectors.nearest(x)
            here = np.unique(at)
            exact = bisectors.needs_integers(x)
            for c in here.tolist():
                own = x[at == c]
                counts[c] += len(own)
                sums[c] += [sum(map(int, col)) for col in own.T.tolist()] if exact else own.sum(axis=0).astype("i8").astype(object)
        rows = [(c, i, k, part) for c, n in enumerate(counts) if n for i, total in [(-1, n), *enumerate(sums[c])] for k, part in limbs(int(total))]
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["c", "i", "k", "part"])

    told = rows.select("x").mapInArrow(task, "c int, i int, k int, part long").groupBy("c", "i", "k").agg(F.sum(F.col("part").cast("decimal(19,0)")).alias("total")).collect()
    sums: dict[tuple[int, int], int] = {}
    for r in told:
        sums[r["c"], r["i"]] = sums.get((r["c"], r["i"]), 0) + (int(r["total"]) << (LIMB * r["k"]))
    return [[sums[c, i] // sums[c, -1] for i in range(size)] if (c, -1) in sums else old for c, old in enumerate(centroids)]


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept row. ``k`` bounds what the driver holds."""
    rows = settle(whole_numbers(table, id_col, vector_col, size, scale))
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = [[int(v) for v in r["x"]] for r in sorted(first, key=lambda r: (r["h"], r["x"]))]
    if not centroids:
        return table.sparkSession.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids)
        for b, x in batches_of(batches, size):
            at, far = bisectors.nearest(x)
            far = [None if d >= LONG else int(d) for d in far.tolist()]
            yield pa.record_batch([b.column("id"), pa.array(at, pa.int32()), pa.array(far, pa.int64())], [id_col, "cluster", "distance"])

    placed = settle(rows.mapInArrow(task, f"{id_col} long, cluster int, distance long"))
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    fits = lambda v, lost: None if lost or v >= LONG else v
    lost, whole = sum(r["lost"] for r in sums), sum(int(r["s"] or 0) for r in sums)
    told = [(r["cluster"], fits(int(r["s"] or 0), r["lost"]), fits(whole, lost), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    figures = table.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a cluster, k at most
    return placed.join(F.broadcast(figures), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
