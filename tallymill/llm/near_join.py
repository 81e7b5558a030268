"""Jaccard join on word n-grams: a MinHash LSH forest proposes, exact verification decides.

Words are the lower-cased runs of the text between white space; a shingle is five words in a row, or all words of a text
that has fewer. Texts with equal sets of shingles are one class. A class has a path of ``LONGEST`` values in each tree of the
forest. Sorted paths are a tree's prefix trie: neighbours in the sort tell how deep a class meets another one, and only
classes that meet below the floor, the longest prefix with which a pair at the threshold meets in some tree with the
wanted recall, go on.

1. Classes with a whole path in common are compared with the least of them by their signatures, one row a class; so a large
   group of near copies becomes one component before any pairs are looked at.
2. From the longest prefix down, classes of different components that meet in a node are compared by their signatures within
   that node. Each level adds what newly meets. After each level the recall is estimated from the links so far, each weighed
   by the chance with which its similarity meets at that depth; the prefix is shortened until the estimate reaches the
   recall, at the floor at the latest.
3. Within components of likely links (signatures alike to 0.64 or more for a threshold of 0.8, 5.5 deviations below) all
   pairs are verified exactly on the shingles, tile against tile, in numpy. What leaves a task is one row a class with its number
   of links and its root, so no group makes a row per pair.

Result: id, class_id (the smallest id of the document's connected component of links), n_links (the other documents at or
above the threshold, copies included). Null and empty texts, and texts without a word, link to nothing. Very long texts are
taken whole. Ids may be of any type that sorts, null or repeated: texts tell classes apart, a null id counts as the largest,
and a row that is repeated whole counts as a copy. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .components import connected_components
from .pieces import slices
from .tables import free_name, look_up, map_parts, remembered, settle

WORDS, THRESHOLD, RECALL, TREES, LONGEST = 5, 0.8, 0.9999, 24, 8
#: Deviations that a likely link's signature may lie below the threshold.
DEVIATIONS = 5.5
#: A node's classes that are compared at once, and a tile's classes and shingles at most (one class alone may have more).
NODE_ROWS, TILE_ROWS, TILE_SHINGLES = 2048, 4096, 2_000_000
#: Rows and columns of a matrix at once.
BLOCK_ROWS, COLUMNS = 512, 4_096
KEEP_WORDS = 150_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def meets(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with the wanted recall."""
    return next((d for d in range(LONGEST, 1, -1) if meets(threshold, d, trees) >= recall), 1)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KEEP_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def worker_hashes() -> WordHashes:
    return remembered("words of near_join", WordHashes)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """The distinct shingles of a whole text, as sorted 64-bit hashes."""
    parts = [np.fromiter(map(hashes.__getitem__, part.lower().split()), np.uint64) for part in slices(text)]
    words = parts[0] if len(parts) == 1 else np.concatenate(parts)
    if not len(words):
        return words
    n = min(n, len(words))
    made = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        made = mixed(made * MIX[0] + words[i : i + len(made)])
    return np.unique(made)


def forest(trees: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 1 << 32, trees * LONGEST, dtype=np.uint64).astype(np.uint32)
    return draw() | np.uint32(1), draw()


def signature(grams: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The paths of a set in all trees: one 16-bit value for the minimum under each permutation, the first ones first."""
    low, short = np.full(len(seeds[0]), 0xFFFFFFFF, np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 256):
        seen = short[at : at + 256, None] * seeds[0]
        seen += seeds[1]
        np.minimum(low, seen.min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


AT = ["at1", "at2", "at3"]


def identity(id_col: str, text_col: str) -> list[Column]:
    """What tells one (id, text) from another, a null text being an empty one: 120 bits of the text's digest, in its order, and
    a hash of the id."""
    hexed = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    half = lambda at: F.conv(F.substring(hexed, at, 15), 16, 10).cast("long")
    return [half(1).alias(AT[0]), half(16).alias(AT[1]), F.xxhash64(F.col(id_col).isNull(), id_col).alias(AT[2])]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, trees: int) -> DataFrame:
    """(id, at1, at2, at3, set1, set2, n, signature) of each document: what its set of shingles hashes to, its size and paths."""
    base = docs.select(F.col(id_col).alias("id"), *identity(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        hashes, seeds = worker_hashes(), forest(trees)

        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in b.column(4).to_pylist():
                grams = shingles(text, hashes)
                rows.append((xxhash.xxh3_128_digest(grams.tobytes()), len(grams), signature(grams, seeds) if len(grams) else b""))
            sets = np.frombuffer(b"".join(r[0] for r in rows), np.int64).reshape(-1, 2)
            n, paths = pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())
            return pa.record_batch([*b.columns[:4], pa.array(sets[:, 0]), pa.array(sets[:, 1]), n, paths], ["id", *AT, "set1", "set2", "n", "signature"])

        return part

    more = [StructField(c, LongType()) for c in ("set1", "set2", "n")] + [StructField("signature", BinaryType())]
    return map_parts(base, make, StructType(base.drop("text").schema.fields + more))


def sorted_tries(classes: DataFrame, trees: int, floor: int) -> DataFrame:
    """(tree, p1, p2, rep, depth, low): the paths (two 64-bit numbers) that meet another one at the floor or deeper, with the
    greatest such depth and the least class with the whole path in common. Streams over sorted paths: its memory is a batch."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.frombuffer(b"".join(b.column(1).to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
            rep = np.repeat(b.column(0).to_numpy(zero_copy_only=False), trees)
            tree = np.tile(np.arange(trees, dtype=np.int32), b.num_rows)
            yield pa.record_batch([pa.array(tree), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(rep)], ["tree", "p1", "p2", "rep"])

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, low = np.zeros((0, 4), np.int64), 0, 0

        def told(rows: np.ndarray, depth: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
            keep = depth >= floor
            rows, depth, least = rows[keep], depth[keep], least[keep]
            columns = [pa.array(rows[:, 0].astype(np.int32)), *(pa.array(rows[:, k]) for k in (1, 2, 3)), pa.array(depth.astype(np.int32)), pa.array(least)]
            return pa.record_batch(columns, ["tree", "p1", "p2", "rep", "depth", "low"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)])
            path = np.ascontiguousarray(rows[:, 1:3]).astype(">i8").view(">u2").reshape(len(rows), LONGEST)
            shared = np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1) * (rows[1:, 0] == rows[:-1, 0])
            first = np.concatenate([[len(held) == 0], shared < LONGEST])
            start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), -1))
            least = np.where(start >= 0, rows[np.maximum(start, 0), 3], low)
            depth = np.maximum(np.concatenate([[before], shared]), np.concatenate([shared, [0]]))
            yield told(rows[:-1], depth[:-1], least[:-1])
            held, before, low = rows[-1:], int(depth[-1]), int(least[-1])
        if len(held):
            yield told(held, np.array([before]), np.array([low]))

    rows = classes.select("rep", "signature").mapInArrow(paths, "tree int, p1 long, p2 long, rep long")
    return rows.repartition(node(floor)).sortWithinPartitions("tree", "p1", "p2", "rep").mapInArrow(meetings, "tree int, p1 long, p2 long, rep long, depth int, low long")


def node(depth: int) -> Column:
    """The node of a tree at this depth, from (tree, p1, p2)."""
    first = F.col("p1") if depth >= 4 else F.shiftrightunsigned("p1", 16 * (4 - depth))
    then = F.lit(0) if depth <= 4 else F.col("p2") if depth == 8 else F.shiftrightunsigned("p2", 16 * (8 - depth))
    return F.xxhash64("tree", first, then)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures, row by row; a may be one row."""
    return (a == b).mean(axis=-1)


def likely(threshold: float, trees: int) -> float:
    return threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / (trees * LONGEST))


def values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def stars(tries: DataFrame, classes: DataFrame, threshold: float, trees: int) -> DataFrame:
    """(a, b, alike): each class with the least one that shares a whole path with it, if a link is likely."""
    bound = likely(threshold, trees)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                same = alike(values(b.column(4)), values(b.column(5)))
                keep = pa.array((same >= bound) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(same)], ["a", "b", "alike"]).filter(keep)

    low = tries.where(F.col("depth") == LONGEST).groupBy("rep").agg(F.min("low").alias("low")).where("low < rep")
    first = classes.select(F.col("rep").alias("low"), F.col("n").alias("m"), F.col("signature").alias("other"))
    pairs = look_up(low.join(classes.select("rep", "n", "signature"), "rep"), "low", "rep", first)
    return pairs.select("rep", "low", "n", "m", "signature", "other").mapInArrow(compare, "a long, b long, alike double")


def compared(rows: list[tuple], bound: float, threshold: float) -> list[tuple[int, int, float]]:
    """Likely links (a, b, alike) that connect the components of one node: rows (component, n, signature). Classes of one component
    are not compared, nor is the largest component's with each other's more than once."""
    names, number, count = np.unique([r[0] for r in rows], return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    n, signs = np.array([r[1] for r in rows], np.int64), np.stack([np.frombuffer(r[2], np.uint16) for r in rows])
    label, found = number.copy(), []
    for at in np.flatnonzero(number != count.argmax()):
        other = np.flatnonzero((label != label[at]) & (np.minimum(n, n[at]) >= threshold * np.maximum(n, n[at]) - 1e-9))
        if not len(other):
            continue
        same = alike(signs[at], signs[other])
        for k in np.flatnonzero(same >= bound):
            i = other[k]
            if label[i] != label[at]:
                a, b = sorted((int(names[number[at]]), int(names[number[i]])))
                found.append((b, a, float(same[k])))
                label[label == label[i]] = label[at]
    return found


def level(tries: DataFrame, classes: DataFrame, depth: int, threshold: float, trees: int) -> DataFrame:
    """(a, b, alike): likely links between components that newly meet at this depth."""
    deeper = node(depth + 1) if depth < LONGEST else F.lit(None)
    rows = tries.where(F.col("depth") >= depth).select("rep", "component", node(depth).alias("node"), deeper.cast("long").alias("child"))
    fresh = F.lit(True) if depth == LONGEST else F.col("least") < F.col("most")
    asked = rows.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("child").alias("least"), F.max("child").alias("most"), F.count("*").alias("count"))
    asked = asked.where((F.col("lo") < F.col("hi")) & fresh).select("node", F.ceil(F.col("count") / NODE_ROWS).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    held = look_up(rows, "node", "rep", asked).where("parts is not null").select("node", "rep", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    held = held.join(classes.select("rep", "n", "signature"), "rep")
    held = held.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "component", "n", "signature")
    bound = likely(threshold, trees)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 3):
            if found := compared(rows, bound, threshold):
                yield pa.record_batch([pa.array(x) for x in zip(*found)], ["a", "b", "alike"])

    return held.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(compare, "a long, b long, alike double")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each group of a table sorted by its first columns, without these."""
    at, held = None, []
    for b in batches:
        for row in (r for k in range(0, b.num_rows, 64) for r in zip(*(c.to_pylist() for c in b.slice(k, 64).columns))):
            if at != row[:keys]:
                if held:
                    yield held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield held


def estimated_recall(links: DataFrame, depth: int, threshold: float, trees: int) -> float:
    """The share of links that meet at this depth, from those found: each stands for as many as its similarity lets meet. One at
    the threshold is always counted with them, so few links prove nothing."""
    chance = 1 - F.pow(1 - F.pow(F.least("alike", F.lit(1.0)), F.lit(float(depth))), F.lit(float(trees)))
    found, stand_for = links.where(F.col("alike") >= threshold).agg(F.count("*"), F.coalesce(F.sum(1 / chance), F.lit(0.0))).first()
    at_threshold = meets(threshold, depth, trees)
    return (found + at_threshold) / (stand_for + 1)


def candidates(classes: DataFrame, threshold: float, recall: float, trees: int) -> DataFrame:
    """(rep, component): the classes in components of likely links."""
    floor = prefix_length(threshold, trees, recall)
    tries = settle(sorted_tries(classes, trees, floor))
    links = first = settle(stars(tries, classes, threshold, trees))
    known = settle(connected_components(first, "a", "b"))
    named = look_up(tries, "rep", "tree", known.withColumnRenamed("node", "rep")).withColumn("component", F.coalesce("component", "rep")).withColumn("node", node(floor))
    several = named.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("node")
    tries = settle(named.join(several, "node", "left_semi").drop("node", "low"))
    for depth in range(LONGEST, floor - 1, -1):
        links = links.unionByName(settle(level(tries, classes, depth, threshold, trees)))
        if depth > floor and estimated_recall(links, depth, threshold, trees) >= recall:
            break
    return connected_components(links, "a", "b").withColumnRenamed("node", "rep")


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of a and b (sorted, distinct) have a Jaccard similarity of at least the threshold."""
    sets = a if a is b else a + b
    size = np.array([len(x) for x in sets], np.float64)
    grams, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count >= 2
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(a), len(b)), np.float64)
    total = int(number[-1]) + 1
    for at in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, total - at)), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        both += m[: len(a)] @ m[len(sets) - len(b) :].T
    sa, sb = size[: len(a)], size[len(sets) - len(b) :]
    return both >= threshold * (sa[:, None] + sb[None, :] - both) - 1e-9


def verified(tile: list[tuple], within: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root) of the classes with links within one tile, or between two: rows (first side?, rep, copies, shingles).
    The root is the least class that links reach here."""
    rows = sorted({(x[0], x[1]): x for x in tile}.values(), key=lambda x: (not x[0], x[1]))
    names, copies = np.array([x[1] for x in rows], np.int64), np.array([x[2] for x in rows], np.int64)
    sets, split = [np.frombuffer(x[3], np.uint64) for x in rows], sum(bool(x[0]) for x in rows)
    links, parent = np.zeros(len(rows), np.int64), list(range(len(rows)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(i: int, k: int) -> None:
        i, k = top(i), top(k)
        if i != k:
            low, high = (i, k) if names[i] < names[k] else (k, i)
            parent[high] = low

    cuts = lambda lo, hi: [(at, min(at + BLOCK_ROWS, hi)) for at in range(lo, hi, BLOCK_ROWS)]
    mine, theirs = cuts(0, split), cuts(split, len(rows))
    for a in mine:
        for b in [b for b in mine if b >= a] if within else theirs:
            left = sets[slice(*a)]
            link = linked(left, left if a == b else sets[slice(*b)], threshold)
            if a == b:
                np.fill_diagonal(link, False)
            links[slice(*a)] += link @ copies[slice(*b)]
            if a != b:
                links[slice(*b)] += link.T @ copies[slice(*a)]
            # a row's least partner, and each partner's, span what the block connects, but for rows that share no least one
            while link.any():
                some = np.flatnonzero(link.any(axis=1))
                least = link[some].argmax(axis=1)
                for i, k in zip(some, least):
                    join(a[0] + int(i), b[0] + int(k))
                heads = np.array([top(i) for i in range(*a)]), np.array([top(k) for k in range(*b)])
                link = link & (heads[0][:, None] != heads[1][None, :])
    some = np.flatnonzero(links)
    return names[some], links[some], names[[top(int(i)) for i in some]] if len(some) else names[:0]


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, root, whole) from members (rep, copies, component, tiles, text); whole: the component was one tile."""
    names = ["component", "i", "j", "whole", "first", "rep", "copies", "grams"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, out, held = worker_hashes(), [], 0
        made = lambda: pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
        for b in batches:
            for rep, copies, component, tiles, text in (r for at in range(0, b.num_rows, 64) for r in zip(*(c.to_pylist() for c in b.slice(at, 64).columns))):
                grams = shingles(text, hashes).tobytes()
                own = xxhash.xxh3_64_intdigest(rep.to_bytes(8, "little", signed=True)) % tiles
                for other in range(tiles):
                    out.append((component, min(own, other), max(own, other), tiles == 1, own <= other, rep, copies, grams))
                    held += len(grams)
                    if held > 4_000_000:
                        yield made()
                        out, held = [], 0
        if out:
            yield made()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = 0, []
        told = lambda: pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["rep", "links", "root", "whole"])
        for rows in grouped(batches, 2):
            i, j, whole = rows[0][:3]
            found = verified([r[3:] for r in rows], i == j, threshold)
            out.append((*found, np.full(len(found[0]), whole)))
            held += len(rows)
            if held > 10_000:
                yield told()
                held, out = 0, []
        if out:
            yield told()

    spread_rows = members.select("rep", "copies", "component", "tiles", "text").mapInArrow(spread, "component long, i int, j int, whole boolean, first boolean, rep long, copies long, grams binary")
    dealt = spread_rows.select("component", F.concat_ws(" ", "i", "j").alias("tile"), "i", "j", "whole", "first", "rep", "copies", "grams")
    return dealt.repartition("component", "tile").sortWithinPartitions("component", "tile").mapInArrow(check, "rep long, links long, root long, whole boolean")


def named_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, trees: int) -> tuple[DataFrame, DataFrame]:
    """Settled fingerprints of every document, and (set1, set2, id, rep, root, class_id, n_links) of every class; rep numbers the
    classes in the order of their smallest ids, null last, so that the least of a component is its root."""
    prints = settle(fingerprints(docs, id_col, text_col, trees).withColumn("row", F.monotonically_increasing_id()))
    some = prints.where("n > 0")
    classes = some.groupBy("set1", "set2").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.count("*").alias("copies"))
    classes = classes.orderBy(F.asc_nulls_last("id"), "set1", "set2").withColumn("rep", F.monotonically_increasing_id())
    classes = settle(settle(classes).join(some.select("row", *AT, "n", "signature"), "row").drop("row"))
    found = settle(candidates(classes, threshold, recall, trees))
    own = found.join(classes.select("rep", "n", "copies", *AT), "rep")
    tiles = own.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    members = look_up(own, "component", "rep", tiles).select("rep", *AT, "copies", "component", "tiles")
    texts = docs.select(*identity(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a row may be repeated very often, and one of those is enough
    members = members.join(texts, AT).groupBy("rep", "copies", "component", "tiles").agg(F.first("text").alias("text"))
    checked = settle(verify(members, threshold))
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    split = checked.where("not whole and rep <> root")
    if split.limit(1).count():
        whole = connected_components(split, "rep", "root").withColumnRenamed("node", "rep")
        links = links.join(whole, "rep", "left").withColumn("root", F.coalesce("component", "root")).drop("component")
    links = look_up(settle(links), "root", "rep", classes.select(F.col("rep").alias("root"), F.col("id").alias("class_id")))
    told = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id"))
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    named = classes.join(links, "rep", "left").select("set1", "set2", "id", "rep", F.coalesce("root", "rep").alias("root"), told.alias("class_id"), n_links.alias("n_links"))
    return prints, named


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """id, class_id and n_links of every document."""
    prints, named = named_classes(docs, id_col, text_col, threshold, recall, trees)
    told = prints.where("n > 0").select("id", "set1", "set2").join(named.drop("id"), ["set1", "set2"]).select("id", "class_id", "n_links")
    alone = prints.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return told.unionByName(alone).withColumnRenamed("id", id_col)


def reject(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each connected component the document with the smallest id, null last, then the smallest digest of its text; documents
    without a word all stay, and rows with equal id and text (null or empty) are one."""
    prints, named = named_classes(docs, id_col, text_col, THRESHOLD, RECALL, TREES)
    least = prints.where("n > 0").join(named.select("set1", "set2", "root", "class_id"), ["set1", "set2"]).where(F.col("id").eqNullSafe(F.col("class_id")))
    least = least.groupBy("root").agg(F.min("at1").alias("at1"), *(F.min_by(c, "at1").alias(c) for c in AT[1:]))
    stays = least.select(*AT).unionByName(prints.where("n = 0").select(*AT).distinct())
    names = [free_name(f"__{c}", docs) for c in AT]
    keyed = docs.withColumns(dict(zip(names, identity(id_col, text_col))))
    stays = stays.select(*(F.col(c).alias(k) for c, k in zip(AT, names)))
    return keyed.join(stays, names, "left_semi").dropDuplicates(names).select(*docs.columns)
