"""Ranked lexical search: each item's best documents by a saturating term score, found by a search through two trees at once.

Items and documents are sparse rows: an item has the weights of its terms, a document its terms' saturated frequencies, and a
score is their inner product. A tree over items and one over the documents of a chunk hold, for every node, the largest value
of each term below it, so the product of two nodes' maxima bounds the score of every pair below them. Pairs of nodes are
followed from the roots down, and a pair goes as soon as its bound is below the weakest k-th score that any of its items has
by then: whole batches of pairs, exactly. The k-th scores start from those of a bounded sample of the documents, which no
final one can be below; the search then meets every document.

Items come in blocks of bounded size, each against all documents. For a block, one pass over the texts keeps the frequencies of
the block's terms, as a written table; counts follow from it, and a second pass over that table searches. A task returns at most
k documents an item.

A term is a maximal run of what is neither ASCII punctuation, white space nor control, with A-Z lower-cased; it is found in whole
texts of any length. A null or empty text has no terms and scores nothing. Rows with one item id, null ids among them, are one
item with the terms of all; repeated document rows count each. Equal scores go by the smaller document id, null last. An empty
table on either side gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import first_hashes, map_parts, settle

#: Items and terms of a block; documents and values of a chunk; rows of a leaf; documents whose scores start the search.
BLOCK_ITEMS, BLOCK_TERMS = 512, 20_000
CHUNK_ROWS, CHUNK_VALUES = 4096, 2_000_000
LEAF_ITEMS, LEAF_DOCS = 4, 16
SAMPLE = 8_000
#: Parts in which an item's rows are ranked before they meet.
PARTS = 64

#: Bytes outside terms become blanks, A-Z become a-z; bytes of longer characters stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term), each pair once."""

    def make():
        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            own = [sorted(set(terms_of(t or b""))) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(own)), [len(t) for t in own])
            return pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array([t for ts in own for t in ts], pa.binary())], ["item", "term"])

        return part

    return map_parts(items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("t")), make, "item long, term binary").distinct()


def frequencies(docs: DataFrame, doc_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """(doc, n, terms, tfs) of documents with terms: how many they are, and the numbers and frequencies of those of the vocabulary."""

    def make():
        number = {t: i for i, t in enumerate(vocabulary)}.get

        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            counts, terms, tfs, sizes = [], [], [], []
            for text in b.column(1).to_pylist():
                words = terms_of(text or b"")
                found = Counter(map(number, words))
                found.pop(None, None)
                counts.append(len(words))
                terms += found.keys()
                tfs += found.values()
                sizes.append(len(found))
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (terms, tfs)]
            return pa.record_batch([b.column(0), pa.array(counts, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

        return part

    rows = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("t"))
    return map_parts(rows, make, "doc long, n long, terms array<int>, tfs array<int>").where("n > 0")


class Rows:
    """Sparse rows: row r has the values ``values[ends[r] : ends[r + 1]]`` of the terms ``terms[...]``."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int):
        self.ends, self.terms, self.values, self.width = ends, terms, values, width

    def __len__(self) -> int:
        return len(self.ends) - 1

    def of(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[self.ends[r] : self.ends[r + 1]], self.values[self.ends[r] : self.ends[r + 1]]

    def spread(self, rows: np.ndarray, seed: int, rounds: int = 3) -> np.ndarray:
        """A number for each of some rows, near to each other for rows that share terms: power iteration from random ones towards
        the direction in which rows of equal length differ most."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        at = np.repeat(self.ends[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        owner, terms, values = np.repeat(np.arange(len(rows)), sizes), self.terms[at], self.values[at].astype(float)
        sums = lambda v: np.bincount(owner, weights=v, minlength=len(rows))
        values /= np.maximum(np.sqrt(sums(values * values)), 1e-9)[owner]
        s = np.random.default_rng(seed).normal(size=len(rows))
        for _ in range(rounds):
            s = sums(values * np.bincount(terms, weights=values * s[owner], minlength=self.width)[terms])
            s = s - s.mean()
            s = s / max(float(np.abs(s).max(initial=0)), 1e-9)
        return s


class Tree:
    """A balanced tree of two to a node: rows that are alike lie together, and each node has its rows' largest values by term.

    Level h has 2**h nodes; ``order`` lists the rows leaf by leaf, and the leaf i has ``order[cuts[i] : cuts[i + 1]]``."""

    def __init__(self, rows: Rows, leaf: int):
        self.height = max(0, math.ceil(math.log2(max(1, len(rows)) / leaf)))
        self.order, self.cuts = np.arange(len(rows)), np.array([0, len(rows)])
        for _ in range(self.height):
            cuts = [0]
            for lo, hi in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
                own = self.order[lo:hi]
                self.order[lo:hi] = own[np.argsort(rows.spread(own, lo), kind="stable")]
                cuts += [(lo + hi) // 2, hi]
            self.cuts = np.array(cuts)
        sizes = np.diff(rows.ends)[self.order]
        leaf_of = np.repeat(np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts)), sizes)
        at = np.repeat(rows.ends[:-1][self.order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        level = np.zeros((len(self.cuts) - 1, rows.width), np.float32)
        np.maximum.at(level, (leaf_of, rows.terms[at]), rows.values[at].astype(np.float32))
        self.levels = [level]
        while len(self.levels[0]) > 1:
            self.levels.insert(0, np.maximum(self.levels[0][0::2], self.levels[0][1::2]))


class Best:
    """The best k documents of each item so far, and the score that a document must reach to matter."""

    def __init__(self, items: int, k: int, least: list[int]):
        self.k, self.found = k, [[] for _ in range(items)]
        #: what is known from elsewhere; a document with exactly this score still matters, by its id
        self.weakest = np.array(least, np.int64)

    def add(self, item: int, scores: np.ndarray, docs: list[tuple[bool, int]]) -> None:
        better = np.flatnonzero(scores >= self.weakest[item])
        if len(better):
            found = sorted(self.found[item] + [(-int(scores[j]), docs[j]) for j in better.tolist()])[: self.k]
            self.found[item] = found
            if len(found) == self.k:
                self.weakest[item] = max(self.weakest[item], -found[-1][0])


def dual_search(items: Rows, item_tree: Tree, docs: Rows, ids: list[tuple[bool, int]], best: Best) -> int:
    """Adds the documents' scores to ``best``; returns how many pairs were scored."""
    doc_tree = Tree(docs, LEAF_DOCS)
    # sums of non-negative singles are right to this share
    slack = np.float32(1 + (items.width + 8) * 2.0**-23)
    pairs, bounds = np.zeros((1, 2), int), np.full(1, np.inf, np.float32)
    for depth in range(max(item_tree.height, doc_tree.height) + 1):
        a, b = min(depth, doc_tree.height), min(depth, item_tree.height)
        if depth:
            pairs = np.concatenate([np.stack((pairs[:, 0] * (2 if a == depth else 1) + i, pairs[:, 1] * (2 if b == depth else 1) + j), axis=1) for i in range(1 + (a == depth)) for j in range(1 + (b == depth))])
        weakest = best.weakest[item_tree.order]
        edges = item_tree.cuts[:: 1 << (item_tree.height - b)].tolist()
        least = np.array([weakest[lo:hi].min(initial=np.iinfo(np.int64).max) for lo, hi in zip(edges[:-1], edges[1:])])
        table = (doc_tree.levels[a] @ item_tree.levels[b].T) * slack
        bounds = table[pairs[:, 0], pairs[:, 1]]
        kept = bounds >= least[pairs[:, 1]]
        pairs, bounds = pairs[kept], bounds[kept]
    scored = 0
    leaves: dict[int, tuple] = {}
    # the pairs that promise most come first, so that the others meet higher k-th scores
    for p in np.argsort(-bounds, kind="stable").tolist():
        d, i = pairs[p].tolist()
        own = [x for x in item_tree.order[item_tree.cuts[i] : item_tree.cuts[i + 1]].tolist() if bounds[p] >= best.weakest[x]]
        if not own:
            continue
        if d not in leaves:
            rows = doc_tree.order[doc_tree.cuts[d] : doc_tree.cuts[d + 1]].tolist()
            block = np.zeros((len(rows), docs.width), np.int64)
            for j, r in enumerate(rows):
                terms, values = docs.of(r)
                block[j, terms] = values
            leaves[d] = block, [ids[r] for r in rows]
            if len(leaves) > 64:
                leaves.pop(next(iter(leaves)))
        block, names = leaves[d]
        for x in own:
            terms, weights = items.of(x)
            best.add(x, block[:, terms] @ weights, names)
            scored += len(names)
    return scored


def searched(matched: DataFrame, items: Rows, n_docs: int, n_terms: int, k: int, least: list[int]) -> DataFrame:
    """(item, doc, score): the k best documents of each item in each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, best = Tree(items, LEAF_ITEMS), Best(len(items), k, least)
        for batch in batches:
            sizes = np.asarray(batch.column("terms").value_lengths())
            at = 0
            while at < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(sizes[at : at + CHUNK_ROWS]), CHUNK_VALUES, side="right"))
                b = batch.slice(at, max(1, room))
                at += b.num_rows
                own = np.asarray(b.column("terms").value_lengths())
                lengths = [10 + 90 * n * n_docs // n_terms for n in b.column("n").to_pylist()]
                tf = np.asarray(b.column("tfs").flatten()).astype(np.int64)
                values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(lengths, np.int64), own))
                rows = Rows(np.concatenate(([0], np.cumsum(own))), np.asarray(b.column("terms").flatten()), values, items.width)
                dual_search(items, tree, rows, [(d is None, d or 0) for d in b.column("doc").to_pylist()], best)
        out = [(x, None if d[0] else d[1], -s) for x, found in enumerate(best.found) for s, d in found]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc", "score"])

    return matched.select("doc", "n", "terms", "tfs").mapInArrow(task, "item int, doc long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item with their rank; an item's rows meet in parts first."""
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    part = F.pmod(F.xxhash64("doc"), F.lit(PARTS))
    few = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def block_search(block: dict[int | None, list[bytes]], docs: DataFrame, doc_col: str, text_col: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for terms in block.values() for t in terms})
    matched = settle(frequencies(docs, doc_col, text_col, vocabulary))
    n_docs, n_terms = matched.agg(F.count("*"), F.sum("n")).first()
    # no more rows than the block has terms
    df = {r["term"]: r["df"] for r in matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) for i, t in enumerate(vocabulary) if i in df}
    number = {t: i for i, t in enumerate(vocabulary)}
    named = sorted(block, key=lambda x: (x is None, x or 0))
    told = [[t for t in block[x] if weight.get(t)] for x in named]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in told])))
    items = Rows(ends, np.array([number[t] for ts in told for t in ts], np.int64), np.array([weight[t] for ts in told for t in ts], np.int64), len(vocabulary))

    # what a sample reaches, no final k-th score is below
    one = [1] * len(named)
    sample = first_hashes(matched.withColumn("h", F.xxhash64("doc", "n", F.lit("sample"))), "h", SAMPLE, n_docs).drop("h")
    reached = ranked(searched(sample, items, n_docs, n_terms, k, one), k).where(F.col("rank") == k).select("item", "score").collect() if len(vocabulary) and n_docs > 2 * SAMPLE else []
    for r in reached:
        one[r["item"]] = r["score"]
    found = ranked(searched(matched, items, n_docs, n_terms, k, one), k)
    names = spark.createDataFrame(list(enumerate(named)), "item int, item_id long")
    # at most BLOCK_ITEMS rows or so
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), F.col("doc").alias("doc_id"), "score")


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0."""
    terms = settle(item_terms(items, item_col, text_col).withColumn("h", F.xxhash64("item")))
    n_items, n_terms = terms.select(F.count_distinct("h"), F.count("*")).first()
    blocks = max(1, math.ceil(n_items / BLOCK_ITEMS), math.ceil(n_terms / BLOCK_TERMS))
    found = []
    for i in range(blocks):
        block: dict[int | None, list[bytes]] = {}
        for r in terms.where(F.pmod("h", F.lit(blocks)) == i).select("item", "term").collect():
            block.setdefault(r["item"], []).append(bytes(r["term"]))
        if block:
            found.append(settle(block_search(block, docs, doc_col, text_col, k)) if blocks > 1 else block_search(block, docs, doc_col, text_col, k))
    if not found:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(doc_col), "score")
