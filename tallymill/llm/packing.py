"""Packing documents into sequences: first-fit decreasing in randomised groups, with a tournament tree of bin capacities.

Every document's ids, with the end id, are cut into pieces of the sequence length and a remainder. Pieces are dealt at
random into groups of bounded size; each group packs its own, longest first, each into the first bin that has room. The
tree's root path finds that bin in logarithmic time. Only lengths are shuffled, never ids. The pieces are written to the
shared folder first, so their numbers, which deal them, are the same whenever a task is repeated.

Null text is empty: one piece with the end id. Repeated rows are packed each; ties in length go by piece number. An empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import pieces, vocabulary_path
from .tables import map_parts, settle


def cut(docs: DataFrame, vocabulary: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: id, start, length, ids_crc32, doc_tokens."""
    path = vocabulary_path(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make():
        vocab, end = pieces(path), np.array([end_id], "<u4")

        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            row, start, size, crc, total = [], [], [], [], []
            for i, ids in enumerate(vocab.of(b.column(1).to_pylist())):
                ids = np.concatenate((ids.astype("<u4"), end))
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    row.append(i)
                    start.append(at)
                    size.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids))
            return pa.record_batch([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["__id", "start", "length", "ids_crc32", "doc_tokens"])

        return part

    return map_parts(base, make, f"__id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each size, in the given order, and its offset there. Sizes are at most the capacity.

    A tree over as many bins as sizes: a node has the largest room below it. The first bin with room is found by going left
    wherever the left has enough."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            node += room[node] < size
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, end_id: int, length: int = 4096, group_pieces: int = 16384, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    cuts = settle(cut(docs, vocabulary, end_id, length, id_col, text_col))
    groups = max(1, -(-cuts.count() // group_pieces))
    dealt = numbered(cuts).withColumn("__group", F.pmod(F.xxhash64("__number", F.lit(seed)), F.lit(groups)))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__number"], ascending=[False, True], kind="stable")
        bins, at = first_fit(pdf["length"].tolist(), length)
        return pdf.drop(columns=["__number", "__group"]).assign(sequence_id=np.array(bins, np.int64) + (int(key[0]) << 32), offset=np.array(at, np.int64))

    out = dealt.groupBy("__group").applyInPandas(packed, f"__id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("__id", id_col)


def numbered(written: DataFrame) -> DataFrame:
    """Numbers the rows of a written table; its files do not change, so neither do the numbers."""
    return written.withColumn("__number", F.monotonically_increasing_id())
