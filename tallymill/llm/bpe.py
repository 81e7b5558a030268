"""Byte-level BPE over Arrow batches: ids with byte and character offsets, and back.

Null text is encoded as empty text: no ids. Null ids decode to no bytes. Empty tables and repeated rows pass through. All
columns of the input are kept except those that the operator writes (ids, byte_ends, char_starts, char_ends, decoded), which
it replaces.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import pieces, read_ranks, vocabulary_path
from .tables import free_name, map_parts

_BYTES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte table: where each id's bytes begin, how many there are, and all bytes."""
    if path not in _BYTES:
        by_id = {i: x for x, i in read_ranks(path).items()}
        table = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        _BYTES[path] = np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(table), np.uint8)
    return _BYTES[path]


def offsets(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends in bytes, and the characters that each id touches: [start, end). Ids that share a character both have it."""
    ends = np.cumsum(sizes[ids])
    of_byte = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # the number of the character that holds each byte, from 1
    return ends, of_byte[ends - sizes[ids]] - 1, of_byte[ends - 1]


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def split(column: pa.ListArray) -> list[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[x:y] for x, y in zip(at[:-1], at[1:])]


def encode(df: DataFrame, ranks: str, pattern: str, text_col: str = "text", with_offsets: bool = True, packed: bool = False) -> DataFrame:
    """Adds ids array<int>, or packed: binary, little-endian unsigned 32-bit integers; with offsets also byte_ends,
    char_starts and char_ends. Special strings are ordinary text."""
    path = vocabulary_path(ranks)
    added = ["ids", *(["byte_ends", "char_starts", "char_ends"] if with_offsets else [])]
    kept = [c for c in df.columns if c not in added and c != text_col]
    held = free_name("__text", df)
    base = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias(held))
    names = base.columns

    def make():
        vocabulary, (_, sizes, _) = pieces(path, pattern), piece_bytes(path)

        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(b.num_columns - 1).to_pylist()
            ids = list(vocabulary.of(texts))
            columns = [pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()) if packed else lists(ids, pa.int32())]
            if with_offsets:
                columns += [lists(list(x), pa.int32()) for x in zip(*(offsets(t, i, sizes) for t, i in zip(texts, ids)))]
            return pa.record_batch([*b.columns, *columns], [*names, *added])

        return part

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + [f"{c} {'binary' if packed and c == 'ids' else 'array<int>'}" for c in added])
    out = map_parts(base, make, schema)
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(held).alias(text_col), *added)


def decode(df: DataFrame, ranks: str, ids_col: str = "ids", out_col: str = "decoded", text: bool = False) -> DataFrame:
    """Adds the bytes of the ids (array<int> or packed); with ``text`` the characters, U+FFFD for bytes that make none. Unknown
    ids are an error."""
    path = vocabulary_path(ranks)
    packed = df.schema[ids_col].dataType.simpleString() == "binary"
    kept = [c for c in df.columns if c not in (out_col, ids_col)]
    base = df.select(*[F.col(f"`{c}`") for c in kept], F.col(ids_col))
    names = base.columns

    def make():
        starts, sizes, table = piece_bytes(path)

        def joined(ids: np.ndarray) -> bytes:
            n = sizes[ids]
            ends = np.cumsum(n)
            return table[np.repeat(starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

        def part(b: pa.RecordBatch) -> pa.RecordBatch:
            column = b.column(b.num_columns - 1)
            ids = [np.frombuffer(x or b"", "<u4") for x in column.to_pylist()] if packed else split(column.fill_null([]))
            out = [joined(x) for x in ids]
            made = pa.array([x.decode(errors="replace") for x in out], pa.string()) if text else pa.array(out, pa.binary())
            return pa.record_batch([*b.columns, made], [*names, out_col])

        return part

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema], f"{out_col} {'string' if text else 'binary'}"])
    return map_parts(base, make, schema)


class StreamDecoder:
    """Text from ids that arrive in parts: bytes of a character that is split between parts wait for the rest."""

    def __init__(self, ranks: str):
        self.starts, self.sizes, self.table = piece_bytes(vocabulary_path(ranks))
        self.waiting = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.waiting.decode(b"".join(self.table[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes() for i in ids), last)
