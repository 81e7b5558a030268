"""What an image file's header says: format, size and colour mode, or what is wrong with it. No pixel is decoded.

A header lies behind offsets: a TIFF file names the place of its directory in either byte order, a JPEG file strings segments
together up to its frame. So a bounded piece of each file is cut out by Spark (the beginning, the directory, the end), and a helper
follows the offsets within these pieces, batch by batch. A file is at fault if it is of no known format, its header is not
whole, its size is none, its pixels would lie beyond its end, or its end mark is missing.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a beginning in which a JPEG frame is looked for (segments before it have 64 KiB at most each), of others, of a
#: TIFF directory with what it refers to, and of an end.
JPEG_HEAD, HEAD, DIRECTORY, TAIL = 1 << 20, 64, 1 << 16, 64

#: Fixed values of the formats: signatures, colour types and tags.
PNG_SIGNATURE, PNG_END = b"\x89PNG\r\n\x1a\n", b"IEND\xaeB`\x82"
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
JPEG_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
TIFF_WIDTH, TIFF_HEIGHT, TIFF_BITS, TIFF_PHOTOMETRIC, TIFF_STRIPS, TIFF_SAMPLES, TIFF_COUNTS = 256, 257, 258, 262, 273, 277, 279
TIFF_TILES, TIFF_TILE_COUNTS = 324, 325
TIFF_SIZES = {1: 1, 3: 2, 4: 4}

Facts = tuple[str | None, int | None, int | None, str | None, str | None]


def facts(files: DataFrame, content: str = "content", length: str = "length") -> DataFrame:
    """Adds format, width, height, mode and fault (null if there is none). A null or empty content is at fault."""
    c = F.col(content)
    first = lambda n: F.substring(c, 1, n)
    hexed = F.hex(F.substring(c, 5, 4))
    turned = F.concat(*[F.substr(hexed, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)])
    little, tiff = first(2) == F.lit(b"II"), first(2).isin(F.lit(b"II"), F.lit(b"MM"))
    at = F.when(tiff, F.conv(F.when(little, turned).otherwise(hexed), 16, 10).cast("long"))
    whole = F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    head = F.when(first(2) == F.lit(b"\xff\xd8"), first(JPEG_HEAD)).otherwise(first(HEAD))
    directory = F.when(at.between(8, whole), F.substr(c, (at + 1).cast("int"), F.lit(DIRECTORY)))
    tail = F.substr(c, F.greatest(F.lit(1), whole - TAIL + 1).cast("int"), F.lit(TAIL))
    pieces = files.withColumn("__pieces", F.struct(head.alias("head"), at.alias("at"), directory.alias("directory"), tail.alias("tail"), whole.alias("length")))
    kept = [x for x in files.columns if x != content]
    names = ["format", "width", "height", "mode", "fault"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            told = [header(p["head"] or b"", p["at"], p["directory"] or b"", p["tail"] or b"", p["length"]) for p in b.column(len(kept)).to_pylist()]
            columns = list(zip(*told)) or [()] * 5
            yield pa.record_batch([*b.columns[:-1], *[pa.array(v, t) for v, t in zip(columns, types)]], [*kept, *names])

    rows = pieces.select(*kept, "__pieces")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__pieces"), "format string, width int, height int, mode string, fault string"])
    return rows.mapInArrow(read, schema)


def header(head: bytes, at: int | None, directory: bytes, tail: bytes, length: int) -> Facts:
    """(format, width, height, mode, fault) of one file, from its pieces."""
    for mark, name, reader in FORMATS:
        if head.startswith(mark):
            try:
                width, height, mode, fault = reader(head, at or 0, directory, tail, length)
            except (struct.error, IndexError):
                return name, None, None, None, "incomplete header"
            if fault is None and (width <= 0 or height <= 0):
                fault = "no size"
            return name, width, height, mode, fault
    return None, None, None, None, "empty file" if not length else "unknown format"


def _png(head: bytes, at: int, directory: bytes, tail: bytes, length: int) -> tuple:
    size, kind, width, height, depth, colour = struct.unpack_from(">I4sIIBB", head, 8)
    if kind != b"IHDR" or size != 13 or colour not in PNG_MODES:
        return None, None, None, "incomplete header"
    mode = {1: "1", 16: "I;16"}.get(depth, "L") if colour == 0 else PNG_MODES[colour]
    return width, height, mode, None if tail.endswith(PNG_END) else "truncated"


def _jpeg(head: bytes, at: int, directory: bytes, tail: bytes, length: int) -> tuple:
    place = 2
    while True:
        while head[place] == 0xFF and head[place + 1] == 0xFF:  # fill bytes
            place += 1
        if head[place] != 0xFF:
            return None, None, None, "incomplete header"
        marker = head[place + 1]
        if marker in JPEG_FRAMES:
            _, height, width, parts = struct.unpack_from(">xBHHB", head, place + 3)
            return width, height, JPEG_MODES.get(parts), None if tail.rstrip(b"\0").endswith(b"\xff\xd9") else "truncated"
        if marker in (0xD9, 0xDA):  # pixels, or the end, before any frame
            return None, None, None, "incomplete header"
        place += 2 if marker == 1 or 0xD0 <= marker <= 0xD8 else 2 + struct.unpack_from(">H", head, place + 2)[0]


def _bmp(head: bytes, at: int, directory: bytes, tail: bytes, length: int) -> tuple:
    told, _, pixels, size, width, height, _, bits = struct.unpack_from("<IIIIiiHH", head, 2)
    if size < 40 or pixels > length or (told and told > length):
        return width, abs(height), None, "truncated" if size >= 40 else "incomplete header"
    return width, abs(height), {1: "1", 24: "RGB", 32: "RGB"}.get(bits, "P"), None


def _tiff(head: bytes, at: int, directory: bytes, tail: bytes, length: int) -> tuple:
    order = "<" if head[:2] == b"II" else ">"
    if struct.unpack_from(f"{order}H", head, 2)[0] != 42 or not directory:
        return None, None, None, "incomplete header"
    entries = {}
    for k in range(struct.unpack_from(f"{order}H", directory)[0]):
        tag, kind, count = struct.unpack_from(f"{order}HHI", directory, 2 + 12 * k)
        entries[tag] = kind, count, 2 + 12 * k + 8

    def values(tag: int, default: list[int]) -> list[int] | None:
        """None where they lie outside the piece."""
        if tag not in entries or entries[tag][0] not in TIFF_SIZES:
            return default
        kind, count, place = entries[tag]
        if TIFF_SIZES[kind] * count > 4:
            place = struct.unpack_from(f"{order}I", directory, place)[0] - at
            if place < 0 or place + TIFF_SIZES[kind] * count > len(directory):
                return None
        return list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", directory, place))

    (width,), (height,) = values(TIFF_WIDTH, [0]), values(TIFF_HEIGHT, [0])
    bits, samples, photometric = values(TIFF_BITS, [1]) or [8], values(TIFF_SAMPLES, [1])[0], values(TIFF_PHOTOMETRIC, [1])[0]
    grey = {1: "1", 16: "I;16"}.get(bits[0], "L")
    mode = {0: grey, 1: grey if samples == 1 else "LA", 2: "RGB" if samples == 3 else "RGBA", 3: "P", 5: "CMYK", 6: "RGB"}.get(photometric)
    tiled = TIFF_TILES in entries
    starts, counts = values(TIFF_TILES if tiled else TIFF_STRIPS, []), values(TIFF_TILE_COUNTS if tiled else TIFF_COUNTS, [])
    beyond = starts is not None and counts is not None and any(s + n > length for s, n in zip(starts, counts))
    if not beyond and starts == []:
        return width, height, mode, "no pixels"
    return width, height, mode, "truncated" if beyond else None


FORMATS: list[tuple[bytes, str, Callable[..., tuple]]] = [(PNG_SIGNATURE, "PNG", _png), (b"\xff\xd8", "JPEG", _jpeg), (b"BM", "BMP", _bmp), (b"II", "TIFF", _tiff), (b"MM", "TIFF", _tiff)]


def fault_reason(fault: Column) -> Column:
    return F.when(fault.isNotNull(), F.concat(F.lit("Invalid or corrupted image data: "), fault))
