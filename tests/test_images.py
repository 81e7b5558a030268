"""Image headers: every format, both byte orders, truncated files, and the landing of uploads."""

import hashlib
import struct
import zlib

import pytest

from tallymill.sources import images, scans


def png(w, h, colour=2, depth=8):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"IDAT", b"x" * 40) + chunk(b"IEND", b"")


def jpeg(w, h, parts=3, before=0):
    segment = lambda marker, data: bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xE2, bytes(60_000)) * before + b"\xff" + segment(0xC2, struct.pack(">BHHB", 8, h, w, parts) + bytes(3 * parts)) + segment(0xDA, bytes(8)) + b"pixels" + b"\xff\xd9"


def bmp(w, h, bits=24):
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + 12, 0, 54, 40, w, -h, 1, bits, 0, 12, 0, 0, 0, 0) + bytes(12)


def tiff(w, h, order="<", photometric=2, samples=3, bits=8, pixels=3000, behind=True):
    """The directory behind the pixels, as scanners write it, or before them; bits and strips lie outside the directory."""
    kinds = {3: "H", 4: "I"}
    many = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * samples), (262, 3, [photometric]), (273, 4, None), (277, 3, [samples]), (279, 4, [pixels // 2] * 2)]
    start = 8 + pixels if behind else 8
    outside = start + 2 + 12 * len(many) + 4
    first = 8 if behind else outside + 64
    many[4] = (273, 4, [first, first + pixels // 2])
    out, rest = struct.pack(f"{order}H", len(many)), b""
    for tag, kind, values in many:
        data = struct.pack(f"{order}{len(values)}{kinds[kind]}", *values)
        if len(data) > 4:
            out += struct.pack(f"{order}HHII", tag, kind, len(values), outside + len(rest))
            rest += data
        else:
            out += struct.pack(f"{order}HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    directory = out + bytes(4) + rest.ljust(64, b"\0")
    begin = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, start)
    return begin + (bytes(pixels) + directory if behind else directory + bytes(pixels))


CASES = {
    "a.png": (png(640, 480), ("PNG", 640, 480, "RGB", None)), "b.png": (png(9, 7, 0, 1), ("PNG", 9, 7, "1", None)), "c.png": (png(9, 7, 6), ("PNG", 9, 7, "RGBA", None)),
    "cut.png": (png(640, 480)[:-4], ("PNG", 640, 480, "RGB", "truncated")), "stub.png": (png(640, 480)[:20], ("PNG", None, None, None, "incomplete header")), "none.png": (png(0, 480), ("PNG", 0, 480, "RGB", "no size")),
    "a.jpg": (jpeg(2000, 900), ("JPEG", 2000, 900, "RGB", None)), "far.jpg": (jpeg(31, 17, 1, 9), ("JPEG", 31, 17, "L", None)), "cut.jpg": (jpeg(31, 17)[:-2], ("JPEG", 31, 17, "RGB", "truncated")),
    "stub.jpg": (jpeg(31, 17)[:22], ("JPEG", None, None, None, "incomplete header")), "a.bmp": (bmp(33, 44), ("BMP", 33, 44, "RGB", None)), "cut.bmp": (bmp(33, 44)[:60], ("BMP", 33, 44, None, "truncated")),
    "le.tif": (tiff(2365, 1087), ("TIFF", 2365, 1087, "RGB", None)), "be.tif": (tiff(2365, 1087, ">", 0, 1, 1), ("TIFF", 2365, 1087, "1", None)), "front.tif": (tiff(80, 60, ">", 1, 1, behind=False), ("TIFF", 80, 60, "L", None)),
    "cut.tif": (tiff(80, 60, "<", 1, 1, behind=False)[:-500], ("TIFF", 80, 60, "L", "truncated")), "lost.tif": (tiff(80, 60)[:-100], ("TIFF", None, None, None, "incomplete header")), "stub.tif": (b"II*\0\xff\xff\xff\x00", ("TIFF", None, None, None, "incomplete header")),
    "text.png": (b"not an image", (None, None, None, None, "unknown format")), "empty.png": (b"", (None, None, None, None, "empty file")),
}


def test_headers(spark):
    df = spark.createDataFrame([(n, bytearray(c), "x") for n, (c, _) in CASES.items()] + [("null.png", None, "x")], "name string, content binary, length string")
    got = {r["name"]: (r["format"], r["width"], r["height"], r["mode"], r["fault"]) for r in images.facts(df).collect()}
    assert got == {n: want for n, (_, want) in CASES.items()} | {"null.png": (None, None, None, None, "empty file")}
    assert images.facts(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(CASES))
def test_no_cut_breaks_the_reader(name):
    """Whatever of a file is missing, the reader tells a fault or the file's own facts."""
    whole, want = CASES[name]
    for n in range(0, min(len(whole), 400), 3):
        c = whole[:n]
        at = int.from_bytes(c[4:8], "little" if c[:2] == b"II" else "big") if c[:2] in (b"II", b"MM") and len(c) >= 8 else None
        told = images.header(c[: images.HEAD], at, c[at:] if at and at <= n else b"", c[-images.TAIL :], n)
        assert told[4] is not None or told[1:4] == want[1:4]


def test_scanned_folder(spark, tmp_path):
    (tmp_path / "Scan 1.tif").write_bytes(CASES["be.tif"][0])
    (tmp_path / ".hidden.tif").write_bytes(CASES["be.tif"][0])
    (tmp_path / "other.png").write_bytes(CASES["a.png"][0])
    rows = scans.image_files(spark, str(tmp_path)).collect()
    assert [(r["sample_id"], r["width"], r["height"], r["mode"], r["fault"]) for r in rows] == [("scan_1", 2365, 1087, "1", None)]


def test_landing(spark):
    files = [(n, bytearray(c)) for n, (c, _) in CASES.items()] + [("z copy.png", bytearray(CASES["a.png"][0])), ("a.exe", bytearray(CASES["a.png"][0])), ("known.jpg", bytearray(CASES["a.jpg"][0] + b"\0"))]
    df = spark.createDataFrame(files, "name string, content binary")
    known = spark.createDataFrame([(hashlib.sha256(files[-1][1]).hexdigest(),)], "image_hash string")
    new, old, bad = ({r["name"] for r in t.collect()} for t in scans.landed(df, known))
    good = {n for n, (_, w) in CASES.items() if w[4] is None and w[1] >= 200 and w[2] >= 100}
    assert new == good and old == {"z copy.png", "known.jpg"}
    assert bad == CASES.keys() - good | {"a.exe"}
    reasons = {r["name"]: r["reject_reason"] for r in scans.landed(df, known)[2].collect()}
    assert (reasons["cut.png"], reasons["empty.png"], reasons["b.png"]) == ("Invalid or corrupted image data: truncated", "EMPTY_FILE", "TOO_SMALL")
