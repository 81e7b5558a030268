"""Image headers read from bytes that Spark writes out of the driver's keys, held against the sizes that SQL works out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import spread
from ..sources import images
from .slate import slate


def _hex(x: Column, digits: int, little: bool = False) -> Column:
    told = F.lpad(F.hex(x), digits, "0")
    return F.concat(*[F.substr(told, F.lit(k), F.lit(2)) for k in range(digits - 1, 0, -2)]) if little else told


def _entry(tag: int, kind: int, value: Column, little: bool) -> Column:
    """A directory entry with one value; a short fills the first half of its place."""
    held = F.rpad(_hex(value, 4, little), 8, "0") if kind == 3 else _hex(value, 8, little)
    return F.concat(_hex(F.lit(tag), 4, little), _hex(F.lit(kind), 4, little), _hex(F.lit(1), 8, little), held)


def _tiff(w: Column, h: Column, little: bool) -> Column:
    """Sixteen bytes of pixels, then the directory."""
    n = lambda x: F.lit(x)
    entries = [(256, 4, w), (257, 4, h), (258, 3, n(8)), (262, 3, n(1)), (273, 4, n(8)), (277, 3, n(1)), (279, 4, n(16))]
    start = F.concat(F.lit("49492A00" if little else "4D4D002A"), _hex(n(24), 8, little), F.lit("00" * 16), _hex(n(len(entries)), 4, little))
    return F.concat(start, *[_entry(*e, little) for e in entries], F.lit("00000000"))


@slate("""SELECT c_custkey AS sample_id, CASE k WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'TIFF' WHEN 3 THEN 'TIFF' END AS format, CAST(CASE WHEN k < 4 THEN w END AS INTEGER) AS width,
    CAST(CASE WHEN k < 4 THEN h END AS INTEGER) AS height, CASE k WHEN 0 THEN 'RGB' WHEN 1 THEN 'L' WHEN 2 THEN 'L' WHEN 3 THEN 'L' END AS mode, CASE WHEN k = 4 THEN 'unknown format' WHEN k < 2 AND c_custkey % 7 = 0 THEN 'truncated' END AS fault
    FROM (SELECT c_custkey, c_custkey % 5 AS k, 200 + c_custkey % 3000 AS w, 100 + c_custkey * 7 % 2000 AS h FROM customer)""")
def image_facts(customer):
    k, w, h = F.col("c_custkey"), 200 + F.col("c_custkey") % 3000, 100 + F.col("c_custkey") * 7 % 2000
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8), F.lit("0802000000" + "00000000" + "0000000049454E44AE426082"))
    jpeg = F.concat(F.lit("FFD8FFE00004ABCDFFC0000B08"), _hex(h, 4), _hex(w, 4), F.lit("01011100FFDA0008000000000000AAFFD9"))
    whole = F.when(k % 5 == 0, png).when(k % 5 == 1, jpeg).when(k % 5 == 2, _tiff(w, h, True)).when(k % 5 == 3, _tiff(w, h, False)).otherwise(F.hex(F.col("c_name")))
    # every seventh lacks its end
    held = F.when((k % 7 == 0) & (k % 5 < 2), F.substr(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)
    return images.facts(spread(customer).select(k.alias("sample_id"), F.unhex(held).alias("content")))
