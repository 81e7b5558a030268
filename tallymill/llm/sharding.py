"""Minimax contiguous sharding by bytes, natively: the smallest capacity that holds ordered atomic groups in so many shards.

A group is all rows with one text hash (equal texts always share it), and groups are ordered by that hash. The search runs
on sums: a histogram over ranges of the hash is all that reaches the driver, of a size that does not depend on the data.
Capacities are tried by binary search, each checked greedily over the sums; where a cut could fall inside a range, that
range alone is summed again, finer, until every cut falls between groups; groups known by then bound the capacity from
below, so those ranges stay few, whatever large groups there are. So the capacity is exactly the smallest, and the
cuts that keep it are taken as near to equal shares as groups allow. A group larger than an equal share of what is left is a
shard of its own (there are fewer of those than shards) and the rest is cut as described.

Null text is a group of its own: no bytes, checksum 0. Empty tables give an empty table; with fewer groups than shards some
shards stay empty; repeated rows each get a slot, in a row. Other columns are ignored. A text of any length is read once, for its
size, checksum and hash. Slots follow cells by a hash of id and text, so one id, null ids included, is spread like many.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import settle

#: Bits of the hash that the first histogram leaves out, how many more each finer one has, spans of hashes that are summed
#: again at once, how many times the mean a range that stands out has, rows in a cell of slots, and rows alike that are made at once.
FIRST_BITS, FINER_BITS, SPANS, OUTSTANDING, CELL_ROWS, PIECE_ROWS = 48, 8, 64, 8, 4096, 65536


@dataclass
class Range:
    """Hashes from low to high, both of which occur."""

    low: int
    high: int
    size: int
    rows: int
    bits: int

    @property
    def single(self) -> bool:
        return self.low == self.high


def histogram(rows: DataFrame, spans: list[tuple[int, int, int]] | None = None) -> list[Range]:
    """Ranges of the hash without its last FIRST_BITS bits, or of the spans (low, high, bits left out) alone."""
    bits = F.lit(FIRST_BITS)
    if spans is not None:
        bits = F.when(F.lit(False), bits)
        for low, high, left_out in spans:
            bits = bits.when(F.col("hash").between(low, high), F.lit(left_out))
    found = rows.withColumn("bits", bits).where("bits is not null").groupBy("bits", F.call_function("shiftright", "hash", "bits")).agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum("size").alias("size"), F.count("*").alias("rows"))
    return sorted((Range(r["low"], r["high"], r["size"], r["rows"], r["bits"]) for r in found.select("low", "high", "size", "rows", "bits").collect()), key=lambda x: x.low)


def greedy(upto: list[int], capacity: int, most: int) -> list[int] | None:
    """Latest cuts with at most so much in each shard, as numbers of ranges; None if more shards than ``most`` are needed."""
    cuts, at = [], 0
    while at < len(upto) - 1:
        after = bisect_right(upto, upto[at] + capacity) - 1
        if after == at or len(cuts) == most:
            return None
        cuts.append(at := after)
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    upto = [0, *accumulate(sizes)]
    low, high = max([-(-upto[-1] // shards), *sizes]), upto[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(upto, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def least_capacity(ranges: list[Range], shards: int, high: int) -> int:
    """No smaller capacity can do, however the groups of a range of several may lie: those are cut anywhere, single ones never."""
    upto = [0, *accumulate(r.size for r in ranges)]
    low = max([-(-upto[-1] // shards), *(r.size for r in ranges if r.single)])
    while low < high:
        middle, at = (low + high) // 2, 0
        for _ in range(shards):
            at = min(at + middle, upto[-1])
            i = bisect_right(upto, at) - 1
            if at < upto[-1] and ranges[i].single:
                at = upto[i]
        low, high = (low, middle) if at == upto[-1] else (middle + 1, high)
    return low


def unsure(ranges: list[Range], shards: int) -> list[Range]:
    """Ranges of several groups in which a latest cut could fall, for some capacity that may still be the smallest.

    Where the j-th cut can lie is held as spans of bytes, not as one from first to last: a capacity near the smallest may end
    a shard before or after a large group, and neither way leads between. Spans from which the rest cannot be held are left."""
    sizes = [r.size for r in ranges]
    upto, n = [0, *accumulate(sizes)], len(ranges)
    total, high = upto[-1], smallest_capacity(sizes, shards)
    low = least_capacity(ranges, shards, high)
    if low >= high:
        return []
    needed, at = [0] * shards, total
    for j in range(shards - 1, 0, -1):
        at = max(0, at - high)
        i = bisect_right(upto, at) - 1
        if upto[i] < at and ranges[i].single:
            at = upto[i + 1]
        needed[j] = at
    found: set[int] = set()
    spans = [(0, 0)]
    for j in range(1, shards):
        ends = []
        for a, b in spans:
            a, b = min(a + low, total), min(b + high, total)
            for i in range(bisect_right(upto, a) - 1, bisect_right(upto, b)):
                inside = i < n and b > upto[i] and not ranges[i].single
                end = min(b, upto[i + 1]) if inside else upto[i]
                if end >= needed[j]:
                    ends.append((max(upto[i], needed[j]), end))
                    if inside:
                        found.add(i)
        spans = []
        for a, b in sorted(ends):
            # as near as this, both lead on to spans that overlap
            if spans and a - spans[-1][1] <= high - low:
                spans[-1] = spans[-1][0], max(b, spans[-1][1])
            else:
                spans.append((a, b))
    # the largest keep the bounds apart: while some stand out (a large group among others), they alone come first
    mean = sum(ranges[i].size for i in found) / len(found)
    return [ranges[i] for i in sorted({i for i in found if ranges[i].size > OUTSTANDING * mean} or found)]


def earliest_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """By shard the fewest ranges that must lie before it, so that it and those after it hold the rest."""
    back = [0, *accumulate(reversed(sizes))]
    earliest, at = [0] * shards, 0
    for j in range(shards - 1, 0, -1):
        at = bisect_right(back, back[at] + capacity) - 1
        earliest[j] = len(sizes) - at
    return earliest


def balanced_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Cuts (numbers of ranges before each but the first shard) that keep the capacity and lie nearest to equal shares."""
    upto = [0, *accumulate(sizes)]
    total, n = upto[-1], len(sizes)
    earliest = earliest_cuts(sizes, shards, capacity)
    cuts, before = [], 0
    for j in range(1, shards):
        latest = bisect_right(upto, upto[before] + capacity) - 1
        near = bisect_right(upto, total * j // shards) - 1
        if near < n and upto[near + 1] - total * j / shards < total * j / shards - upto[near]:
            near += 1
        before = min(max(near, earliest[j], before), latest)
        cuts.append(before)
    return cuts


def unlevel(ranges: list[Range], shards: int) -> list[Range]:
    """Ranges of several groups in which a cut nearer to an equal share could fall, once the smallest capacity is known."""
    sizes = [r.size for r in ranges]
    upto, capacity = [0, *accumulate(sizes)], smallest_capacity(sizes, shards)
    total, earliest, cuts = upto[-1], [*earliest_cuts(sizes, shards, capacity), len(sizes)], [0, *balanced_cuts(sizes, shards, capacity)]
    places = []
    for j in range(1, shards):
        share, first, last = total * j // shards, upto[earliest[j + 1]] - capacity, upto[cuts[j - 1]] + capacity
        places += [share] + [first] * (first > share) + [last] * (last < share)
    found = {i for p in places if upto[i := bisect_right(upto, p) - 1] < p < total and not ranges[i].single}
    return [ranges[i] for i in sorted(found)]


def apart(ranges: list[Range], shards: int) -> tuple[list[Range], list[Range]]:
    """Groups larger than an equal share of what is left get a shard each; (those, the rest)."""
    alone: list[Range] = []
    rest, left = ranges, sum(r.size for r in ranges)
    while shards - len(alone) > 1:
        big = [r for r in rest if r.size * (shards - len(alone)) > left]
        if not big or not all(r.single for r in big):
            break
        big = sorted(big, key=lambda r: (-r.size, r.low))[: shards - len(alone) - 1]
        alone += big
        left -= sum(r.size for r in big)
        taken = {r.low for r in alone}
        rest = [r for r in ranges if r.low not in taken]
    return alone, rest


def spans_of(again: list[Range], ranges: list[Range]) -> list[tuple[int, int, int]]:
    """At most SPANS spans of hashes (low, high, bits left out) of these ranges, in one if only some single groups lie between,
    which summing again does not change; the others' turn comes later."""
    at = {r.low: i for i, r in enumerate(ranges)}
    spans: list[tuple[int, int, int]] = []
    before = None
    for r in again:
        bits = max(0, r.bits - FINER_BITS)
        if before is not None and r.bits == before.bits and at[r.low] - at[before.low] < 32 and all(x.single for x in ranges[at[before.low] + 1 : at[r.low]]):
            spans[-1] = spans[-1][0], r.high, bits
        else:
            spans.append((r.low, r.high, bits))
        before = r
    return spans[:SPANS]


def plan(rows: DataFrame, shards: int) -> tuple[list[int], list[int | None], list[int], int]:
    """Hashes with a shard of their own, then the last hash of each further shard but the last, rows by shard, capacity."""
    ranges = histogram(rows)
    while True:
        alone, rest = apart(ranges, shards)
        left, total = shards - len(alone), sum(r.size for r in rest)
        again = [r for r in rest if not r.single and r.size * left > total] or (unsure(rest, left) or unlevel(rest, left) if rest else [])
        if not again:
            break
        spans = spans_of(again, ranges)
        starts = [a for a, *_ in spans]
        outside = [r for r in ranges if (k := bisect_right(starts, r.low) - 1) < 0 or r.low > spans[k][1]]
        ranges = sorted(outside + histogram(rows, spans), key=lambda r: r.low)
    sizes = [r.size for r in rest]
    capacity = smallest_capacity(sizes, left) if rest else 0
    cuts = balanced_cuts(sizes, left, capacity)
    edges = [0, *cuts, len(rest)]
    counts = [r.rows for r in alone] + [sum(r.rows for r in rest[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return [r.low for r in alone], [rest[c - 1].high if c else None for c in cuts], counts, max([capacity, *(r.size for r in alone)])


def shard_of(alone: list[int], lasts: list[int | None]) -> Column:
    out = F.lit(len(alone))
    for last in lasts:
        out = out + (F.lit(1) if last is None else (F.col("hash") > last).cast("int"))
    for i, h in enumerate(alone):
        out = F.when(F.col("hash") == h, F.lit(i)).otherwise(out)
    return out.cast("int")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.col(text_col)
    rows = settle(docs.select(F.col(id_col).alias("__id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("hash")))
    alone, lasts, counts, _ = plan(rows, shards)
    cells = F.element_at(F.array(*[F.lit(max(1, -(-n // CELL_ROWS))) for n in counts]), F.col("shard") + 1)
    # rows alike in id and text are one line with a number, so no id and no text is a window of its own
    alike = rows.groupBy("__id", "hash", "size", "text_crc32").agg(F.count("*").alias("rows")).withColumn("shard", shard_of(alone, lasts))
    dealt = settle(alike.withColumn("cell", F.pmod(F.xxhash64("__id", "hash", F.lit(3)), cells).cast("int")))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0))
    starts = dealt.groupBy("shard", "cell").agg(F.sum("rows").alias("n")).select("shard", "cell", before("n", earlier("shard").orderBy("cell")).alias("start"))
    placed = dealt.withColumn("first", before("rows", earlier("shard", "cell").orderBy("__id", "hash"))).join(starts, ["shard", "cell"])
    # lines of many rows become rows in pieces, dealt to all tasks
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PIECE_ROWS)))
    pieces = placed.select("*", piece.alias("piece")).repartition("__id", "hash", "piece")
    place = F.explode(F.sequence(F.col("piece") * PIECE_ROWS, F.least((F.col("piece") + 1) * PIECE_ROWS, F.col("rows")) - 1))
    out = pieces.select("*", place.alias("place"))
    return out.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
