"""Exact order statistics in two scans: a sketch brackets each rank, and a count of what lies in and between the brackets finds it.

The first scan takes whatever other figures are wanted, the number of values, and a mergeable sketch of each column. A rank's
bracket reaches from the sketch's value a few errors below it to the one as many errors above. The second scan counts the values
in brackets by value, in up to PARTS parts of each bracket, and those between brackets as one; the part with the rank follows
from the counts, and the value from the part. So a column of n values has about 8 * ERROR * n in its brackets for each rank,
which are counted before they are shuffled; no task holds more than a part of them, and the driver gets nothing.

All is one plan: nothing runs while it is built, and its two scans see the same state of the table as the rest of the query does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that the sketch keeps at a level, its error in ranks (a share of all, at 99 %), and how many of them a bracket
#: reaches on either side: ten deviations.
SKETCH, ERROR, ERRORS = 4096, 0.0008, 4
#: Parts of a bracket.
PARTS = 1024

#: A share of the values, and the rank near it, from 0, for a number of values.
Rank = tuple[float, Callable[[Column], Column]]


def nearest(p: float) -> list[Rank]:
    """Rank ceil(p n)."""
    return [(p, lambda n: F.greatest(F.lit(0), F.ceil(F.lit(p) * n) - 1))]


def between(p: float) -> list[Rank]:
    """The ranks on both sides of p (n - 1)."""
    return [(p, lambda n: F.greatest(F.lit(0), F.floor(F.lit(p) * (n - 1)))), (p, lambda n: F.greatest(F.lit(0), F.ceil(F.lit(p) * (n - 1))))]


def at_share(p: float) -> list[Rank]:
    """Rank floor(p n), from 0."""
    return [(p, lambda n: F.least(F.floor(F.lit(p) * n), n - 1))]


def interpolated(p: float, n: Column, low: Column, high: Column) -> Column:
    """Between two ranks as ``between`` gives them, linear."""
    at = F.lit(p) * (n - 1)
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def with_order_statistics(df: DataFrame, columns: dict[str, Column], ranks: dict[str, list[Rank]], figures: dict[str, Column] | None = None) -> DataFrame:
    """One row: ``figures`` (aggregates of the table), ``n_<column>`` and, for each rank asked of it, ``<column>_<i>``, null if
    there is no such rank. Null and NaN are no values. Grouping by nothing, so an empty table gives a row too."""
    figures, names = figures or {}, list(columns)
    clean = {c: F.when(~F.isnan(columns[c].cast("double")), columns[c].cast("double")) for c in names}
    values = df.select("*", *[x.alias(f"__x_{c}") for c, x in clean.items()])
    told = [e.alias(f) for f, e in figures.items()]
    first = values.agg(*told, *[f(F.col(f"__x_{c}")).alias(f"__{k}_{c}") for c in names for k, f in (("n", F.count), ("s", lambda x: F.kll_sketch_agg_double(x, F.lit(SKETCH))))])
    brackets = first.select(F.struct(*[F.col(f) for f in figures], *[F.col(f"__n_{c}") for c in names], *[_edges(F.col(f"__n_{c}"), F.col(f"__s_{c}"), ranks[c]).alias(f"__e_{c}") for c in names]).alias("all"))
    # one subquery, whatever of it is used where: it runs once. Each use is a column, so that few copies of its plan are analysed
    known = brackets.scalar()
    kept = values.select(*[F.col(f"__x_{c}") for c in names]).withColumn("__all", known)
    ends = lambda c: [F.col(f"__all.__e_{c}")[i] for i in range(2 * len({p for p, _ in ranks[c]}))]
    # a column for each end, so that a row looks into the arrays once
    kept = kept.select(*[F.col(f"__x_{c}") for c in names], *[e.alias(f"__e_{c}_{i}") for c in names for i, e in enumerate(ends(c))])
    placed = [_placed(F.lit(i), F.col(f"__x_{c}"), [F.col(f"__e_{c}_{j}") for j in range(len(ends(c)))]) for i, c in enumerate(names)]
    rows = kept.select(F.inline(F.array(*placed))) if len(names) > 1 else kept.select(placed[0].alias("r")).select("r.*")
    # the keys are never null, so that no filter parts the two uses of these counts
    counted = rows.where("c is not null").select(*[F.coalesce(k, F.lit(-1)).alias(k) for k in ("c", "pos", "part")], "v").groupBy("c", "pos", "part", "v").agg(F.count("*").alias("n"))
    parts = counted.groupBy("c", "pos", "part").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("c").orderBy("pos", "part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.sum("n").over(upto))

    asked = F.array(*[F.struct(F.lit(i).alias("rank_c"), F.lit(j).alias("j"), rank(F.col(f"__all.__n_{c}")).cast("long").alias("r")) for i, c in enumerate(names) for j, (_, rank) in enumerate(ranks[c])])
    found = parts.withColumn("__all", known).withColumn("ask", F.explode(asked)).where("ask.rank_c = c and ask.r >= upto - n and ask.r < upto")
    found = found.select("c", "pos", "part", F.col("ask.j").alias("j"), (F.col("ask.r") - (F.col("upto") - F.col("n"))).alias("r"))
    # a row for each rank at most
    inside = counted.join(F.broadcast(found), ["c", "pos", "part"])
    running = Window.partitionBy("c", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hit = inside.withColumn("upto", F.sum("n").over(running)).where("r >= upto - n and r < upto")
    # what lies between brackets has no value; ten deviations make that as good as impossible, and it is told
    value = F.when(F.col("part") >= 0, F.col("v")).otherwise(F.raise_error(F.lit("a rank lies outside its bracket: raise quantiles.ERRORS")).cast("double"))
    made = hit.withColumn("v", value).agg(*[F.max(F.when((F.col("c") == i) & (F.col("j") == j), F.col("v"))).alias(f"{c}_{j}") for i, c in enumerate(names) for j in range(len(ranks[c]))])
    return made.withColumn("__all", known).select(*[F.col(f"__all.{f}") for f in figures], *[F.col(f"__all.__n_{c}").alias(f"n_{c}") for c in names], *made.columns)


def _edges(n: Column, sketch: Column, ranks: list[Rank]) -> Column:
    """The brackets' lower and upper ends, one bracket for each share; everything if the values are few."""
    at = lambda share: F.kll_sketch_get_quantile_double(sketch, F.lit(max(0.0, min(1.0, share))))
    end = lambda share, all_: F.when(n > SKETCH, at(share)).otherwise(F.lit(all_))
    shares = sorted({p for p, _ in ranks})
    return F.array(*[end(p - ERROR * ERRORS, float("-inf")) for p in shares], *[end(p + ERROR * ERRORS, float("inf")) for p in shares])


def _placed(c: Column, x: Column, ends: list[Column]) -> Column:
    """(c, pos, part, v) of a value: how many ends are below it; for one within a bracket its part and itself. Values ordered by
    (pos, part, v) are in order: what has the same ends below it lies in brackets or between them, but for an end itself, which
    closes its piece."""
    m = len(ends) // 2
    within = reduce(or_, [(x >= lo) & (x <= hi) for lo, hi in zip(ends[:m], ends[m:])])
    below = reduce(add, [(e < x).cast("int") for e in ends])
    low, high = F.greatest(*[F.when(e < x, e) for e in ends]), F.least(*[F.when(e >= x, e) for e in ends])
    # halves, so that the width is finite
    share = F.least(F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * PARTS), F.lit(PARTS - 1)).cast("int")
    endless = low.isNull() | high.isNull() | (low == float("-inf")) | (high == float("inf"))
    part = F.when(~within, -1).when(x == high, PARTS).when(endless, 0).otherwise(share)
    return F.struct(F.when(x.isNotNull(), c).alias("c"), below.alias("pos"), part.alias("part"), F.when(within, x).alias("v"))
