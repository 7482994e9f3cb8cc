"""Exact ranks and percentiles by refinement, so that no task, buffer or window holds the values of a group.

A pass cuts the interval that holds a wanted rank into ``BINS`` bins of equal width and keeps of each bin its count and its
least and greatest value; the bin that holds the rank is the next pass's interval.  Partial aggregation leaves at most
``BINS`` rows for each wanted rank and task, and a window sees only a rank's bins.  Least and greatest value of an
interval fall into different bins, so every pass gets nearer to values that repeat or stand alone; three or
four are usual.  The table of intervals is small (a row for each group and rank) and is written after each pass; the
driver learns only whether a rank is still open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import removed, written

BINS = 4096


def _bin(x: Column, low: Column, high: Column) -> Column:
    """The bin of a value between ``low`` and ``high``; halves keep the width finite."""
    width = high / 2 - low / 2
    place = F.floor((x / 2 - low / 2) / width * BINS)
    return F.when(x >= high, BINS - 1).when(x <= low, 0).otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1))).cast("int")


def _rounded_once(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding at the end (a fused multiply-add); with plain arithmetic where parts overflow.

    The error of the product comes from halves of the digits of each factor, that of the sum from what it took of either part.
    """

    def high(x: Column) -> Column:
        wide = x * 134217729.0  # 2 ** 27 + 1
        return wide - (wide - x)

    product, a1, b1 = a * b, high(a), high(b)
    a2, b2 = a - a1, b - b1
    of_product = a2 * b2 - (((product - a1 * b1) - a2 * b1) - a1 * b2)
    total = product + c
    part = total - product
    of_total = (product - (total - part)) + (c - part)
    exact = total + (of_product + of_total)
    return F.when(F.isnan(exact) | (F.abs(exact) == float("inf")), total).otherwise(exact)


def values_at(rows: DataFrame, by: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """(``by``, rank, x): the value at each wanted rank (from 0, ascending) of each group; ``ranks`` has (``by``, rank).

    Null and NaN values have no rank, and ranks that a group does not have give no row.  Groups may be null.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    held = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    wanted = ranks.select(*(F.col(c).alias(f"w{k}") for c, k in zip(by, keys)), "rank").distinct()

    def same(left: Sequence[str], right: Sequence[str]) -> Column:
        found = F.lit(True)
        for a, b in zip(left, right):
            found = found & F.col(a).eqNullSafe(F.col(b))
        return found

    names = [f"w{k}" for k in keys]
    ends = held.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    state = wanted.join(ends, same(names, keys)).where("rank >= 0 AND rank < n").select(*names, "rank", F.col("rank").cast("long").alias("left"), "low", "high")
    state = written(state, "selection")
    while not state.where("low < high").isEmpty():
        open_ = state.where("low < high")
        inside = held.join(open_, same(keys, names) & (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
        bins = inside.groupBy(*names, "rank", "left", _bin(F.col("x"), F.col("low"), F.col("high")).alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*names, "rank").orderBy("bin"))  # at most BINS rows
        at = bins.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("c") <= F.col("left")))
        now = at.select(*names, "rank", (F.col("left") - F.col("upto") + F.col("c")).alias("left"), "low", "high")
        last, state = state, written(state.where("low >= high").unionByName(now), "selection")
        removed(last)
    return state.select(*(F.col(n).alias(c) for n, c in zip(names, by)), "rank", F.col("low").alias("x"))


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(``by``, n, q): the linear percentiles of each group as an array in the order of ``shares``, and how many values it has."""
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count("*").alias("n"))
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares))))
    asked = written(counts.select(*by, "n", place.alias("s")).select(*by, "n", "s.i", "s.at"), "asked")
    both = asked.select(*by, F.explode(F.array(F.floor("at").cast("long"), F.ceil("at").cast("long"))).alias("rank"))
    found = values_at(rows, by, value, both)
    names = [f"_g{i}" for i in range(len(by))]

    def end(rank: Column, name: str) -> tuple[DataFrame, Column]:
        side = found.select(*(F.col(c).alias(f"{name}{g}") for c, g in zip(by, names)), F.col("rank").alias(f"{name}_rank"), F.col("x").alias(name))
        met = F.col(f"{name}_rank") == rank
        for c, g in zip(by, names):
            met = met & F.col(c).eqNullSafe(F.col(f"{name}{g}"))
        return side, met

    low, is_low = end(F.floor("at"), "low")
    high, is_high = end(F.ceil("at"), "high")
    share = F.col("at") - F.floor("at")
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(_rounded_once(F.col("low"), 1 - share, F.col("high") * share))
    q = F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("x")))), lambda s: s["x"])  # one entry a share
    return asked.join(low, is_low).join(high, is_high).groupBy(*by).agg(F.first("n").alias("n"), q.alias("q"))
