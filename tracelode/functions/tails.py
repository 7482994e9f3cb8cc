"""Tails of distributions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 150


def normal_two_sided(t: Column) -> Column:
    """P(|Z| >= |t|) of the standard normal distribution, to about 1e-14; null for null.

    The area from 0 to x is the density at x times the sum of x^(2k+1) / (1 * 3 * ... * (2k+1)), whose terms are all positive.
    Beyond 8 the tail is below 1e-14 and counts as 0.
    """
    x = F.abs(t)
    step = F.struct(x.alias("term"), x.alias("total"))

    def add(so_far: Column, k: Column) -> Column:
        term = so_far["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (so_far["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), step, add, lambda s: s["total"])
    tail = F.greatest(1 - 2 * series * F.exp(-x * x / 2) / F.sqrt(2 * F.pi()), F.lit(0.0))
    return F.when(x > 8, 0.0).when(x.isNotNull(), tail)
