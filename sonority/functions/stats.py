"""Scores and distributions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upper_ratio(o: Column, e: Column) -> Column:
    """Upper confidence limit of observed to expected, at most one."""
    p = (o + 0.5) / (e + 1)
    return F.when(p >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p + 3 * F.sqrt(p * (1 - p) / (e + 1))))


def upper_ratio_of(o: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The same over arrays."""
    p = (np.asarray(o, float) + 0.5) / (np.asarray(e, float) + 1)
    q = np.minimum(p, 1)
    return np.where(p >= 1, 1.0, np.minimum(1.0, q + 3 * np.sqrt(q * (1 - q) / (np.asarray(e, float) + 1))))


def cumulative(masses: DataFrame, outcome: str, mass: str, *keys: str) -> DataFrame:
    """``outcome, p, lo``: chances and their exclusive running sums; outcomes without mass are dropped."""
    by = Window.partitionBy(*keys)
    ahead = by.orderBy(outcome).rowsBetween(Window.unboundedPreceding, -1)
    some = masses.where(F.col(mass) > 0)
    return some.select(*keys, outcome, (F.col(mass) / F.sum(mass).over(by)).alias("p"), (F.coalesce(F.sum(mass).over(ahead), F.lit(0)) / F.sum(mass).over(by)).alias("lo"))


def stratified(cdf: DataFrame, outcome: str, n: int, *keys: str) -> DataFrame:
    """How many of ``n`` draws each outcome gets when they are spread evenly; the numbers add up to ``n``."""
    by = Window.partitionBy(*keys).orderBy("lo")
    edge = F.bround(F.lit(n) * F.col("lo"))
    return cdf.select(*keys, outcome, (F.lead(edge, 1, float(n)).over(by) - edge).cast("long").alias("draws"))


def looked_up(values: DataFrame, value: str, cdf: DataFrame, outcome: str) -> DataFrame:
    """The outcome of each value in [0, 1): the last with a lower bound that is not above it.

    The table is one sorted array in a single row, looked up in place by halving: values are not shuffled. A value below all bounds
    has no outcome.
    """
    table = cdf.agg(F.array_sort(F.collect_list(F.struct("lo", F.col(outcome).alias("outcome")))).alias("_table"))
    start = F.struct(F.lit(-1).alias("low"), F.size("_table").alias("high"))

    def halve(held: Column, _: Column) -> Column:
        # the place wanted is at or above low and below high
        middle = F.floor((held["low"] + held["high"]) / 2).cast("int")
        under = F.get("_table", middle)["lo"] <= F.col(value)
        inside = held["high"] - held["low"] > 1
        return F.struct(F.when(inside & under, middle).otherwise(held["low"]).alias("low"), F.when(inside & ~F.coalesce(under, F.lit(False)), middle).otherwise(held["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("_table") + F.lit(2))).cast("int"))
    place = F.aggregate(steps, start, halve)["low"]
    return values.crossJoin(F.broadcast(table)).select(*values.columns, F.get("_table", F.when(place >= 0, place))["outcome"].alias(outcome))


def half_even(x: float) -> int:
    low = math.floor(x)
    return low if x - low < 0.5 or x - low == 0.5 and low % 2 == 0 else low + 1


def strata(masses: dict[int, float], n: int) -> dict[int, int]:
    """:func:`stratified` on the driver."""
    some = {k: m for k, m in sorted(masses.items()) if m > 0}
    total, run, edges = sum(some.values()), 0.0, []
    for m in some.values():
        edges.append(half_even(n * run / total))
        run += m
    return {k: b - a for k, a, b in zip(some, edges, [*edges[1:], n])}
