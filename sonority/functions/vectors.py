"""Vectors as arrays, and the semiring of expectations as structs, in DataFrame functions.

A shorter vector counts as filled with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonority.functions.segments import dot, padded_sum

inner = dot
add = padded_sum


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def absolute(v: Column) -> Column:
    """Sum of absolute values."""
    return _sum(F.transform(v, F.abs))


def signs(v: Column) -> Column:
    """Slope of the sum of absolute values; zero at zero."""
    return F.transform(v, F.signum)


def normalised(v: Column) -> Column:
    """Length one; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def prepended(x: Column, v: Column) -> Column:
    return F.concat(F.array(x), v)


def expectation(p: Column, v: Column) -> Column:
    """A weight with the weighted sum that goes with it."""
    return F.struct(p.cast("double").alias("p"), v.alias("v"))


def plus(a: Column, b: Column) -> Column:
    return expectation(a["p"] + b["p"], add(a["v"], b["v"]))


def times(a: Column, b: Column) -> Column:
    """Weights multiply; sums follow the product rule."""
    return expectation(a["p"] * b["p"], add(scaled(b["v"], a["p"]), scaled(a["v"], b["p"])))


def mean(a: Column) -> Column:
    """The sum over the weight."""
    return F.transform(a["v"], lambda x: x / a["p"])
