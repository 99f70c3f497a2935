"""Vector arithmetic on array columns, in double precision from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(_sum(F.transform(d, lambda x: x * x)))


def similarity(d: Column) -> Column:
    """1 / (1 + distance); 0 for NaN."""
    s = 1.0 / (1.0 + d)
    return F.when(F.isnan(s), 0.0).otherwise(s)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def unit(a: Column) -> Column:
    """The vector at length 1, as floats; a zero vector stays."""

    def of(v: Column, norm: Column) -> Column:
        return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") * (1.0 / norm)).cast("float"))).otherwise(F.transform(v, lambda x: x.cast("float")))

    # arrays of one element hold the vector and its norm, which would be found anew for each component
    both = F.transform(F.array(a), lambda v: F.struct(v.alias("v"), F.sqrt(squared(v)).alias("norm")))
    return F.get(F.transform(both, lambda b: of(b["v"], b["norm"])), F.lit(0))
