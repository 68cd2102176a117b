"""Expressions on array<double> vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def scale(x: Column, k: Column | float) -> Column:
    return F.transform(x, lambda v: v * k)


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def cosine_distance(x: Column, y: Column) -> Column:
    """1 - cos within [0, 2]; 2 where a vector is null or has no length."""
    cos = F.try_divide(dot(x, y), norm(x) * norm(y))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.nanvl(1 - cos, F.lit(2.0)))), F.lit(2.0))


def euclid_distance(x: Column, y: Column) -> Column:
    """Mean squared difference."""
    return F.try_divide(total(F.zip_with(x, y, lambda a, b: (a - b).cast("double") * (a - b).cast("double"))), F.size(x))


def block_distance(x: Column, y: Column) -> Column:
    """Mean absolute difference."""
    return F.try_divide(total(F.zip_with(x, y, lambda a, b: F.abs(a.cast("double") - b.cast("double")))), F.size(x))


def pearson_distance(x: Column, y: Column) -> Column:
    """Cosine distance of the centred vectors."""
    n = F.size(x)
    mx, my = total(F.transform(x, lambda v: v.cast("double"))) / n, total(F.transform(y, lambda v: v.cast("double"))) / n
    sxy, sxx, syy = dot(x, y) - n * mx * my, dot(x, x) - n * mx * mx, dot(y, y) - n * my * my
    return F.coalesce(1 - F.try_divide(sxy, F.sqrt(sxx * syy)), F.lit(2.0))


#: By the letters that a model's options use.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "u": cosine_distance,
    "e": euclid_distance,
    "b": block_distance,
    "c": pearson_distance,
}


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence in bits; cells with p = 0 add nothing."""
    return total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(F.try_divide(a, b))).otherwise(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    mid = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return kl(p, mid) / 2 + kl(q, mid) / 2


def l2(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def relative_error(x: Column, y: Column) -> Column:
    """Squared difference relative to the squared length of ``x``."""
    return F.try_divide(l2(x, y) * l2(x, y), dot(x, x))


def unit_sum(x: Column) -> Column:
    """Components divided by their sum."""
    return F.transform(x, lambda v: F.try_divide(v, total(x)))


def unit_length(x: Column) -> Column:
    return F.transform(x, lambda v: F.try_divide(v, norm(x)))


def raised(x: Column, least: Column | None = None) -> Column:
    """Components from 0 on, ``least`` being the vector's own least component or that of the whole table, summing up to 1."""
    low = F.array_min(x) if least is None else least
    return unit_sum(F.transform(x, lambda v: v - low))


#: Normalisations of a table of vectors by name; "shifted" needs the least component of the table.
NORMALISED: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda x, least: unit_sum(x),
    "shifted": raised,
    "row-shifted": lambda x, least: raised(x),
    "length": lambda x, least: unit_length(x),
}
