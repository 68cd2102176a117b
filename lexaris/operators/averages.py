"""Vectors of terms approximated by weighted averages of the vectors of documents.

Items are (label, x); a query is one literal vector. The k best items are merged from
each task's best, so only averages over all items (k = 0) read them all, by plain sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.functions.math import boltzmann, gauss_cdf
from lexaris.functions.vectors import DISTANCES, NORMALISED, jensen_shannon, l2, scale, unit_length
from lexaris.operators.lsi import vector_sum

#: What an item may be compared by: the distances of the models and those of the prototypes.
COMPARED: dict[str, Callable[[Column, Column], Column]] = {**DISTANCES, "js": jensen_shannon, "l2": l2}


def normalised_rows(items: DataFrame, how: str) -> DataFrame:
    """``items`` with vectors that sum up to 1, are shifted so that nothing is negative, or have length 1."""
    if how != "shifted":
        return items.withColumn("x", NORMALISED[how](F.col("x"), F.lit(None)))
    least = items.agg(F.min(F.array_min("x")).alias("_least"))
    return items.crossJoin(F.broadcast(least)).withColumn("x", NORMALISED[how](F.col("x"), F.col("_least"))).drop("_least")  # one row


def compared(items: DataFrame, query: Column, by: str = "u") -> DataFrame:
    """``items`` with the distance ``d`` of each to ``query``."""
    return items.withColumn("d", COMPARED[by](F.col("x"), query))


def k_nearest(items: DataFrame, label: str, k: int, digits: int = 9) -> DataFrame:
    """The ``k`` items of least ``d``, rounded, ties by label; k = 0 keeps all."""
    items = items.withColumn("d", F.round("d", digits))
    return items.orderBy("d", label).limit(k) if k else items


def weights(near: DataFrame, how: str, base: float = 2.0, beta: float = -1.0) -> DataFrame:
    """``near`` with weights ``w`` that sum up to 1.

    plain: all alike; boltzmann: base ** (beta d); power: d ** beta; gauss: 1 - normal
    distribution function of d under the mean and deviation of ``near``; given: by its column ``f``.
    """
    if how == "gauss":
        m = near.agg(F.avg("d").alias("_mu"), F.stddev_pop("d").alias("_sd"))
        near = near.crossJoin(F.broadcast(m))  # one row
        raw = 1 - F.coalesce(gauss_cdf(F.col("d"), F.col("_mu"), F.col("_sd")), F.lit(0.5))
    else:
        raw = {
            "plain": F.lit(1.0),
            "boltzmann": boltzmann(F.col("d"), base, beta),
            "power": F.pow(F.greatest("d", F.lit(1e-12)), F.lit(beta)),
            "given": F.col("f") if "f" in near.columns else F.lit(1.0),
        }[how]
    near = near.withColumn("_raw", raw)
    all_ = near.agg(F.sum("_raw").alias("_all"))
    return near.crossJoin(F.broadcast(all_)).withColumn("w", F.try_divide("_raw", "_all")).drop("_raw", "_all", "_mu", "_sd")  # one row


def average(weighted: DataFrame, rank: int, unit: bool = False) -> DataFrame:
    """(x): the weighted sum of the vectors of ``weighted`` (x, w), scaled to length 1 if wanted."""
    out = vector_sum(weighted.withColumn("_k", F.lit(0)), "_k", scale(F.col("x"), F.col("w")), rank).select("x")
    return out.select(unit_length(F.col("x")).alias("x")) if unit else out


def row_applied(cells: DataFrame, xdm: DataFrame, sigma: Column, rank: int) -> DataFrame:
    """(term, x): rows of the weighted matrix applied to the documents' side of the reduced space.

    x is the sum over documents of v times the document's vector, divided by sigma; over
    all documents this gives the term's own vector back.
    """
    out = vector_sum(cells.join(xdm, "doc_id"), "term", scale(F.col("x"), F.col("v")), rank)
    return out.select("term", F.zip_with("x", sigma, lambda a, s: F.try_divide(a, s)).alias("x"))


def ranked_near(items: DataFrame, queries: DataFrame, k: int, by: str = "u", digits: int = 6) -> DataFrame:
    """(query, other, d, rank): of every query the ``k`` nearest items, ties by id.

    ``queries`` (query, y) is a stated short list, checked before it is sent to the items.
    """
    from lexaris.session import checked

    rows = items.crossJoin(checked(queries)).withColumn("d", F.round(COMPARED[by](F.col("x"), F.col("y")), digits))
    order = W.partitionBy("query").orderBy("d", "other")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "other", "d", "rank")
