"""Reduced space: truncated SVD of the document x term matrix, projection, profiles, distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaris.functions.vectors import DISTANCES, scale, total
from lexaris.session import checked, cut

#: Singular values below this share of the first are dropped.
LEAST = 1e-9
#: Directions of a basis below this share of its longest are dropped.
_FLAT = 1e-14


@dataclass
class Svd:
    """``factors`` is (term, p), p the row of V / sigma of a term; x of a row r of the matrix is r V / sigma."""

    factors: DataFrame
    sigma: np.ndarray


def _random_basis(terms: DataFrame, width: int, seed: int) -> DataFrame:
    """(term, x): normal deviates drawn from hashes of the term, the same however the terms are spread."""

    def uniform(j: int, salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64("term", F.lit(seed), F.lit(j), F.lit(salt)), 11) + 0.5) / float(1 << 53)

    deviates = [F.sqrt(-2 * F.log(uniform(j, 0))) * F.cos(2 * np.pi * uniform(j, 1)) for j in range(width)]
    return terms.select("term", F.array(*deviates).alias("x"))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """The width x width matrix of products of the columns of ``rows`` (x)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                out += x.T @ x
        yield pd.DataFrame({"m": [out.tobytes()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m, dtype=float) for m in group["m"])
        return pd.DataFrame({"m": [np.asarray(total, dtype=float).tobytes()]})

    parts = rows.select("x").mapInPandas(part, "m binary")
    parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(32))).applyInPandas(added, "m binary").collect()
    return sum((np.frombuffer(p["m"], dtype=float) for p in parts), np.zeros(width * width)).reshape(width, width)


def _times(rows: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """(key, x): every row times the small matrix ``m``."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) @ m if len(batch) else []
            yield pd.DataFrame({key: batch[key], "x": list(x)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "x").mapInPandas(part, f"{key} {kind}, x array<double>")


def _upright(rows: DataFrame, width: int) -> np.ndarray:
    """The matrix that makes the columns of ``rows`` orthonormal; directions of no length are dropped."""
    square, turn = np.linalg.eigh(_gram(rows, width))
    keep = square > _FLAT * max(square[-1], 1e-300)
    return turn[:, keep] / np.sqrt(square[keep])


def svd(cells: DataFrame, row: str, rank: int, power: int = 3, oversample: int = 10, seed: int = 0) -> Svd:
    """Truncated SVD of the matrix with cells (``row``, term, v), by randomised subspace iteration.

    Each pass multiplies a basis of terms x (rank + oversample) by the matrix and its
    transpose (Halko, Martinsson and Tropp 2011). Bases and products are tables with a
    row per term or document, made by a join and sums; only matrices of that width on
    both sides reach the driver, so neither terms nor documents are bounded. ``cells``
    is read several times and should be a written table.
    """
    terms = cut(cells.select("term").distinct(), "terms")
    width = min(rank + oversample, terms.count())
    if not width:
        return Svd(terms.select("term", F.array().cast("array<double>").alias("p")), np.zeros(0))
    basis = cut(_random_basis(terms, width, seed), "basis")
    turn = _upright(basis, width)
    for half in range(2 * power + 1):
        near, far = ("term", row) if half % 2 == 0 else (row, "term")
        last, basis = basis, _times(basis, near, turn)
        kept = turn.shape[1]
        product = cut(vector_sum(cells.join(basis, near), far, scale(F.col("x"), F.col("v")), kept), "product")
        if half < 2 * power:
            basis, turn = product, _upright(product, kept)
    square, directions = np.linalg.eigh(_gram(product, kept))
    order = np.argsort(-square)[:rank]
    sigma = np.sqrt(np.maximum(square[order], 0))
    keep = sigma > LEAST * max(sigma[0], 1e-300)
    sigma = sigma[keep]
    v = turn @ directions[:, order][:, keep] / sigma
    return Svd(cut(_times(last, "term", v).withColumnRenamed("x", "p"), "factors"), sigma)


def vector_sum(rows: DataFrame, key: str, x: Column, size: int) -> DataFrame:
    """(key, x): element-wise sums, as ``size`` plain aggregates with map-side combining."""
    rows = rows.select(key, x.alias("_x"))
    sums = [F.coalesce(F.sum(F.get("_x", F.lit(i))), F.lit(0.0)) for i in range(size)]
    return rows.groupBy(key).agg(F.array(*sums).alias("x"))


def project(cells: DataFrame, row: str, factors: DataFrame, rank: int) -> DataFrame:
    """(row, x): rows of weighted cells in the reduced space; rows without a known term are missing."""
    hit = cells.join(factors, "term")
    return vector_sum(hit, row, scale(F.col("p"), F.col("v")), rank)


def project_smoothed(cells: DataFrame, row: str, factors: DataFrame, tw: DataFrame, s: float, rank: int) -> DataFrame:
    """(row, x) as if every term were stored, the absent ones as log(s) x their weight's average.

    The absent cells add the same vector to every row: miss x the sum of all factors. Stored cells
    add their difference to miss.
    """
    miss = tw.agg(F.avg("tw") * F.log(F.lit(s))).first()[0] or 0.0
    base = vector_sum(factors.withColumn("k", F.lit(0)), "k", scale(F.col("p"), miss), rank).first()["x"]
    hit = cells.join(factors, "term").withColumn("dv", F.col("v") - miss)
    out = vector_sum(hit, row, scale(F.col("p"), F.col("dv")), rank)
    constant = F.array(*[F.lit(float(v)) for v in base])
    return out.select(row, F.zip_with("x", constant, lambda a, b: a + b).alias("x"))


def profile_name(name: str | None) -> str:
    """The category profile that an option value names."""
    n = (name or "average").lower()
    for start, full in (("fold-a", "fold-avg"), ("fold", "fold-in"), ("a", "average"), ("w", "weighted-average")):
        if n.startswith(start):
            return full
    raise ValueError(f"unknown category profile {name!r}")


def category_vectors(
    profile: str | None, xdm: DataFrame, dcm: DataFrame, rank: int,
    tcm: DataFrame | None = None, factors: DataFrame | None = None, lengths: DataFrame | None = None,
) -> DataFrame:
    """(cat_id, x) by one of the profiles fold-in, fold-avg, average, weighted-average."""
    kind = profile_name(profile)
    if kind == "fold-in":
        return project(tcm, "cat_id", factors, rank)
    if kind == "fold-avg":
        n = dcm.groupBy("cat_id").agg(F.count(F.lit(1)).alias("n"))
        cells = tcm.join(n, "cat_id").withColumn("v", F.col("v") / F.col("n"))
        return project(cells, "cat_id", factors, rank)
    rows = xdm.join(dcm.select("doc_id", "cat_id"), "doc_id")
    if kind == "average":
        w = xdm.agg((1.0 / F.count(F.lit(1))).alias("w"))
        rows = rows.crossJoin(F.broadcast(w))  # one row
    else:
        w = lengths.crossJoin(F.broadcast(lengths.agg(F.sum("n").alias("all"))))  # one row
        rows = rows.join(w.select("doc_id", (F.col("n") / F.col("all")).alias("w")), "doc_id")
    return vector_sum(rows, "cat_id", scale(F.col("x"), F.col("w")), rank)


def null_vector(tw: DataFrame, factors: DataFrame, s: float, rank: int) -> DataFrame:
    """(x): where a document without any term lies, every term counting as absent."""
    cells = tw.select(F.lit(0).alias("k"), "term", (F.log(F.lit(s)) * F.col("tw")).alias("v"))
    return project(cells, "k", factors, rank).select("x")


def with_null_proto(ranks: DataFrame, names: DataFrame, proto: int, null_cat: int) -> DataFrame:
    """``ranks`` with names: the stand-in ``proto`` goes under the null category's id and name, marked in ``proto``."""
    named = ranks.withColumn("proto", F.when(F.col("cat_id") == proto, "(null)"))
    named = named.withColumn("cat_id", F.when(F.col("cat_id") == proto, F.lit(null_cat).cast("long")).otherwise(F.col("cat_id")))
    return named.join(names.select("cat_id", "name"), "cat_id", "left")


def root_mean_square(x: Column) -> Column:
    """The cached deviation of a vector: sqrt(mean(x^2))."""
    return F.sqrt(F.try_divide(total(F.transform(x, lambda v: v * v)), F.size(x)))


def distances(rows: DataFrame, cats: DataFrame, letter: str = "u") -> DataFrame:
    """(doc_id, cat_id, d) of every document vector to every category vector; categories are a short list."""
    c = cats.select("cat_id", F.col("x").alias("_y"))
    return rows.crossJoin(checked(c)).select("doc_id", "cat_id", DISTANCES[letter](F.col("x"), F.col("_y")).alias("d"))
