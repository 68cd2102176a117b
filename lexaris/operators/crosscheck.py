"""Cross-checking: every fold classified by a model of the others, with cut-offs, and the totals of all folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaris.operators import classify, cutoff, matrix
from lexaris.session import cut


def by_folds(cells: DataFrame, best: DataFrame, folds: DataFrame, n: int, s: float, method: str = "entropy", cutoffs: bool = False) -> DataFrame:
    """(fold, doc_id, wanted, got): the nearest category of each document by centroids of the other folds, in raw space.

    ``cells`` is (doc_id, term, f), ``best`` (doc_id, cat_id), ``folds`` (doc_id, fold) from 0
    to ``n`` - 1. With ``cutoffs`` the training documents' own distances give cut-offs,
    under which the decision is made. Documents without a term of the vocabulary take no part.
    """
    placed = cut(cells.join(folds.select("doc_id", "fold"), "doc_id").join(best.select("doc_id", "cat_id"), "doc_id"), "placed")
    out = None
    for fold in range(n):
        train = placed.where(F.col("fold") != fold)
        by_cat = cut(train.groupBy("term", "cat_id").agg(F.sum("f").alias("f")), "tcm0")
        tcm = cut(matrix.weighted(by_cat, matrix.weights(by_cat, "cat_id", method), s), "tcm")
        cats = cut(by_cat.select("cat_id").distinct(), "cats")

        def distances(part: DataFrame, tcm: DataFrame = tcm, cats: DataFrame = cats) -> DataFrame:
            rows = part.select("doc_id", "term", "f")
            return classify.raw_distances(rows, tcm, rows.select("doc_id").distinct(), cats)

        held = placed.where(F.col("fold") == fold)
        if cutoffs:
            own = train.select("doc_id", "cat_id").distinct()
            fits = cutoff.fit_sparse(distances(train).where(F.col("d") < cutoff.DEFAULT), own, cats)
            cuts = cut(cutoff.cutoffs(cutoff.repaired(fits, cats)), "cuts")
            got = cutoff.decide(distances(held).withColumn("d", F.round("d", 6)), cuts)
        else:
            got = classify.best(classify.ranked(distances(held))).select("doc_id", F.col("cat_id").alias("got"))
        wanted = held.select("doc_id", F.col("cat_id").alias("wanted")).distinct()
        rows = cut(wanted.join(got, "doc_id").select(F.lit(fold).alias("fold"), "doc_id", "wanted", "got"), "fold")
        out = rows if out is None else out.unionByName(rows)
    return out


def summary(rows: DataFrame) -> DataFrame:
    """(fold, n, accuracy) of each fold and of all (fold null)."""
    hit = (F.col("wanted") == F.col("got")).cast("double")
    return rows.rollup("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
