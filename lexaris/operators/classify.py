"""Classifying documents: raw space, and neighbours' votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.session import checked

def similarity(d: Column) -> Column:
    """1 / d within [0, 1e38]."""
    return F.when(d <= 0, 1e38).otherwise(F.least(1.0 / d, F.lit(1e38)))


def raw_distances(tdm0: DataFrame, tcm: DataFrame, documents: DataFrame, cats: DataFrame) -> DataFrame:
    """(doc_id, cat_id, d): cosine distance of each document's raw frequencies to each weighted category.

    Without a common term the distance is 1; a document or category without any term is
    at 2. The categories are few, so that documents x categories grows with the documents only.
    """
    dots = tdm0.join(tcm.select("term", "cat_id", "v"), "term").groupBy("doc_id", "cat_id").agg(
        F.sum(F.col("f") * F.col("v")).alias("dot")
    )
    doc_norm = tdm0.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("nd"))
    cat_norm = tcm.groupBy("cat_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nc"))
    sides = documents.select("doc_id").join(doc_norm, "doc_id", "left")
    sides = sides.crossJoin(checked(cats.select("cat_id").join(cat_norm, "cat_id", "left")))
    full = sides.join(dots, ["doc_id", "cat_id"], "left")
    cos = F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("nd") * F.col("nc"))
    d = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce(1 - cos, F.lit(2.0))))
    return full.select("doc_id", "cat_id", d.alias("d"))


def ranked(distances: DataFrame, digits: int = 6) -> DataFrame:
    """(doc_id, cat_id, d, sim, deg): deg 1 is the nearest category, ties by cat_id."""
    out = distances.withColumn("d", F.round("d", digits))
    order = W.partitionBy("doc_id").orderBy("d", "cat_id")  # a row per category
    return out.select("doc_id", "cat_id", "d", similarity(F.col("d")).alias("sim"), F.row_number().over(order).alias("deg"))


def best(ranks: DataFrame) -> DataFrame:
    return ranks.where(F.col("deg") == 1).select("doc_id", "cat_id", "d")


def neighbour_votes(neighbours: DataFrame, dcm: DataFrame, k: int) -> DataFrame:
    """(doc_id, cat_id, score): votes of the k nearest documents.

    ``neighbours`` is (doc_id, other, d). Each has p = sim / sum of sims; a category gets
    the sum of p / deg over the neighbours in it. Ties at the k-th go to the smaller id.
    """
    order = W.partitionBy("doc_id").orderBy("d", "other")
    near = neighbours.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    near = near.withColumn("sim", similarity(F.col("d")))
    near = near.withColumn("p", F.col("sim") / F.sum("sim").over(W.partitionBy("doc_id")))
    votes = near.join(dcm.select(F.col("doc_id").alias("other"), "cat_id", "deg"), "other")
    return votes.groupBy("doc_id", "cat_id").agg(F.sum(F.col("p") / F.col("deg")).alias("score"))


def sort_memberships(members: DataFrame) -> DataFrame:
    """Numbers a document's memberships by deg, cut, falling sim, dist_raw, id and name; missing values count 0, deg 1."""
    order = W.partitionBy("doc_id").orderBy(
        F.coalesce("deg", F.lit(1)),
        F.coalesce("cut", F.lit(0)),
        F.desc(F.coalesce("sim", F.lit(0.0))),
        F.coalesce("dist_raw", F.lit(0.0)),
        F.coalesce("cat_id", F.lit(0)),
        F.coalesce("name", F.lit("")),
    )
    return members.withColumn("rank", F.row_number().over(order))
