"""Vocabulary pruning and dense numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.operators.signatures import global_frequencies
from lexaris.session import cut


def kept_terms(signatures: DataFrame, min_freq: float, min_doc_freq: float) -> DataFrame:
    """(term, gf, df) of terms with gf and df of at least the bounds; a bound of 0 keeps all."""
    return global_frequencies(signatures).where((F.col("gf") >= min_freq) & (F.col("df") >= min_doc_freq))


def trim(signatures: DataFrame, min_freq: float, min_doc_freq: float) -> DataFrame:
    return signatures.join(kept_terms(signatures, min_freq, min_doc_freq).select("term"), "term", "left_semi")


def most_frequent_per_document(signatures: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms of highest f in each document, ties by term; n = 0 keeps all."""
    if not n:
        return signatures
    order = W.partitionBy("doc_id").orderBy(F.desc("f"), "term")
    return signatures.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def trim_by_top_terms(signatures: DataFrame, n: int, min_freq: float, min_doc_freq: float) -> DataFrame:
    """Terms kept when gf counts only each document's ``n`` top terms, while df counts all."""
    gf = most_frequent_per_document(signatures, n).groupBy("term").agg(F.sum("f").alias("gf"))
    df = signatures.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return gf.join(df, "term").where((F.col("gf") >= min_freq) & (F.col("df") >= min_doc_freq))


def number(df: DataFrame, key: str, name: str) -> DataFrame:
    """Dense ids from 0 in the order of ``key``, without a sort of all rows in one task.

    Rows are range-partitioned by key; the ids are positions within the partition plus
    the number of rows in the partitions before it, known from one count per partition.
    """
    parts = df.select(key).distinct().repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id())
    parts = cut(parts, "parts")  # counts and rows must see the same partitions
    parts = parts.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(key)) - 1)
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).select("_p", "_before")
    out = parts.join(F.broadcast(before), "_p")
    return out.select((F.col("_i") + F.col("_before")).cast("long").alias(name), key)


def local_categories(members: DataFrame) -> DataFrame:
    """(lcid, cat_id): the categories in use, numbered without holes in the order of their ids."""
    order = W.orderBy("cat_id")  # a short list
    return members.select("cat_id").distinct().select((F.row_number().over(order) - 1).cast("long").alias("lcid"), "cat_id")


def null_category_name(cats: DataFrame, asked: str | None) -> DataFrame:
    """One row (null_name): the category asked for; ``(auto)`` is the one of the least id."""
    if asked != "(auto)":
        return cats.sparkSession.createDataFrame([(asked,)], "null_name string")
    return cats.agg(F.min(F.struct("cat_id", "name")).alias("b")).select(F.col("b.name").alias("null_name"))


def ids_from_names(cats: DataFrame) -> DataFrame:
    """``cats`` (cat_id, name): the number that a name begins with, before ``_``, is its id; a missing id is 0.

    Of several names under one id the first in byte order keeps it, the others get ids
    after the greatest.
    """
    number = F.regexp_extract("name", r"^(\d{1,18})_", 1)
    asked = F.coalesce(F.try_to_number(number, F.lit("9" * 18)).cast("long"), F.col("cat_id"), F.lit(0).cast("long"))
    rows = cats.select("name", asked.alias("asked")).distinct()
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("asked").orderBy("name")))
    every = W.partitionBy()  # a row per category
    rows = rows.withColumn("top", F.max("asked").over(every))
    late = W.partitionBy(F.col("r") > 1).orderBy("asked", "name")
    rows = rows.withColumn("k", F.row_number().over(late))
    return rows.select(F.when(F.col("r") == 1, F.col("asked")).otherwise(F.col("top") + F.col("k")).alias("cat_id"), "name")


def with_null_category(cats: DataFrame) -> DataFrame:
    """``cats`` (cat_id, name) with ``(null)`` under id 0, or after the greatest id if 0 is taken."""
    free = cats.agg(F.max((F.col("cat_id") == 0).cast("int")).alias("taken"), F.max("cat_id").alias("top"))
    null_id = F.when(F.coalesce("taken", F.lit(0)) == 1, F.col("top") + 1).otherwise(0).cast("long")
    return cats.select("cat_id", "name").unionByName(free.select(null_id.alias("cat_id"), F.lit("(null)").alias("name")))
