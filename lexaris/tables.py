"""Loading the tables of a data folder and their cleaned views.

The versioned tables (docs, doc_cats, tf, dist, xdm) keep of each key the row with the
latest ``seen_at``, also where its value cannot be used; of two rows with the same key
and time the greater value counts, so results never depend on row order. Only the
columns named here are read, so further columns, whatever their names, do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaris.functions.text import clean_name, clean_term


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], values: list[str], at: str = "seen_at") -> DataFrame:
    """One row per key: the values of its latest row.

    A null time is older than any other; rows with a null key column form one key.
    """
    best = F.max(F.struct(F.col(at).alias("_at"), *[F.col(v) for v in values]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def doc_ids(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()


def doc_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, label): the valid label, the file where it is null."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "label", "file", "seen_at")
    return latest(rows, ["doc_id"], ["label", "file"]).select("doc_id", F.coalesce("label", "file").alias("label"))


def categories(cat2id: DataFrame) -> DataFrame:
    """(cat_id, cat, subject), cat being the cleaned name."""
    rows = cat2id.where(F.col("cat_id").isNotNull()).select("cat_id", "name", "subject")
    return rows.groupBy("cat_id").agg(F.min(clean_name(F.col("name"))).alias("cat"), F.min("subject").alias("subject"))


def memberships(doc_cats: DataFrame, cat2id: DataFrame) -> DataFrame:
    """(doc_id, cat_id, deg): valid memberships, names resolved to ids.

    A row without cat_id takes the id of its name; one whose category cannot be told
    is dropped. cat2id is a fixed list of categories, so the join is left to the planner.
    """
    names = categories(cat2id).where(F.col("cat").isNotNull()).groupBy("cat").agg(F.min("cat_id").alias("_by_name"))
    rows = doc_cats.where(F.col("doc_id").isNotNull()).select("doc_id", "cat_id", "name", "deg", "seen_at")
    rows = rows.withColumn("cat", F.when(F.col("cat_id").isNull(), clean_name(F.col("name"))))
    rows = rows.join(names, "cat", "left").withColumn("cat_id", F.coalesce("cat_id", "_by_name"))
    return latest(rows.where(F.col("cat_id").isNotNull()), ["doc_id", "cat_id"], ["deg"])


def best_category(members: DataFrame) -> DataFrame:
    """(doc_id, cat_id): the category of the lowest deg; null deg last, ties to the smaller id."""
    order = F.struct(F.col("deg").isNull().alias("n"), F.col("deg").alias("deg"), F.col("cat_id").alias("cat_id"))
    return members.groupBy("doc_id").agg(F.min(order).alias("_b")).select("doc_id", F.col("_b.cat_id").alias("cat_id"))


def all_categories(members: DataFrame) -> DataFrame:
    """(doc_id, cat_id, deg) of all memberships numbered from 1 by deg, for training that is not exclusive."""
    order = Window.partitionBy("doc_id").orderBy(F.col("deg").asc_nulls_last(), "cat_id")
    return members.select("doc_id", "cat_id", F.row_number().over(order).alias("deg"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def usable(col: Column) -> Column:
    """A double that is a number: not null, not NaN, not infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def counted(tf: DataFrame) -> DataFrame:
    """(doc_id, term, f): valid signature rows with a term and f > 0, one per document and term."""
    rows = tf.where(F.col("doc_id").isNotNull()).select(
        "doc_id", clean_term(F.col("term")).alias("term"), F.col("f").cast("double").alias("f"), "seen_at"
    )
    valid = latest(rows.where(F.col("term").isNotNull()), ["doc_id", "term"], ["f"])
    return valid.where(usable(F.col("f")) & (F.col("f") > 0))


def options(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """mapper_opts as a dict; a fixed list of seven options, read on the driver."""
    rows = load(spark, sf_dir, "mapper_opts").select("opt", "val").distinct().collect()
    return {r["opt"]: float(r["val"]) for r in rows if r["opt"] is not None and r["val"] is not None}
