"""Corpora: selection, sizes, ambiguity, splitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.operators.evaluate import category_order
from lexaris.tables import best_category


def union(*corpora: DataFrame) -> DataFrame:
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c)
    return out


def select_by_category(members: DataFrame, cats: DataFrame) -> DataFrame:
    """(doc_id) of documents whose best category is in ``cats`` (cat_id)."""
    return best_category(members).join(cats.select("cat_id"), "cat_id", "left_semi").select("doc_id")


def select_by_ambiguity(members: DataFrame, most: int) -> DataFrame:
    """(doc_id) of documents in at most ``most`` categories."""
    n = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") <= most).select("doc_id")


def select_by_degree(members: DataFrame, most: int) -> DataFrame:
    """Memberships of a degree of at most ``most``; a null degree is none."""
    return members.where(F.col("deg") <= most)


def info(documents: DataFrame, best: DataFrame) -> DataFrame:
    """(cat_id, n_docs, n_bytes, doc_share, byte_share) by best category, in per cent."""
    sums = documents.join(best, "doc_id").groupBy("cat_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("n_bytes", F.lit(0))).alias("n_bytes")
    )
    every = W.partitionBy()  # a row per category
    return sums.select(
        "cat_id", "n_docs", "n_bytes",
        (100.0 * F.col("n_docs") / F.sum("n_docs").over(every)).alias("doc_share"),
        F.try_divide(100.0 * F.col("n_bytes"), F.sum("n_bytes").over(every)).alias("byte_share"),
    )


def size_data(best: DataFrame, cats: DataFrame) -> DataFrame:
    """(cat_id, name, n, share) in the order of the category names."""
    n = best.groupBy("cat_id").agg(F.count(F.lit(1)).alias("n")).join(cats.select("cat_id", "name"), "cat_id")
    share = F.col("n") / F.sum("n").over(W.partitionBy())  # a row per category
    return n.withColumn("share", share).orderBy(*category_order("name"))


def ambiguity(members: DataFrame) -> DataFrame:
    """One row: documents, memberships, documents in one category, mean categories a document."""
    n = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n").alias("n_members"),
        F.count_if(F.col("n") == 1).alias("n_plain"),
        F.avg("n").alias("mean_cats"),
    )


def category_unions(members: DataFrame, names: DataFrame) -> DataFrame:
    """(cats, n_docs): the combinations of categories that documents have."""
    rows = members.join(names.select("cat_id", "cat"), "cat_id")
    per_doc = rows.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("cat")), " | ").alias("cats"))
    return per_doc.groupBy("cats").agg(F.count(F.lit(1)).alias("n_docs"))


def split(documents: DataFrame, n: int, seed: int = 0, block: int = 4096) -> DataFrame:
    """(doc_id, cat_id, fold): ``n`` folds, balanced by size within every category.

    ``documents`` is (doc_id, cat_id, n_bytes). Documents are taken in a seeded random order and each
    goes to the fold with the fewest bytes so far, the first of these on ties. A
    category is dealt in blocks of about ``block`` documents, each balanced by itself,
    so that a category of any size is spread over tasks; folds then differ by at most
    one document's size per block.
    """
    rows = documents.select("doc_id", "cat_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))
    size = rows.groupBy("cat_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    spot = F.xxhash64("doc_id", F.lit(seed))
    rows = rows.join(size, "cat_id").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("blocks")))
    rows = rows.withColumn("spot", spot).drop("blocks")

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        filled, folds = [0] * n, []
        part = part.sort_values(["spot", "doc_id"])
        for size in part["n_bytes"]:
            k = min(range(n), key=lambda i: (filled[i], i))
            filled[k] += size
            folds.append(k)
        return pd.DataFrame({"doc_id": part["doc_id"], "cat_id": part["cat_id"], "fold": folds})

    return rows.groupBy("cat_id", "block").applyInPandas(deal, "doc_id long, cat_id long, fold int")


def category_sizes(tdm0: DataFrame, dcm: DataFrame) -> DataFrame:
    """(cat_id, n_docs, n_tokens, n_types) with a total row (cat_id null), by one rollup."""
    rows = tdm0.join(dcm.select("doc_id", "cat_id"), "doc_id")
    by_doc = rows.groupBy("cat_id", "doc_id").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("cells"))
    return by_doc.rollup("cat_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("f").alias("n_tokens"), F.sum("cells").alias("n_cells")
    )


def semantic_by_category(tdm0: DataFrame, dcm: DataFrame) -> DataFrame:
    """(cat_id, n_sem, n_other): tokens of semantic classes and others of each category, with a total row (cat_id null)."""
    rows = tdm0.join(dcm.select("doc_id", "cat_id"), "doc_id").withColumn("sem", F.col("term").rlike("^SEM"))
    part = lambda sem: F.sum(F.when(F.col("sem") == sem, F.col("f")).otherwise(0.0))
    return rows.rollup("cat_id").agg(part(True).alias("n_sem"), part(False).alias("n_other"))


def profile(cells: DataFrame, marginals: DataFrame, min_freq: float, min_doc_freq: float) -> DataFrame:
    """Cells of a document's profile: f and the term's document frequency of at least the bounds."""
    kept = marginals.where(F.col("tdf0") >= min_doc_freq).select("term")
    return cells.where(F.col("f") >= min_freq).join(kept, "term", "left_semi")


def profile_json(cells: DataFrame, value: str = "v") -> DataFrame:
    """(doc_id, json): a document's terms and weights as JSON, greatest weight first."""
    entry = F.struct((-F.col(value)).alias("k"), F.col("term").alias("text"), F.col(value).alias("weight"))
    per_doc = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))  # a document's own
    list_ = F.transform("e", lambda e: F.struct(e.text.alias("text"), e.weight.alias("weight")))
    return per_doc.select("doc_id", F.to_json(F.struct(list_.alias("doc"))).alias("json"))


def semantic_split(signatures: DataFrame) -> DataFrame:
    """(is_sem, n_terms, n_tokens): terms of semantic classes and others."""
    rows = signatures.withColumn("is_sem", F.col("term").rlike("^SEM"))
    by_term = rows.groupBy("is_sem", "term").agg(F.sum("f").alias("f"))
    return by_term.groupBy("is_sem").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("f").alias("n_tokens"))


def best_terms(cells: DataFrame, by: str, n: int, value: str = "v") -> DataFrame:
    """(by, term, value, rank): the ``n`` terms of highest value of each category or document, ties by term."""
    order = W.partitionBy(by).orderBy(F.desc(value), "term")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(by, "term", value, "rank")
