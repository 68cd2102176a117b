"""How distinctive a term is for a document: tf x smoothed idf with length normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaris.session import cut
from lexaris.tables import counted


def term_weights(signatures: DataFrame) -> DataFrame:
    """(term, df, termWeight): documents with the term and ln((1 + N) / (1 + df)) + 1.

    ``signatures`` has one row (doc_id, term, f) per document and term. N is the number
    of documents in it. The count combines on the map side, so the commonest term costs
    each task one counter.
    """
    n_docs = signatures.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    by_term = signatures.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
    return by_term.crossJoin(F.broadcast(n_docs)).select("term", "df", weight.alias("termWeight"))  # one row


def distinctive_terms(tf: DataFrame) -> DataFrame:
    """(doc_id, term, lf, doc_length, share, df, termWeight, score) for every counted row of tf.

    ``score`` is share x termWeight, share being lf over the sum of lf in the document.
    Rows whose term is null or blank or whose f is null, NaN, infinite, zero or negative
    score nothing; of repeated and late rows the latest holds. An empty table gives an
    empty result. A term held by a third of all rows is joined by key with adaptive
    splitting of that key; no document or term is gathered whole.
    """
    rows = cut(counted(tf).withColumnRenamed("f", "lf"), "signatures")
    lengths = rows.groupBy("doc_id").agg(F.sum("lf").alias("doc_length"))
    weights = term_weights(rows.withColumnRenamed("lf", "f"))
    scored = rows.join(lengths, "doc_id").join(weights, "term")
    share = F.col("lf") / F.col("doc_length")
    return scored.select(
        "doc_id", "term", "lf", "doc_length", share.alias("share"), "df", "termWeight",
        (share * F.col("termWeight")).alias("score"),
    )


def outstanding_terms(
    scored: DataFrame, min_lf: float = 4, min_share: float = 0.03, min_df: int = 2, max_df: int = 12
) -> DataFrame:
    """(doc_id, term): terms that set their document apart and that few other documents share."""
    heavy = (F.col("lf") >= min_lf) & (F.col("lf") >= F.col("doc_length") * min_share)
    return scored.where(heavy & F.col("df").between(min_df, max_df)).select("doc_id", "term")
