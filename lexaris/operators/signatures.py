"""Signatures: counted tokens and terms of documents, as long tables (doc_id, term, f)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokenize(documents: DataFrame) -> DataFrame:
    """(doc_id, term): runs of letters in lower case; null and empty texts give none."""
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    return documents.select("doc_id", F.explode(letters).alias("term"))


def count_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("double").alias("f"))


def lengths(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("doc_id").agg(F.sum("f").alias("n"))


def global_frequencies(signatures: DataFrame) -> DataFrame:
    """(term, gf, df); one row per document and term is expected."""
    return signatures.groupBy("term").agg(F.sum("f").alias("gf"), F.count(F.lit(1)).alias("df"))


def merge_terms(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second).groupBy("doc_id", "term").agg(F.sum("f").alias("f"))


def merge_categories(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, name, cat_id, deg): the least degree and the least known id of each category."""
    both = first.unionByName(second)
    return both.groupBy("doc_id", "name").agg(F.min("cat_id").alias("cat_id"), F.min("deg").alias("deg"))


def token_list(signatures: DataFrame) -> DataFrame:
    """(doc_id, term) with each term repeated as often as it occurs, fractions cut off."""
    return signatures.select("doc_id", F.explode(F.array_repeat("term", F.col("f").cast("int"))).alias("term"))


def sizes(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.octet_length(text).alias("n_bytes"), F.length(text).alias("n_chars"))
