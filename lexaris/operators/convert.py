"""Conversions from one format to another, and corpora made of files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaris.functions.text import output_name
from lexaris.operators.lemmatize import Lemmatizer, lemmatize
from lexaris.sources import readers, writers

# fixed values: suffixes of what is written
SUFFIX = {"csv": ".csv", "sig": ".sig", "raw": ".raw"}


def _by_file(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("file", "doc_id")


def tokens_to_csv(df: DataFrame, mode: str | None = None) -> DataFrame:
    """(file, out, pos, line): the token counts of files as signature tables, most frequent first."""
    rows = _by_file(readers.tokens(df, mode).withColumnRenamed("key", "term"))
    return _placed(writers.signature_csv(rows, _categories_of(df)), "csv")


def tokens_to_signature(df: DataFrame, lemmatizer: Lemmatizer | None, mode: str | None = None) -> DataFrame:
    """(file, out, pos, line): lemmatised signatures of token files, with their categories."""
    rows = lemmatize(_by_file(readers.tokens(df, mode)), lemmatizer)
    return _placed(writers.signature_csv(rows, _categories_of(df)), "sig")


def csv_to_signature(df: DataFrame, lemmatizer: Lemmatizer | None) -> DataFrame:
    """(file, out, pos, line): tables of token counts lemmatised."""
    terms, cats = readers.signature_csv(df)
    rows = lemmatize(_by_file(terms.withColumnRenamed("term", "key")), lemmatizer)
    return _placed(writers.signature_csv(rows, _by_file(cats)), "sig")


def signature_to_csv(df: DataFrame) -> DataFrame:
    """(file, out, pos, line): 1-gram signatures as tables."""
    terms, cats = readers.signature_1g(df).select("file", "term", "f"), readers.signature_1g_categories(df)
    return _placed(writers.signature_csv(_by_file(terms), _by_file(cats)), "csv")


def xml_to_raw(df: DataFrame, paths: tuple[str, ...] = readers.VZ_TEXT) -> DataFrame:
    """(file, out, text): the raw text; files that are no XML are left out."""
    rows = readers.xml_text(df, paths).where("error is null")
    return rows.select("file", output_name(F.col("file"), suffix=SUFFIX["raw"]).alias("out"), "text")


def _categories_of(df: DataFrame) -> DataFrame:
    return _by_file(readers.xml_categories(df).unionByName(readers.comment_categories(df)))


def _placed(lines: DataFrame, kind: str) -> DataFrame:
    out = output_name(F.col("doc_id"), suffix=SUFFIX[kind])
    return lines.select(F.col("doc_id").alias("file"), out.alias("out"), "pos", "line")


def create_corpus(df: DataFrame, mode: str = "xml") -> DataFrame:
    """(id, label, file, bytes, cat): a corpus of files; ids follow the order of the names.

    A file's label is its name; its categories are those of its format, degrees 0 if unknown.
    """
    from lexaris.operators.trim import number

    cats = readers.xml_categories(df) if mode in ("xml", "vzxml", "cabxml") else readers.comment_categories(df)
    entry = F.struct(F.col("cat_id").alias("id"), "name", "deg")
    cats = cats.groupBy("file").agg(F.sort_array(F.collect_list(entry)).alias("cat"))  # a document's own
    rows = df.select("file", F.octet_length("content").cast("long").alias("bytes")).join(number(df, "file", "id"), "file")
    rows = rows.join(cats, "file", "left").select("id", F.col("file").alias("label"), "file", "bytes", "cat")
    return rows


def compile_corpus(df: DataFrame, lemmatizer: Lemmatizer | None, mode: str = "xml") -> tuple[DataFrame, DataFrame]:
    """The corpus of files and its signatures (id, term, f)."""
    corpus = create_corpus(df, mode)
    rows = lemmatize(_by_file(readers.tokens(df, mode)), lemmatizer)
    return corpus, rows.join(corpus.select("id", F.col("file").alias("doc_id")), "doc_id").select("id", "term", "f")


def save_corpus(spark: SparkSession, corpus: DataFrame, signatures: DataFrame, path: str) -> None:
    writers.save_model({"docs": corpus, "signatures": signatures}, path)


def translated(labels: DataFrame, column: str, each: Callable[[str], str] | Callable[[Column], Column], python: bool = False) -> DataFrame:
    """``labels`` with ``column`` translated: by a column expression, or by a Python function in Arrow batches."""
    if not python:
        return labels.withColumn(column, each(F.col(column)))

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else each(n))

    return labels.withColumn(column, run(column))
