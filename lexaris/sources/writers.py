"""Writers: signatures, corpora, reports, models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lexaris.functions.text import underscored
from lexaris.operators.evaluate import category_prefix
from lexaris.session import checked


def signature_csv(terms: DataFrame, cats: DataFrame) -> DataFrame:
    """(doc_id, pos, line): category lines by degree, then terms by falling frequency."""
    from pyspark.sql import Window as W

    c = cats.select("doc_id", F.lit(0).alias("part"), F.col("deg").cast("double").alias("k"), F.format_string("<%d> %d %s", "deg", "cat_id", "name").alias("line"))
    f = F.format_string("%s\t%s", F.col("term"), F.regexp_replace(F.col("f").cast("string"), r"\.0$", ""))
    t = terms.select("doc_id", F.lit(1).alias("part"), (-F.col("f")).alias("k"), f.alias("line"))
    order = W.partitionBy("doc_id").orderBy("part", "k", "line")  # a document's own lines
    return c.unionByName(t).select("doc_id", F.row_number().over(order).alias("pos"), "line")


def signature_1g(terms: DataFrame, cats: DataFrame, section: str = "lemmata") -> DataFrame:
    """(doc_id, pos, line): category comments, the section line, then ``FREQ TAB ITEM``."""
    from pyspark.sql import Window as W

    c = cats.select("doc_id", F.lit(0).alias("part"), F.col("deg").cast("double").alias("k"), F.format_string("%%%%$dc.cat.%d=%d_%s", "deg", "cat_id", "name").alias("line"))
    s = terms.select("doc_id").distinct().select("doc_id", F.lit(1).alias("part"), F.lit(0.0).alias("k"), F.lit(f"%%$dc.{section}").alias("line"))
    f = F.format_string("%s\t%s", F.regexp_replace(F.col("f").cast("string"), r"\.0$", ""), F.col("term"))
    t = terms.select("doc_id", F.lit(2).alias("part"), (-F.col("f")).alias("k"), f.alias("line"))
    order = W.partitionBy("doc_id").orderBy("part", "k", "line")
    return c.unionByName(s).unionByName(t).select("doc_id", F.row_number().over(order).alias("pos"), "line")


def write_lines(lines: DataFrame, path: str, parts: int = 64) -> None:
    """Text files of documents' lines in order, each document after a comment ``%%$dc.doc=ID``.

    Documents are dealt to ``parts`` folders, so their number does not grow with theirs.
    """
    head = lines.select("doc_id").distinct().select("doc_id", F.lit(0).alias("pos"), F.format_string("%%%%$dc.doc=%s", "doc_id").alias("line"))
    rows = head.unionByName(lines.select("doc_id", F.col("pos").cast("int").alias("pos"), "line"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    rows = rows.repartition("part").sortWithinPartitions("part", "doc_id", "pos")
    rows.select("part", F.col("line").alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of documents written by ``write_lines``, file being the document's id."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    docs = whole.select(F.explode(F.filter(F.split("value", r"(?m)^%%\$dc\.doc="), lambda d: d != "")).alias("d"))
    return docs.select(F.regexp_extract("d", r"^([^\n]*)", 1).alias("file"), F.regexp_extract("d", r"(?s)^[^\n]*\n?(.*)$", 1).alias("content"))


def corpus_xml(docs: DataFrame, path: str, cats: bool = True) -> None:
    """Corpus files with a ``doc`` element each row, with its ``cat`` elements if wanted; columns that are missing are left out."""
    present = [c for c in ("id", "class", "label", "file", "bytes", "sigFile") if c in docs.columns]
    rows = docs.select(*[F.col(c).alias("_" + c) for c in present], *(["cat"] if cats else []))
    if cats:
        names = rows.schema["cat"].dataType.elementType.names
        rows = rows.withColumn("cat", F.transform("cat", lambda c: F.struct(*[c[n].alias("_" + n) for n in names])))
    rows.write.mode("overwrite").format("xml").option("rootTag", "corpus").option("rowTag", "doc").save(path)


def eval_xml(rows: DataFrame, path: str, part: str = "pair") -> None:
    """Evaluation files of one part: its pairs, modes, categories or documents."""
    rows.select(*[F.col(c).alias("_" + c) for c in rows.columns]).write.mode("overwrite").format("xml").option(
        "rootTag", "eval"
    ).option("rowTag", part).save(path)


def cutoff_table(cuts: DataFrame, names: DataFrame, both: DataFrame) -> DataFrame:
    """(cat_id, id_guess, mu0, sd0, mu1, sd1, cutoff, tp, fp, fn, name): the cut-off dump, names with blanks as underscores.

    ``both`` is (wanted, got) of the documents, as category ids; ``id_guess`` is the number
    that the name begins with, -1 without one.
    """
    n1, n2 = both.groupBy(F.col("wanted").alias("cat_id")), both.groupBy(F.col("got").alias("cat_id"))
    hits = F.count_if(F.col("wanted") == F.col("got"))
    sums = n1.agg(F.count(F.lit(1)).alias("n1"), hits.alias("tp")).join(n2.agg(F.count(F.lit(1)).alias("n2")), "cat_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = cuts.join(names.select("cat_id", "name"), "cat_id").join(sums, "cat_id", "left")
    return rows.select(
        "cat_id", category_prefix(F.col("name")).alias("id_guess"), "mu0", "sd0", "mu1", "sd1", "cutoff",
        zero("tp").alias("tp"), (zero("n2") - zero("tp")).alias("fp"), (zero("n1") - zero("tp")).alias("fn"),
        underscored(F.col("name")).alias("name"),
    )


def confusion_table(cats: DataFrame, both: DataFrame) -> DataFrame:
    """(c1, c2, n12, n1, n2) of all pairs of categories, a short list: documents wanted in c1 and got in c2, in all, and got."""
    n12 = both.groupBy(F.col("wanted").alias("c1"), F.col("got").alias("c2")).agg(F.count(F.lit(1)).alias("n12"))
    n1 = both.groupBy(F.col("wanted").alias("c1")).agg(F.count(F.lit(1)).alias("n1"))
    n2 = both.groupBy(F.col("got").alias("c2")).agg(F.count(F.lit(1)).alias("n2"))
    one, two = cats.select(F.col("cat_id").alias("c1")), cats.select(F.col("cat_id").alias("c2"))
    full = one.crossJoin(checked(two)).join(n12, ["c1", "c2"], "left").join(n1, "c1", "left").join(n2, "c2", "left")
    return full.select("c1", "c2", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n12", "n1", "n2")])


def dump_lines(table: DataFrame, sep: str = " ") -> DataFrame:
    """(line) of the columns of ``table`` in order."""
    return table.select(F.concat_ws(sep, *table.columns).alias("line"))


def save_model(tables: dict[str, DataFrame], path: str, options: dict | None = None) -> None:
    """One Parquet folder per table, and the options as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if options is not None and tables:
        spark = next(iter(tables.values())).sparkSession
        rows = spark.createDataFrame([(k, str(v)) for k, v in options.items()], "opt string, val string")
        rows.coalesce(1).write.mode("overwrite").json(f"{path}/options")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def load_options(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["opt"]: r["val"] for r in spark.read.schema("opt string, val string").json(f"{path}/options").collect()}



def save_text_model(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of tab-separated text per table, vectors as numbers between blanks, and its columns as JSON."""
    for name, df in tables.items():
        flat = [
            F.array_join(F.transform(c.name, lambda v: v.cast("string")), " ").alias(c.name) if isinstance(c.dataType, ArrayType) else F.col(c.name)
            for c in df.schema
        ]
        df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{name}")
        kept = df.sparkSession.createDataFrame([(df.schema.json(),)], "columns string")
        kept.coalesce(1).write.mode("overwrite").text(f"{path}/{name}.columns")


def load_text_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        columns = StructType.fromJson(json.loads(spark.read.text(f"{path}/{name}.columns").first()[0]))
        flat = ", ".join(f"`{c.name}` string" for c in columns)
        df = spark.read.option("sep", "\t").option("header", True).schema(flat).csv(f"{path}/{name}")
        out[name] = df.select(
            *[(F.split(c.name, " ") if isinstance(c.dataType, ArrayType) else F.col(c.name)).cast(c.dataType).alias(c.name) for c in columns]
        )
    return out
