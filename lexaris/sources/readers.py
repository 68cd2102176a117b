"""Readers: token sources, signatures, corpora, category lists.

Files are read whole, one row each, with their path; a file must fit a task's memory, as
one document does. Tokens come as (file, key, f), the key holding ``ATTR=VALUE`` pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed values: attribute names of the tab dumps and of the 1-gram files
DDC_NAMES = {"Token": "text", "Word": "text", "Utf8": "text", "CanonicalToken": "norm", "Lemma": "lemma", "Pos": "pos"}
CSV1G_NAMES = ("text", "xlit", "norm", "pos", "lemma")
MODES = {".xml": "xml", ".1g": "csv1g", ".csv": "csv", ".tab": "ddctabs", ".tabs": "ddctabs", ".parquet": "parquet", ".json": "json"}


#: What may stand between the name of an element and its end; a ``>`` within a value is no end.
_ATTRIBUTES = r"""(?:[^<>"'/]|/(?!>)|"[^"]*"|'[^']*')*"""


def mode_of(path: str, default: str = "xml") -> str:
    """The format that a file's suffix tells."""
    return next((m for suffix, m in MODES.items() if path.lower().endswith(suffix)), default)


def files(spark: SparkSession, path: str, match: str | None = None, recursive: bool = True) -> DataFrame:
    """(file, content) of the files under ``path`` whose name matches, folders searched to any depth."""
    df = spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return df.where(F.regexp_like("file", F.lit(match))) if match else df


def _lines(df: DataFrame) -> DataFrame:
    """(file, pos, line)."""
    return df.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _unescaped(c: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def vzxml(df: DataFrame) -> DataFrame:
    """(file, key, f): every attribute of every ``<w>``, in document order, as one key."""
    w = df.select("file", F.explode(F.regexp_extract_all("content", F.lit(rf"(?s)<w\s({_ATTRIBUTES})/?>"), F.lit(1))).alias("a"))
    pairs = F.regexp_extract_all("a", F.lit(r"""(?s)([\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1))
    one = lambda p: F.concat(
        F.regexp_extract(p, r"^([\w:.-]+)", 1), F.lit("="), _squeezed(_unescaped(F.regexp_extract(p, r"""(?s)=\s*["'](.*)["']$""", 1)))
    )
    keys = w.select("file", F.array_join(F.transform(pairs, one), "\t").alias("key")).where("key <> ''")
    return keys.groupBy("file", "key").agg(F.count(F.lit(1)).cast("double").alias("f"))


def cabxml(df: DataFrame) -> DataFrame:
    """(file, key, f) with text, xlit, norm, pos and lemma of every ``<w>``; absent ones are left out."""
    w = df.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(<w[\s>/].*?(?:</w>|/>(?=\s*<(?:w|/s))))"), F.lit(1))).alias("w"))
    head = F.regexp_extract("w", r"(?s)^<w([^>]*)>", 1)
    inner = lambda tag: F.regexp_extract("w", rf"(?s)<{tag}\b([^>]*)>", 1)

    def attr(where: Column, *names: str) -> Column:
        found = [F.regexp_extract(where, rf"""(?s)(?:^|\s){n}\s*=\s*["']([^"']*)["']""", 1) for n in names]
        return F.coalesce(*[F.when(f != "", _squeezed(_unescaped(f))) for f in found])

    values = {
        "text": attr(head, "text", "t"),
        "xlit": F.coalesce(attr(inner("xlit"), "latin1Text"), attr(head, "xlit", "u")),
        "norm": attr(inner("moot"), "word"),
        "pos": attr(inner("moot"), "tag"),
        "lemma": attr(inner("moot"), "lemma"),
    }
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{n}="), v)) for n, v in values.items()]
    keys = w.select("file", F.concat_ws("\t", *parts).alias("key")).where("key <> ''")
    return keys.groupBy("file", "key").agg(F.count(F.lit(1)).cast("double").alias("f"))


def xml_categories(df: DataFrame, misspelt: bool = True, dummy: bool = False) -> DataFrame:
    """(file, cat_id, name, deg) of the classification in the head; ``vat`` counts as ``cat`` if ``misspelt``.

    Defaults: degree 0, name unknown. With ``dummy`` a file without any gets (1, dummy, 1).
    """
    names = ("id", "name", "degree")
    whole = df.withColumn("cats", F.regexp_extract_all("content", F.lit(rf"(?s)<(?:{'cat|vat' if misspelt else 'cat'})\s({_ATTRIBUTES})/?>"), F.lit(1)))
    get = lambda a, n: F.regexp_extract(a, rf"""(?:^|\s){n}\s*=\s*["']([^"']*)["']""", 1)
    rows = whole.select("file", F.explode_outer("cats").alias("a"))
    out = rows.select(
        "file",
        F.try_to_number(get(F.col("a"), names[0]), F.lit("9" * 18)).cast("long").alias("cat_id"),
        F.coalesce(F.when(get(F.col("a"), names[1]) != "", _unescaped(get(F.col("a"), names[1]))), F.lit("unknown")).alias("name"),
        F.coalesce(F.try_to_number(get(F.col("a"), names[2]), F.lit("9" * 9)).cast("int"), F.lit(0)).alias("deg"),
        F.col("a").isNull().alias("none"),
    )
    if dummy:
        return out.select(
            "file",
            F.when(F.col("none"), 1).otherwise(F.col("cat_id")).cast("long").alias("cat_id"),
            F.when(F.col("none"), "dummy").otherwise(F.col("name")).alias("name"),
            F.when(F.col("none"), 1).otherwise(F.col("deg")).alias("deg"),
        )
    return out.where("not none").drop("none")


def process_files(df: DataFrame, each: Callable[[str, str], Iterable[tuple]], schema: str) -> DataFrame:
    """(file, ``schema``, error): what ``each`` makes of every file's name and content.

    A file that raises gives one row with the error and nulls, and the others go on.
    """
    fields = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for file, content in zip(rows["file"], rows["content"], strict=True):
                try:
                    out += [(file, *row, None) for row in each(file, content)]
                except Exception as e:  # noqa: BLE001 - whatever a file's callback raises belongs in its row
                    out.append((file, *[None] * len(fields), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file", *fields, "error"], dtype=object)

    return df.select("file", "content").mapInPandas(run, f"file string, {schema}, error string")


def _texts_at(paths: tuple[str, ...]):
    def each(_: str, content: str) -> list[tuple[str]]:
        root = ElementTree.fromstring(content)
        found = (e for p in paths for e in root.findall(p))
        return [("\n\n".join(t for t in ("".join(e.itertext()).strip() for e in found) if t),)]

    return each


def xml_text(df: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """(file, text, error): the text of the elements at ``paths``, with all text within them, joined by blank lines.

    Malformed XML gives the error and no text.
    """
    return process_files(df, _texts_at(paths), "text string")


# fixed values: the elements that hold a document's text
VZ_TEXT = (".//head/title", ".//head/descrition", ".//head/description", ".//thread/title", ".//post/plain")
CAB_TEXT = ("./p", "./s")


def csv1g(df: DataFrame, names: tuple[str, ...] = CSV1G_NAMES) -> DataFrame:
    """(file, key, f) of lines ``FREQ TAB V1 TAB V2 ...``; blank and ``%%`` lines are skipped, fractions kept."""
    rows = _lines(df).where(~F.col("line").rlike(r"^\s*$|^%%")).withColumn("v", F.split("line", "\t", len(names) + 1))
    named = [F.when(F.get("v", F.lit(i + 1)).isNotNull(), F.concat(F.lit(f"{n}="), F.get("v", F.lit(i + 1)))) for i, n in enumerate(names)]
    rows = rows.select("file", F.concat_ws("\t", *named).alias("key"), F.try_to_number(F.get("v", F.lit(0)), F.lit("999999999999.999999")).cast("double").alias("f"))
    return rows.where("f is not null").groupBy("file", "key").agg(F.sum("f").alias("f"))


def comment_categories(df: DataFrame) -> DataFrame:
    """(file, cat_id, name, deg) of ``%%$dc.cat[.DEG]=NAME`` and ``%%$dc.symcat...`` lines; the id is 1, the degree by default 1."""
    rows = _lines(df).where(F.col("line").rlike(r"^%%\$dc\.(?:sym)?cat(?:\.\d+)?="))
    deg = F.regexp_extract("line", r"cat\.(\d{1,9})=", 1)
    return rows.select(
        "file", F.lit(1).cast("long").alias("cat_id"), F.regexp_extract("line", r"=(.*)$", 1).alias("name"),
        F.coalesce(F.try_to_number(deg, F.lit("9" * 9)).cast("int"), F.lit(1)).alias("deg"),
    )


def ddctabs(df: DataFrame) -> DataFrame:
    """(file, key, f): each line a token, its columns named by ``%%$DDC:index[i]=LONG SHORT`` lines of the file."""
    lines = _lines(df)
    named = lines.where(F.col("line").rlike(r"^%%\$DDC:index\[\d+\]="))
    short = F.regexp_extract("line", r"=(\S+)", 1)
    table = F.create_map(*[F.lit(x) for pair in DDC_NAMES.items() for x in pair])
    named = named.select("file", F.regexp_extract("line", r"\[(\d{1,9})\]", 1).cast("int").alias("i"), F.coalesce(F.element_at(table, short), short).alias("n"))
    heads = named.groupBy("file").agg(F.map_from_entries(F.array_agg(F.struct("i", "n"))).alias("names"))
    rows = lines.where(~F.col("line").rlike(r"^\s*$|^%%")).join(heads, "file").withColumn("v", F.split("line", "\t"))
    key = F.filter(F.transform("v", lambda x, i: F.concat(F.element_at("names", i), F.lit("="), x)), lambda k: k.isNotNull())
    return rows.select("file", F.array_join(key, "\t").alias("key")).groupBy("file", "key").agg(F.count(F.lit(1)).cast("double").alias("f"))


def signature_csv(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, term, f) and (file, cat_id, name, deg) of a signature table; degrees are at most 3."""
    lines = _lines(df).where(~F.col("line").rlike(r"^\s*$"))
    terms = lines.where(F.contains("line", F.lit("\t")))
    terms = terms.select("file", F.regexp_extract("line", r"^(.*)\t[^\t]*$", 1).alias("term"), F.regexp_extract("line", r"\t([^\t]*)$", 1).alias("f"))
    terms = terms.select("file", "term", F.try_to_number("f", F.lit("999999999999.999999")).cast("double").alias("f"))
    cats = lines.where(F.col("line").rlike(r"^<\d+>\s+\d+\s+\S"))
    part = lambda i: F.regexp_extract("line", r"^<(\d{1,9})>\s+(\d{1,18})\s+(.*)$", i)
    return terms, cats.select("file", part(2).cast("long").alias("cat_id"), part(3).alias("name"), F.least(part(1).cast("int"), F.lit(3)).alias("deg"))


def signature_1g(df: DataFrame) -> DataFrame:
    """(file, section, term, f), section being terms or lemmata, by the last section line before; terms at first."""
    from pyspark.sql import Window as W

    mark = F.regexp_extract("line", r"^%%\$dc\.(terms|lemmata)", 1)
    order = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = _lines(df).withColumn("section", F.last(F.when(mark != "", mark), ignorenulls=True).over(order))
    rows = rows.where(~F.col("line").rlike(r"^\s*$|^%%")).withColumn("v", F.split("line", "\t", 2))
    f = F.try_to_number(F.get("v", F.lit(0)), F.lit("999999999999.999999")).cast("double")
    return rows.select("file", F.coalesce("section", F.lit("terms")).alias("section"), F.get("v", F.lit(1)).alias("term"), f.alias("f"))


def signature_1g_categories(df: DataFrame) -> DataFrame:
    """(file, cat_id, name, deg) of a signature's ``%%$dc.cat.DEG=ID_NAME`` lines; without a number the id is null."""
    rows = comment_categories(df)
    number = F.regexp_extract("name", r"^(\d{1,18})_", 1)
    return rows.select(
        "file", F.try_to_number(number, F.lit("9" * 18)).cast("long").alias("cat_id"),
        F.regexp_replace("name", r"^\d{1,18}_", "").alias("name"), "deg",
    )


def corpus_xml(spark: SparkSession, path: str) -> DataFrame:
    """Documents of corpus files, one row each with its ``cat`` elements; what an element lacks is null."""
    cat = "_id:long,_name:string,_deg:int,_sim:double,_dist_raw:double,_cut:int,_confp:double,_confi:int,_proto:string"
    schema = f"_id long, _class string, _label string, _file string, _bytes long, _sigFile string, cat array<struct<{cat}>>"
    df = spark.read.format("xml").option("rowTag", "doc").schema(schema).load(path)
    names = [field.split(":")[0][1:] for field in cat.split(",")]
    cats = F.transform("cat", lambda c: F.struct(*[c[f"_{n}"].alias(n) for n in names]))
    return df.select(*[F.col("_" + c).alias(c) for c in ("id", "class", "label", "file", "bytes", "sigFile")], cats.alias("cat"))


def corpus_label(spark: SparkSession, path: str) -> DataFrame:
    """(label) of the corpus files under ``path``."""
    df = spark.read.format("xml").option("rowTag", "corpus").schema("_label string").load(path)
    return df.select(F.col("_label").alias("label")).distinct()


# fixed values: the parts of an evaluation file and their attributes
EVAL_PARTS = {
    "pair": "_cat1 string, _cat2 string, _class1 string, _class2 string, _ndocs long, _fdocs double, _ferrs double",
    "mode": "_name string, _tp double, _fp double, _fn double, _pr double, _rc double, _F double",
    "cat": "_name string, _class string, _tp long, _fp long, _fn long, _pr double, _rc double, _F double",
    "doc": "_label string, _wanted string, _got string",
}


def eval_xml(spark: SparkSession, path: str, part: str = "pair") -> DataFrame:
    """The ``part`` elements (pair, mode, cat or doc) of evaluation files; what an element lacks is null."""
    df = spark.read.format("xml").option("rowTag", part).schema(EVAL_PARTS[part]).load(path)
    return df.select(*[F.col(c).alias(c[1:]) for c in df.columns])


def category_list(df: DataFrame) -> DataFrame:
    """(name): the first field of each line that is not blank or a comment."""
    rows = _lines(df).where(~F.col("line").rlike(r"^\s*$|^\s*#|^%%"))
    return rows.select(F.split("line", "\t")[0].alias("name")).distinct()


def grep_categories(df: DataFrame) -> DataFrame:
    """(cat_id, name): the distinct categories of all files."""
    return xml_categories(df).select("cat_id", "name").distinct()


def clean_xml(content: Column) -> Column:
    """Misspelt elements renamed."""
    for wrong, right in (("vat", "cat"), ("descrition", "description")):
        content = F.regexp_replace(content, rf"<(/?){wrong}\b", f"<$1{right}")
    return content


def escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def head(content: Column) -> Column:
    return F.regexp_extract(content, r"(?s)(<head\b.*?</head>)", 1)


def head_and_first_post(content: Column) -> Column:
    """The head, and the first post of the first thread."""
    thread = F.regexp_extract(content, r"(?s)<thread\b.*?</thread>", 0)
    return F.concat(head(content), F.regexp_extract(thread, r"(?s)<post\b.*?</post>", 0))


def signature_of(df: DataFrame, cached: DataFrame | None, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(file, key, f): the cached signature of a file where there is one, else what ``parse`` makes of it."""
    if cached is None:
        return parse(df)
    missing = df.join(cached.select("file").distinct(), "file", "left_anti")
    known = cached.join(df.select("file").distinct(), "file", "left_semi")
    return known.select("file", "key", "f").unionByName(parse(missing).select("file", "key", "f"))


#: Parsers of token files by mode.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "xml": vzxml, "vzxml": vzxml, "cabxml": cabxml, "csv1g": csv1g, "ddctabs": ddctabs,
    "csv": lambda df: signature_csv(df)[0].withColumnRenamed("term", "key"),
}


def tokens(df: DataFrame, mode: str | None = None) -> DataFrame:
    """(file, key, f) of files of any format: of ``mode``, or of what each file's suffix tells."""
    if mode is not None:
        return PARSERS[mode](df).select("file", "key", "f")
    out = None
    for name, parse in PARSERS.items():
        suffixes = [s for s, m in MODES.items() if m == name]
        if suffixes:
            pattern = "|".join(s.replace(".", r"\.") + "$" for s in suffixes)
            named = F.lower("file").rlike(pattern)
            if name == "xml":  # also files of no known suffix
                others = "|".join(s.replace(".", r"\.") + "$" for s in MODES if MODES[s] != "xml")
                named = named | ~F.lower("file").rlike(others)
            part = parse(df.where(named)).select("file", "key", "f")
            out = part if out is None else out.unionByName(part)
    return out
