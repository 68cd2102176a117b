"""Queries over the file formats: the tables' texts, signatures and models are written in a format and read again.

Contents are made of whole tables; the SQL says what the reader must give back. Queries
of a format take the documents that came in it (``documents.fmt``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaris.functions import text as T
from lexaris.operators import convert, cutoff, evaluate, matrix, signatures
from lexaris.operators.lemmatize import CAB, CONTENT, DDC, PLAIN, RAW, SEM, lemmatize
from lexaris.plans import catalogue as c
from lexaris.registry import resolve
from lexaris.session import cut, scratch
from lexaris.sources import readers, writers
from lexaris.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    return c.registered(QUERIES, ORACLE, name, sql)


_TOK = """tk as (select doc_id, fmt, unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) as term from documents),
tx as (select doc_id, fmt, term, count(*)::double as f from tk group by all)"""
_NAMED = c._CATS + ", nm as (select m.doc_id, m.cat_id, m.deg, k.name from members m join cats k using (cat_id) where k.name is not null)"
_T = "chr(9)"


# ---------------------------------------------------------------- contents


def _terms(col: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+)"), F.lit(1))


def _documents(spark, d, fmt: str) -> DataFrame:
    return load(spark, d, "documents").where(F.col("fmt") == fmt).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def named(spark, d) -> DataFrame:
    """(doc_id, cat_id, name, deg): memberships with their categories' names."""
    return c.members(spark, d).join(c.cats(spark, d).where("name is not null").select("cat_id", "name"), "cat_id").select("doc_id", "cat_id", "name", "deg")


def _file(df: DataFrame, content: Column) -> DataFrame:
    return df.select(F.col("doc_id").cast("string").alias("file"), content.alias("content"))


def _back(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("file").cast("long")).drop("file")


def csv1g_files(spark, d) -> DataFrame:
    """Counts of more than one stand in two lines, which the reader has to add up."""
    rows = signatures.count_tokens(signatures.tokenize(_documents(spark, d, "csv1g")))
    f = F.col("f").cast("long")
    rows = rows.select("doc_id", "term", F.explode(F.when(f > 1, F.array(f - 1, F.lit(1).cast("long"))).otherwise(F.array(f))).alias("n"))
    line = F.concat_ws("\t", F.col("n").cast("string"), "term", "term", "term", F.lit("NN"), "term")
    lines = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("l"))  # a document's own
    return _file(lines, F.concat(F.lit("%%$dc.cat.1=1_x\n\n"), F.array_join("l", "\n")))


def ddctabs_files(spark, d) -> DataFrame:
    head = "%%$DDC:index[0]=Token w\n%%$DDC:index[1]=Lemma l\n%%$DDC:index[2]=Pos p\n"
    lines = F.transform(_terms(), lambda t: F.concat_ws("\t", t, t, F.lit("NN")))
    return _file(_documents(spark, d, "ddctabs"), F.concat(F.lit(head), F.array_join(lines, "\n")))


def _classification(spark, d, rows: DataFrame, misspelt: bool) -> DataFrame:
    """``rows`` with the elements ``cats`` of their memberships; odd categories are misspelt if wanted."""
    tag = F.when((F.col("cat_id") % 2 == 1) & F.lit(misspelt), "vat").otherwise("cat")
    attr = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), readers.escape(value.cast("string")), F.lit('"'))).otherwise("")
    element = F.concat(F.lit("<"), tag, attr("id", F.col("cat_id")), attr("name", F.col("name")), attr("degree", F.col("deg")), F.lit("/>"))
    cats = named(spark, d).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(element)), "").alias("cats"))
    return rows.join(cats, "doc_id", "left").withColumn("cats", F.coalesce("cats", F.lit("")))


def vzxml_files(spark, d) -> DataFrame:
    rows = _classification(spark, d, _documents(spark, d, "vzxml"), misspelt=True)
    w = F.transform(_terms(), lambda t: F.concat(F.lit('<w norm="'), t, F.lit('" pos="a&gt;b>c" lemma="'), t, F.lit('"/>')))
    content = F.concat(
        F.lit("<doc><head><title>Heft &amp; Blatt "), F.col("doc_id").cast("string"), F.lit("</title><classification>"), "cats",
        F.lit("</classification></head><body><thread><posts><post><plain>"), F.array_join(_terms(), " "),
        F.lit("</plain></post><post><plain>zwei</plain></post></posts></thread><cooked type='x'><s>"), F.array_join(w, "\n"), F.lit("</s></cooked></body></doc>"),
    )
    return _file(rows, content)


def cabxml_files(spark, d) -> DataFrame:
    rows = _classification(spark, d, _documents(spark, d, "cabxml"), misspelt=False)
    w = F.transform(_terms(), lambda t: F.concat(
        F.lit('<w t="'), F.initcap(t), F.lit('"><xlit latin1Text="'), t, F.lit('"/><moot word="'), t, F.lit('" tag="NN" lemma="'), t, F.lit('"/></w>')
    ))
    content = F.concat(
        F.lit("<doc><head><classification>"), "cats", F.lit("</classification></head><p>Heft <b>"), F.col("doc_id").cast("string"),
        F.lit("</b></p><s>"), F.array_join(w, "\n"), F.lit("</s></doc>"),
    )
    return _file(rows, content)


# ---------------------------------------------------------------- readers


@query(
    "read_csv1g",
    f"with {_TOK} select doc_id, 'text=' || term || {_T} || 'xlit=' || term || {_T} || 'norm=' || term || {_T} || 'pos=NN' || {_T} || 'lemma=' || term as key, f from tx where fmt = 'csv1g'",
)
def read_csv1g(spark, d):
    return _back(readers.csv1g(csv1g_files(spark, d))).select("doc_id", "key", "f")


@query(
    "read_ddctabs",
    f"with {_TOK} select doc_id, 'text=' || term || {_T} || 'lemma=' || term || {_T} || 'pos=NN' as key, f from tx where fmt = 'ddctabs'",
)
def read_ddctabs(spark, d):
    return _back(readers.ddctabs(ddctabs_files(spark, d))).select("doc_id", "key", "f")


@query(
    "read_vzxml",
    f"with {_TOK} select doc_id, 'norm=' || term || {_T} || 'pos=a>b>c' || {_T} || 'lemma=' || term as key, f from tx where fmt = 'vzxml'",
)
def read_vzxml(spark, d):
    return _back(readers.vzxml(vzxml_files(spark, d))).select("doc_id", "key", "f")


@query(
    "read_vzxml_categories",
    f"with {_NAMED} select doc_id, cat_id, name, coalesce(deg, 0) as deg from nm where doc_id in (select doc_id from documents where fmt = 'vzxml')",
)
def read_vzxml_categories(spark, d):
    return _back(readers.xml_categories(vzxml_files(spark, d))).select("doc_id", "cat_id", "name", "deg")


@query(
    "read_vzxml_text",
    "select doc_id, array_to_string(list_filter(['Heft & Blatt ' || doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '(\\p{L}+)', 1), ' '), 'zwei'], lambda t: t <> ''), chr(10) || chr(10)) as text from documents where fmt = 'vzxml'",
)
def read_vzxml_text(spark, d):
    return _back(readers.xml_text(vzxml_files(spark, d), readers.VZ_TEXT)).select("doc_id", "text")


@query(
    "read_cabxml",
    f"""with tk as (select doc_id, unnest(regexp_extract_all(lower(text), '(\\p{{L}}+)', 1)) as t from documents where fmt = 'cabxml'),
tx as (select doc_id, t, count(*)::double as f from tk group by all)
select doc_id, 'text=' || upper(substr(t, 1, 1)) || substr(t, 2) || {_T} || 'xlit=' || t || {_T} || 'norm=' || t || {_T} || 'pos=NN' || {_T} || 'lemma=' || t as key, f from tx""",
)
def read_cabxml(spark, d):
    return _back(readers.cabxml(cabxml_files(spark, d))).select("doc_id", "key", "f")


@query(
    "read_cabxml_categories",
    f"""with {_NAMED}, cab as (select doc_id from documents where fmt = 'cabxml')
select doc_id, coalesce(cat_id, 1) as cat_id, coalesce(name, 'dummy') as name, case when cat_id is null then 1 else coalesce(deg, 0) end as deg from cab left join nm using (doc_id)""",
)
def read_cabxml_categories(spark, d):
    return _back(readers.xml_categories(cabxml_files(spark, d), misspelt=False, dummy=True)).select("doc_id", "cat_id", "name", "deg")


@query(
    "read_cabxml_text",
    "select doc_id, case when regexp_matches(text, '\\p{L}') then 'Heft ' || doc_id || chr(10) || chr(10) else 'Heft ' || doc_id end as text from documents where fmt = 'cabxml' and not regexp_matches(coalesce(text, ''), '\\p{L}') union all select doc_id, 'Heft ' || doc_id from documents where fmt = 'cabxml' and regexp_matches(text, '\\p{L}')",
)
def read_cabxml_text(spark, d):
    """Words stand in attributes, so that only the paragraph has text, with the number nested in it."""
    return _back(readers.xml_text(cabxml_files(spark, d), readers.CAB_TEXT)).select("doc_id", "text")


@query("read_xml_errors", "select doc_id, doc_id % 7 = 0 as failed from documents where fmt = 'vzxml'")
def read_xml_errors(spark, d):
    """Every seventh file is cut short; it fails by itself and the others go on."""
    broken = F.when(F.col("file").cast("long") % 7 == 0, F.concat(F.col("content"), F.lit("<"))).otherwise(F.col("content"))
    rows = readers.xml_text(vzxml_files(spark, d).withColumn("content", broken), readers.VZ_TEXT)
    return _back(rows).select("doc_id", F.col("error").isNotNull().alias("failed"))


@query(
    "read_comment_categories",
    f"with {_NAMED} select doc_id, 1::bigint as cat_id, cat_id || '_' || name as name, coalesce(deg, 1) as deg from nm",
)
def read_comment_categories(spark, d):
    line = F.concat(F.lit("%%$dc.cat"), F.coalesce(F.concat(F.lit("."), F.col("deg").cast("string")), F.lit("")), F.lit("="), F.col("cat_id").cast("string"), F.lit("_"), "name")
    rows = named(spark, d).groupBy("doc_id").agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    return _back(readers.comment_categories(_file(rows, F.col("content")))).select("doc_id", "cat_id", "name", "deg")


@query("category_list", f"with {c._CATS} select name from cats where name is not null")
def category_list(spark, d):
    rows = c.cats(spark, d).select(F.lit(1).alias("doc_id"), F.concat(F.coalesce("name", F.lit("# none")), F.lit("\tmehr")).alias("line"))
    rows = rows.groupBy("doc_id").agg(F.array_join(F.collect_list("line"), "\n").alias("l"))  # a short list
    return readers.category_list(_file(rows, F.concat(F.lit("# names\n%% x\n\n"), "l")))


@query("grep_categories", f"with {_NAMED} select distinct cat_id, name from nm where doc_id in (select doc_id from documents where fmt = 'vzxml')")
def grep_categories(spark, d):
    return readers.grep_categories(vzxml_files(spark, d))


@query("mode_guess", "select label, case when regexp_matches(lower(label), '\\.xml$') then 'xml' when regexp_matches(lower(label), '\\.1g$') then 'csv1g' when regexp_matches(lower(label), '\\.tabs?$') then 'ddctabs' when regexp_matches(lower(label), '\\.csv$') then 'csv' else 'xml' end as mode from (select distinct file as label from docs where file is not null)")
def mode_guess(spark, d):
    files = load(spark, d, "docs").where("file is not null").select(F.col("file").alias("label")).distinct()
    return convert.translated(files.withColumn("mode", F.col("label")), "mode", readers.mode_of, python=True)


@query(
    "read_any_format",
    f"""with {_TOK} select doc_id, sum(f) as n from tx where fmt in ('csv1g', 'ddctabs', 'vzxml') group by 1""",
)
def read_any_format(spark, d):
    """Files of several formats under one folder, told apart by their suffixes."""
    sides = ((csv1g_files, ".1g"), (ddctabs_files, ".tabs"), (vzxml_files, ".xml"))
    rows = None
    for make, suffix in sides:
        part = make(spark, d).withColumn("file", F.concat("file", F.lit(suffix)))
        rows = part if rows is None else rows.unionByName(part)
    keys = readers.tokens(rows).withColumn("file", T.trim_suffix(F.col("file"), r"\.[^.]*$"))
    return _back(keys.groupBy("file").agg(F.sum("f").alias("n"))).select("doc_id", "n")


@query("find_files", "select lang, count(*) as n, count(*) filter (regexp_matches(text, '\\p{L}'))::bigint as n_text from documents where lang in ('de', 'fr') group by 1")
def find_files(spark, d):
    """A folder per language, searched to any depth for the files of two of them."""
    path = scratch(spark, "files")
    rows = load(spark, d, "documents").where("lang is not null").select("lang", F.when(F.col("text").rlike(r"\p{L}"), "1").otherwise("0").alias("value"))
    rows.repartition("lang").write.partitionBy("lang").text(path)
    found = readers.files(spark, path, match=r"/lang=(de|fr)/[^/]*\.txt$")
    lines = found.select(F.regexp_extract("file", r"/lang=(\w+)/", 1).alias("lang"), F.explode(F.split("content", "\n")).alias("v")).where("v <> ''")
    return lines.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "1").alias("n_text"))


@query("cached_signature", f"with {_TOK} select doc_id, sum(case when doc_id % 2 = 0 then 2 * f else f end) as n from tx where fmt = 'csv1g' group by 1")
def cached_signature(spark, d):
    """Documents of even number have a signature stored, twice as long; only the others are parsed."""
    files = csv1g_files(spark, d)
    stored = cut(readers.csv1g(files.where(F.col("file").cast("long") % 2 == 0)).withColumn("f", 2 * F.col("f")), "signatures")
    return _back(readers.signature_of(files, stored, readers.csv1g).groupBy("file").agg(F.sum("f").alias("n"))).select("doc_id", "n")


# ---------------------------------------------------------------- signatures


_F = "case when f = floor(f) then floor(f)::bigint::varchar else f::varchar end"


def _stored(spark, d, write) -> DataFrame:
    """The tables' signatures with their categories, written in a format, as files."""
    terms = c.tf(spark, d)
    cats = named(spark, d).where("deg is not null").join(terms.select("doc_id").distinct(), "doc_id", "left_semi")
    path = scratch(spark, "signatures")
    writers.write_lines(write(terms, cats), path)
    return writers.read_lines(spark, path)


@query(
    "write_signature_csv",
    f"""with {c._TF}, {_NAMED},
lines as (select doc_id, 0 as part, deg::double as k, '<' || deg || '> ' || cat_id || ' ' || name as line from nm where deg is not null and doc_id in (select doc_id from tfc)
  union all select doc_id, 1, -f, term || {_T} || {_F} from tfc)
select doc_id, row_number() over (partition by doc_id order by part, k, encode(line)) as pos, line from lines""",
)
def write_signature_csv(spark, d):
    terms = c.tf(spark, d)
    cats = named(spark, d).where("deg is not null").join(terms.select("doc_id"), "doc_id", "left_semi")
    return writers.signature_csv(terms, cats)


@query(
    "write_signature_1g",
    f"""with {c._TF}, {_NAMED},
lines as (select doc_id, 0 as part, deg::double as k, '%%$dc.cat.' || deg || '=' || cat_id || '_' || name as line from nm where deg is not null and doc_id in (select doc_id from tfc)
  union all select distinct doc_id, 1, 0::double, '%%$dc.lemmata' from tfc
  union all select doc_id, 2, -f, {_F} || {_T} || term from tfc)
select doc_id, row_number() over (partition by doc_id order by part, k, encode(line)) as pos, line from lines""",
)
def write_signature_1g(spark, d):
    terms = c.tf(spark, d)
    cats = named(spark, d).where("deg is not null").join(terms.select("doc_id"), "doc_id", "left_semi")
    return writers.signature_1g(terms, cats)


@query("signature_csv_terms", f"with {c._TF} select doc_id, term, round(f, 6) as f from tfc")
def signature_csv_terms(spark, d):
    return _back(readers.signature_csv(_stored(spark, d, writers.signature_csv))[0]).select("doc_id", "term", c.r6("f"))


@query("signature_csv_categories", f"with {c._TF}, {_NAMED} select doc_id, cat_id, name, least(deg, 3) as deg from nm where deg is not null and doc_id in (select doc_id from tfc)")
def signature_csv_categories(spark, d):
    return _back(readers.signature_csv(_stored(spark, d, writers.signature_csv))[1]).select("doc_id", "cat_id", "name", "deg")


@query("signature_1g_terms", f"with {c._TF} select doc_id, 'lemmata' as section, term, round(f, 6) as f from tfc")
def signature_1g_terms(spark, d):
    return _back(readers.signature_1g(_stored(spark, d, writers.signature_1g))).select("doc_id", "section", "term", c.r6("f"))


@query("signature_1g_categories", f"with {c._TF}, {_NAMED} select doc_id, cat_id, name, deg from nm where deg is not null and doc_id in (select doc_id from tfc)")
def signature_1g_categories(spark, d):
    return _back(readers.signature_1g_categories(_stored(spark, d, writers.signature_1g))).select("doc_id", "cat_id", "name", "deg")


# ---------------------------------------------------------------- corpora, evaluations, models


@query(
    "corpus_xml",
    f"""with {_NAMED}, b as (select doc_id, label, file, bytes from (select *, row_number() over (partition by doc_id order by seen_at desc nulls last, label desc nulls last, file desc nulls last, bytes desc nulls last) as r from docs) where r = 1)
select b.doc_id as id, b.label, b.file, b.bytes, count(m.cat_id) as n_cats, sum(m.cat_id)::bigint as cats, sum(m.deg)::bigint as degs from b left join nm m using (doc_id) group by 1, 2, 3, 4""",
)
def corpus_xml(spark, d):
    from lexaris.tables import latest

    docs = latest(load(spark, d, "docs").where("doc_id is not null"), ["doc_id"], ["label", "file", "bytes"])
    entry = F.struct(F.col("cat_id").alias("id"), "name", "deg")
    cats = named(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("cat"))
    path = scratch(spark, "corpus")
    writers.corpus_xml(docs.join(cats, "doc_id", "left").withColumnRenamed("doc_id", "id").withColumn("class", F.lit("vzxml")), path)
    rows = readers.corpus_xml(spark, path)
    sum_ = lambda n: F.aggregate("cat", F.lit(None).cast("long"), lambda a, x: F.coalesce(a + x[n], x[n].cast("long"), a))
    return rows.select("id", "label", "file", "bytes", F.coalesce(F.size("cat"), F.lit(0)).cast("long").alias("n_cats"), sum_("id").alias("cats"), sum_("deg").alias("degs"))


@query("eval_xml_pairs", f"with {c._BOTH} select cat1, cat2, ndocs from pairs")
def eval_xml_pairs(spark, d):
    path = scratch(spark, "eval")
    writers.eval_xml(c.pairs(spark, d), path)
    return readers.eval_xml(spark, path).select("cat1", "cat2", "ndocs")


@query("eval_xml_categories", f"with {c._BOTH} select cat as name, class, tp, fp, fn from bycat join cls using (cat)")
def eval_xml_categories(spark, d):
    path, p = scratch(spark, "eval"), cut(c.pairs(spark, d), "pairs")
    cats = evaluate.by_category(p)
    writers.eval_xml(cats.join(evaluate.classes(cats, p), "cat").withColumnRenamed("cat", "name").drop("a"), path, "cat")
    return readers.eval_xml(spark, path, "cat").select("name", "class", "tp", "fp", "fn")


@query("eval_xml_documents", f"with {c._BOTH} select label::varchar as label, wanted, got from wg")
def eval_xml_documents(spark, d):
    path = scratch(spark, "eval")
    writers.eval_xml(c.both(spark, d), path, "doc")
    return readers.eval_xml(spark, path, "doc")


@query("model_folder", f"with {c._MATRIX} select 'tdm0' as name, count(*) as n, round(sum(f), 4) as f from tdm0 union all select 'tcm0', count(*), round(sum(f), 4) from tcm0 union all select 'options', 1, 1.001")
def model_folder(spark, d):
    return _model_checks(spark, d, lambda tables, path: writers.save_model(tables, path, {"smoothf": c.SMOOTH}), writers.load_model, True)


@query("model_text_folder", f"with {c._MATRIX} select 'tdm0' as name, count(*) as n, round(sum(f), 4) as f from tdm0 union all select 'tcm0', count(*), round(sum(f), 4) from tcm0")
def model_text_folder(spark, d):
    return _model_checks(spark, d, writers.save_text_model, writers.load_text_model, False)


def _model_checks(spark, d, save, load_, options: bool) -> DataFrame:
    path, cells = scratch(spark, "model"), cut(c.tdm0(spark, d), "tdm0")
    save({"tdm0": cells, "tcm0": matrix.term_category(cells, c.dcm(spark, d))}, path)
    out = None
    for name, df in load_(spark, path, ["tdm0", "tcm0"]).items():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f"), 4).alias("f")).select(F.lit(name).alias("name"), "n", "f")
        out = row if out is None else out.unionByName(row)
    if options:
        kept = float(writers.load_options(spark, path)["smoothf"])
        out = out.unionByName(spark.createDataFrame([("options", 1, kept)], "name string, n long, f double"))
    return out


def decided_pairs(spark, d) -> DataFrame:
    """(wanted, got): category ids of the cut-off decisions."""
    m, w = cut(c.full_matrix(spark, d), "full"), cut(c.wanted(spark, d), "wanted")
    got = cutoff.decide(m, c.cuts(spark, d))
    return w.select("doc_id", F.col("cat_id").alias("wanted")).join(got, "doc_id").select("wanted", "got")


@query(
    "cutoff_dump",
    f"""with {c._CUT},
n1 as (select own as cat_id, count(*) as n1, count(*) filter (own = got) as tp from decided group by 1), n2 as (select got as cat_id, count(*) as n2 from decided group by 1)
select k.cat_id, coalesce(try_cast(regexp_extract(k.name, '^([0-9]+)', 1) as bigint), -1) as id_guess, round(cutoff, 6) as cutoff, coalesce(tp, 0) as tp, coalesce(n2, 0) - coalesce(tp, 0) as fp, coalesce(n1, 0) - coalesce(tp, 0) as fn,
  regexp_replace(k.name, '\\s', '_', 'g') as name from cuts join cats k using (cat_id) left join n1 using (cat_id) left join n2 using (cat_id)""",
)
def cutoff_dump(spark, d):
    rows = writers.cutoff_table(c.cuts(spark, d), c.cats(spark, d), cut(decided_pairs(spark, d), "decided"))
    return rows.select("cat_id", "id_guess", c.r6("cutoff"), "tp", "fp", "fn", "name")


@query(
    "cutoff_histogram",
    f"""with {c._CUT}, n as (select own as c1, got as c2, count(*) as n12 from decided group by 1, 2)
select a.cat_id as c1, b.cat_id as c2, coalesce(n12, 0) as n12, coalesce((select count(*) from decided where own = a.cat_id), 0) as n1, coalesce((select count(*) from decided where got = b.cat_id), 0) as n2
from cats a cross join cats b left join n on n.c1 = a.cat_id and n.c2 = b.cat_id""",
)
def cutoff_histogram(spark, d):
    return writers.confusion_table(c.cats(spark, d), cut(decided_pairs(spark, d), "decided"))


@query(
    "output_names",
    "select distinct file, case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') else '.' end || '/' || regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '') || '.sig' as out from docs where file is not null",
)
def output_names(spark, d):
    files = load(spark, d, "docs").where("file is not null").select("file").distinct()
    return files.select("file", T.output_name(F.col("file"), suffix=".sig").alias("out"))


@query(
    "short_labels",
    "select distinct file, regexp_replace(regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^0-9].*$', ''), '\\.([0-9]+)$', '?p=\\1') as short from docs where file is not null",
)
def short_labels(spark, d):
    files = load(spark, d, "docs").where("file is not null").select("file").distinct()
    return convert.translated(files.withColumn("short", F.col("file")), "short", T.short_label)


# ---------------------------------------------------------------- conversions, cleaning


@query(
    "convert_to_signature",
    f"with {_TOK} select doc_id, doc_id || '.sig' as out, term || {_T} || floor(f)::bigint as line from tx where fmt = 'csv1g' union all select distinct doc_id, doc_id || '.sig', '<1> 1 1_x' from tx where fmt = 'csv1g'",
)
def convert_to_signature(spark, d):
    rows = convert.tokens_to_signature(csv1g_files(spark, d), resolve("lemmatizer", "cab"), "csv1g")
    return _back(rows).select("doc_id", F.regexp_replace("out", r"^\./", "").alias("out"), "line")


@query(
    "convert_to_csv",
    f"with {_TOK} select doc_id, 'text=' || term || {_T} || 'lemma=' || term || {_T} || 'pos=NN' || {_T} || floor(f)::bigint as line from tx where fmt = 'ddctabs'",
)
def convert_to_csv(spark, d):
    return _back(convert.tokens_to_csv(ddctabs_files(spark, d), "ddctabs")).select("doc_id", "line")


@query("convert_csv_to_signature", f"with {_TOK} select doc_id, term || {_T} || floor(f)::bigint as line from tx where fmt = 'ddctabs'")
def convert_csv_to_signature(spark, d):
    lines = convert.tokens_to_csv(ddctabs_files(spark, d), "ddctabs")
    files = lines.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda l: l.line), "\n").alias("content"))
    return _back(convert.csv_to_signature(files, DDC)).select("doc_id", "line")


@query("convert_signature_to_csv", f"with {c._TF}, {_NAMED} select doc_id, '<' || least(deg, 3) || '> ' || cat_id || ' ' || name as line from nm where deg is not null and deg <= 3 and doc_id in (select doc_id from tfc) union all select doc_id, '<' || deg || '> ' || cat_id || ' ' || name from nm where deg > 3 and doc_id in (select doc_id from tfc) union all select doc_id, term || {_T} || {_F} from tfc")
def convert_signature_to_csv(spark, d):
    return _back(convert.signature_to_csv(_stored(spark, d, writers.signature_1g))).select("doc_id", "line")


@query("convert_xml_to_raw", "select doc_id, length(array_to_string(list_filter(['Heft & Blatt ' || doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '(\\p{L}+)', 1), ' '), 'zwei'], lambda t: t <> ''), chr(10) || chr(10))) as n_chars from documents where fmt = 'vzxml'")
def convert_xml_to_raw(spark, d):
    return _back(convert.xml_to_raw(vzxml_files(spark, d))).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(
    "corpus_of_files",
    f"""with {_NAMED}, v as (select doc_id from documents where fmt = 'vzxml')
select row_number() over (order by encode(doc_id::varchar)) - 1 as id, doc_id::varchar as label, (select count(*) from nm where nm.doc_id = v.doc_id) as n_cats from v""",
)
def corpus_of_files(spark, d):
    rows = convert.create_corpus(cut(vzxml_files(spark, d), "files"))
    return rows.select("id", "label", F.coalesce(F.size("cat"), F.lit(0)).cast("long").alias("n_cats"))


@query(
    "corpus_compiled",
    f"with {_TOK}, v as (select doc_id, row_number() over (order by encode(doc_id::varchar)) - 1 as id from documents where fmt = 'ddctabs') select id, term, f from tx join v using (doc_id)",
)
def corpus_compiled(spark, d):
    return convert.compile_corpus(cut(ddctabs_files(spark, d), "files"), DDC, "ddctabs")[1]


_CLEAN = "coalesce(text, '')"


@query(
    "xml_clean",
    f"select doc_id, '<head><description>' || replace(replace(replace(replace(replace({_CLEAN}, '&', '&amp;'), '''', '&apos;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</description><cat id=\"1\"/></head>' as head from documents",
)
def xml_clean(spark, d):
    rows = load(spark, d, "documents").select("doc_id", readers.escape(F.coalesce("text", F.lit(""))).alias("t"))
    content = F.concat(F.lit("<doc><head><descrition>"), "t", F.lit('</descrition><vat id="1"/></head><body>x</body></doc>'))
    return rows.select("doc_id", readers.head(readers.clean_xml(content)).alias("head"))


@query("xml_head_and_post", "select doc_id, '<head>h' || doc_id || '</head><post>p' || doc_id || '</post>' as part from documents")
def xml_head_and_post(spark, d):
    n = F.col("doc_id").cast("string")
    content = F.concat(F.lit("<doc><head>h"), n, F.lit("</head><body><thread><posts><post>p"), n, F.lit("</post><post>q</post></posts></thread><thread><post>r</post></thread></body></doc>"))
    return load(spark, d, "documents").select("doc_id", readers.head_and_first_post(content).alias("part"))


# ---------------------------------------------------------------- lemmatizers

_KEYED = """tx as (select doc_id, unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) as t from documents),
k as (select doc_id, t, length(t) as n, count(*)::double as f from tx group by all),
p as (select *, case when n % 3 = 0 then 'ART' when n % 3 = 1 then 'NN' else 'VVFIN' end as pos,
  case when n % 5 = 0 then substr(t, 1, 2) || '-' || substr(t, 3) else t end as lemma from k)"""


def keys(spark, d) -> DataFrame:
    """Tokens of the texts with tags, compounds and semantic classes made up from their lengths."""
    rows = signatures.count_tokens(signatures.tokenize(load(spark, d, "documents")))
    n, t = F.length("term"), F.col("term")
    tag = F.when(n % 3 == 0, "ART").when(n % 3 == 1, "NN").otherwise("VVFIN")
    parted = lambda sign: F.concat(t.substr(1, 2), F.lit(sign), t.substr(F.lit(3), n))
    lemma = F.when(n % 5 == 0, parted("-")).otherwise(t)
    extra = F.when(n % 5 == 0, F.concat(F.lit("\tsep_lemma="), parted("|#"), F.lit("\tsem_lemma=SEM"), n.cast("string"), F.lit("x"))).otherwise("")
    key = F.concat(F.lit("text="), F.initcap("term"), F.lit("\tnorm="), t, F.lit("\tplain="), t, F.lit("\tpos="), tag, F.lit("\tlemma="), lemma, extra)
    return rows.select("doc_id", key.alias("key"), "f")


@query("lemma_raw", f"with {_KEYED} select doc_id, count(*) as n, sum(f) as f from p group by 1")
def lemma_raw(spark, d):
    return lemmatize(keys(spark, d), RAW).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f"))


@query("lemma_plain", f"with {_KEYED} select doc_id, t as term, f from p where regexp_matches(t, '[a-zA-Z0-9]')")
def lemma_plain(spark, d):
    return lemmatize(keys(spark, d), PLAIN)


@query("lemma_cab", f"with {_KEYED} select doc_id, lemma as term, sum(f) as f from p where pos = 'NN' or pos like 'VV%' group by 1, 2")
def lemma_cab(spark, d):
    return lemmatize(keys(spark, d), CAB)


@query("lemma_ddc", f"with {_KEYED} select doc_id, lemma as term, sum(f) as f from p where pos = 'NN' or pos like 'VV%' group by 1, 2")
def lemma_ddc(spark, d):
    return lemmatize(keys(spark, d), resolve("lemmatizer", "Lemmatizer::DDC"))


@query(
    "lemma_default",
    f"""with {_KEYED}, g as (select * from p where pos <> 'ART' and regexp_matches(t, '[a-zA-Z0-9]')),
o as (select doc_id, lemma as term, 3 * f as f from g
  union all select doc_id, unnest(regexp_extract_all(lemma, '([^-]+)', 1)), f from g where n % 5 = 0
  union all select doc_id, unnest(list_filter(string_split(substr(t, 1, 2) || ' ' || substr(t, 3), ' '), lambda x: x <> '')), f from g where n % 5 = 0
  union all select doc_id, 'SEM' || n || 'x', 10 * f from g where n % 5 = 0
  union all select doc_id, 'SEM' || n, 10 * f from g where n % 5 = 0)
select doc_id, term, sum(f) as f from o group by 1, 2""",
)
def lemma_default(spark, d):
    return lemmatize(keys(spark, d), resolve("lemmatizer", None))


@query(
    "lemma_stopped",
    f"""with {_KEYED}, s as (select term from (select t as term, count(*) as df from k group by 1) where df > 100)
select doc_id, lemma as term, sum(f) as f from p where pos <> 'ART' and regexp_matches(t, '[a-zA-Z0-9]') and t not in (select term from s) group by 1, 2""",
)
def lemma_stopped(spark, d):
    """The words of more than 100 documents are the stop list."""
    rows = signatures.count_tokens(signatures.tokenize(load(spark, d, "documents")))
    stop = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 100").select(F.col("term").alias("text"))
    return lemmatize(keys(spark, d), CONTENT, stop)


@query(
    "semantic_split_default",
    f"""with {_KEYED}, g as (select * from p where pos <> 'ART' and regexp_matches(t, '[a-zA-Z0-9]'))
select n % 5 = 0 and x = 1 as is_sem, sum(case when x = 1 then 20 * f else (case when n % 5 = 0 then 3 + 2 * (case when n = 5 then 2 else 2 end) else 3 end) * f end) as n_tokens
from g cross join (values (0), (1)) v(x) where x = 0 or n % 5 = 0 group by 1""",
)
def semantic_split_default(spark, d):
    from lexaris.operators.corpus import semantic_split

    return semantic_split(lemmatize(keys(spark, d), SEM)).select("is_sem", "n_tokens")


# ---------------------------------------------------------------- a stream of documents


@query(
    "stream_classified",
    f"""with {c._MATRIX},
tk as (select doc_id, unnest(regexp_extract_all(lower(text), '(\\p{{L}}+)', 1)) as term from documents),
t2 as (select doc_id, term, count(*)::double as f from tk where term in (select term from kept) group by 1, 2),
dots as (select doc_id, cat_id, sum(t.f * v.v) as dot from t2 t join tcm v using (term) group by 1, 2),
ndoc as (select doc_id, sqrt(sum(f * f)) as nd from t2 group by 1), ncat as (select cat_id, sqrt(sum(v * v)) as nc from tcm group by 1),
r as (select d.doc_id, u.cat_id, round(greatest(0, least(2, coalesce(1 - coalesce(dot, 0) / (nd * nc), 2))), 6) as d
  from documents d cross join (select distinct cat_id from tcm) u left join ndoc using (doc_id) left join ncat using (cat_id) left join dots using (doc_id, cat_id))
select doc_id, cat_id, d from (select *, row_number() over (partition by doc_id order by d, cat_id) as deg from r) where deg = 1""",
)
def stream_classified(spark, d):
    """All texts come in as a stream of files and are classified by a model of the signatures."""
    from lexaris.streaming.classify import start

    cells = cut(c.tdm0(spark, d), "tdm0")
    by_cat = cut(matrix.term_category(cells, c.dcm(spark, d)), "tcm0")
    tcm = cut(matrix.weighted(by_cat, matrix.weights(by_cat, "cat_id", "entropy"), c.SMOOTH), "tcm")
    source, sink, state = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    load(spark, d, "documents").select("doc_id", "text").write.parquet(source)
    start(spark, source, sink, state, cut(cells.select("term").distinct(), "vocabulary"), tcm).awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "cat_id", "d")
