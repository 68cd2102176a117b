"""Queries in the reduced space of documents, tested by identities and by those of ``extras``, and cross-checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaris.operators import classify, corpus, crosscheck, lsi, matrix, search
from lexaris.plans import catalogue as c
from lexaris.session import cut

RANK = 16


def _model(spark: SparkSession, d: str):
    """(weighted cells, weights, Svd, factors, xdm)."""
    cells = cut(c.tdm0(spark, d), "tdm0")
    tw = cut(matrix.weights(cells, "doc_id", "entropy"), "tw")
    cells = cut(matrix.weighted(cells, tw, 1.0), "tdm")
    s = lsi.svd(cells, "doc_id", RANK)
    return cells, tw, s, s.factors, cut(lsi.project(cells, "doc_id", s.factors, len(s.sigma)), "xdm")


def lsi_singular_values(spark: SparkSession, d: str) -> DataFrame:
    s = _model(spark, d)[2]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(s.sigma)], "i int, sigma double")


def lsi_classify(spark: SparkSession, d: str) -> DataFrame:
    _, _, s, _, xdm = _model(spark, d)
    xcm = cut(lsi.category_vectors("average", xdm, c.dcm(spark, d), len(s.sigma)), "xcm")
    return classify.ranked(lsi.distances(xdm, xcm)).select("doc_id", "cat_id", "d", "deg")


def lsi_bycat(spark: SparkSession, d: str) -> DataFrame:
    """The model whose rows are categories."""
    cells = cut(c.tcm(spark, d).select("term", "cat_id", "v"), "tcm")
    s = lsi.svd(cells, "cat_id", RANK)
    factors = s.factors
    xcm = cut(lsi.project(cells, "cat_id", factors, len(s.sigma)), "xcm")
    docs = matrix.log_transform(c.tdm0(spark, d), c.SMOOTH)
    return classify.ranked(lsi.distances(lsi.project(docs, "doc_id", factors, len(s.sigma)), xcm)).select("doc_id", "cat_id", "d", "deg")


def lsi_kbest_docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents nearest to a query of two terms."""
    _, _, s, factors, xdm = _model(spark, d)
    wanted = spark.createDataFrame([(b, w) for _, b, w in search.parse("Hürde:3 Tor")], "term string, w double")
    terms = cut(factors.join(wanted, "term").select("w", F.col("p").alias("x")), "query")
    q = search.query_vector(terms, None, None, len(s.sigma))
    return search.k_best(xdm, q, "doc_id", 10)


def lsi_kbest_terms(spark: SparkSession, d: str) -> DataFrame:
    _, _, s, factors, _ = _model(spark, d)
    items = factors.withColumnRenamed("p", "x")
    one = cut(items.orderBy("term").limit(1).select(F.lit(1.0).alias("w"), "x"), "query")  # a query of one term
    return search.k_best(items, search.query_vector(one, None, None, len(s.sigma)), "term", 10)


def subcorpus_term_vector(spark: SparkSession, d: str) -> DataFrame:
    """(term, x): terms in the space of the documents of one subject."""
    cells, _, s, _, xdm = _model(spark, d)
    law = c.cats(spark, d).where("subject = 'law'")
    docs = corpus.select_by_category(c.members(spark, d), law)
    rows = cells.join(docs, "doc_id", "left_semi").join(xdm, "doc_id")
    return lsi.vector_sum(rows, "term", lsi.scale(F.col("x"), F.col("v")), len(s.sigma))


def xcheck_summary(spark: SparkSession, d: str) -> DataFrame:
    """(fold, n, accuracy) of three folds balanced by size, and of all."""
    best = cut(c.dcm(spark, d), "dcm")
    folds = cut(corpus.split(c.documents(spark, d).join(best, "doc_id"), 3), "folds")
    return crosscheck.summary(crosscheck.by_folds(cut(c.tdm0(spark, d), "tdm0"), best, folds, 3, c.SMOOTH))


def xcheck_with_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The same under cut-offs fitted on each fold's training documents."""
    best = cut(c.dcm(spark, d), "dcm")
    folds = cut(corpus.split(c.documents(spark, d).join(best, "doc_id"), 3), "folds")
    return crosscheck.summary(crosscheck.by_folds(cut(c.tdm0(spark, d), "tdm0"), best, folds, 3, c.SMOOTH, cutoffs=True))


def xcheck_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(cat1, cat2, ndocs): the pairs of all folds together, folds being told by the documents' numbers."""
    best = cut(c.dcm(spark, d), "dcm")
    folds = best.select("doc_id", F.pmod("doc_id", F.lit(3)).alias("fold"))
    rows = crosscheck.by_folds(cut(c.tdm0(spark, d), "tdm0"), best, folds, 3, c.SMOOTH)
    return rows.groupBy(F.col("wanted").alias("cat1"), F.col("got").alias("cat2")).agg(F.count(F.lit(1)).alias("ndocs"))


ORACLE: dict[str, str] = {
    "xcheck_pairs": f"""with {c._MATRIX}, fs as (select unnest([0, 1, 2]) as fold),
pl as (select t.doc_id, term, f, cat_id, t.doc_id % 3 as own_fold from tdm0 t join dcm using (doc_id)),
k0 as (select fold, term, cat_id, sum(f) as f from pl join fs on own_fold <> fold group by all),
k1 as (select fold, term, log2(sum(f)) - sum(f * log2(f)) / sum(f) as h from k0 group by 1, 2),
k2 as (select fold, log2(count(distinct cat_id)) as top from k0 group by 1),
km as (select fold, term, cat_id, ln(f + 1.001) * (1 - h / top) as v from k0 join k1 using (fold, term) join k2 using (fold)),
kd as (select p.own_fold as fold, doc_id, m.cat_id, sum(p.f * m.v) as dot from pl p join km m on m.fold = own_fold and m.term = p.term group by all),
kn as (select doc_id, own_fold as fold, any_value(cat_id) as wanted, sqrt(sum(f * f)) as nd from pl group by 1, 2),
kc as (select fold, cat_id, sqrt(sum(v * v)) as nc from km group by 1, 2),
kr as (select doc_id, wanted, kc.cat_id, round(greatest(0, least(2, coalesce(1 - coalesce(dot, 0) / nullif(nd * nc, 0), 2))), 6) as d
  from kn join kc using (fold) left join kd using (fold, doc_id, cat_id)),
kb as (select doc_id, wanted, cat_id as got from (select *, row_number() over (partition by doc_id order by d, cat_id) as r from kr) where r = 1)
select wanted as cat1, got as cat2, count(*) as ndocs from kb group by 1, 2"""
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lsi_singular_values, lsi_classify, lsi_bycat, lsi_kbest_docs, lsi_kbest_terms, subcorpus_term_vector,
        xcheck_summary, xcheck_with_cutoffs, xcheck_pairs,
    )
}
