"""The pN_ queries over a data folder and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaris.llm import encoding, leaks, mixture, neighbours, quota_sample, subjects, term_scores, term_stats, top_items
from lexaris.session import cut
from lexaris.tables import load, options


def _quota_parts(spark: SparkSession, sf_dir: str):
    docs, doc_cats, cat2id, wanted = (load(spark, sf_dir, t) for t in ("docs", "doc_cats", "cat2id", "cat_targets"))
    documents = cut(quota_sample.pool(docs, doc_cats, cat2id), "pool")
    state = cut(quota_sample.reservoirs(documents), "reservoirs")
    share = options(spark, sf_dir)["sampleShare"]
    return documents, state, cut(quota_sample.quotas(state, quota_sample.targets(wanted, cat2id), share), "quotas")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample.report(_quota_parts(spark, sf_dir)[2])


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, state, plan = _quota_parts(spark, sf_dir)
    return quota_sample.sample(documents, plan, state)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _quota_parts(spark, sf_dir)[2]
    return plan.withColumn("wanted", F.round("wanted", 6))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = term_scores.distinctive_terms(load(spark, sf_dir, "tf"))
    return rows.select("doc_id", "term", "lf", "df", F.round("score", 6).alias("score"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scores.outstanding_terms(term_scores.distinctive_terms(load(spark, sf_dir, "tf")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = int(options(spark, sf_dir)["bestDocs"])
    best = top_items.nearest_documents(load(spark, sf_dir, "dist"), load(spark, sf_dir, "docs"), n)
    return best.select("cat_id", "doc_id")


def _subject_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(*[load(spark, sf_dir, t) for t in ("tf", "doc_cats", "cat2id")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subject_areas(spark, sf_dir).where("not seed").select("doc_id", "subject")


def p4_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject, a document with several divided among them."""
    rows = cut(_subject_areas(spark, sf_dir), "areas")
    n = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = rows.join(n, "doc_id").groupBy("subject")
    return out.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum(1.0 / F.col("n")), 6).alias("weight"))


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = options(spark, sf_dir)
    return term_stats.frequencies(load(spark, sf_dir, "tf"), o["minFreq"], o["minDocFreq"], o["maxDocShare"])


def p5_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).select("term", F.round("gf", 6).alias("gf"), "df", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).where("mark is not null").select("term", "mark")


def _neighbours(spark: SparkSession, sf_dir: str, space: str, k: int) -> DataFrame:
    vectors = neighbours.valid_vectors(load(spark, sf_dir, space), versions=space == "xdm")
    return neighbours.nearest(cut(vectors, space), k).withColumn("space", F.lit(space))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = options(spark, sf_dir)
    best = [_neighbours(spark, sf_dir, space, int(o["knn"])) for space in ("xdm", "xcm")]
    out = [neighbours.similar_pairs(b, o["minSim"]).withColumn("space", F.lit(s)) for b, s in zip(best, ("xdm", "xcm"))]
    return out[0].unionByName(out[1]).select("space", "id_a", "id_b")


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = int(options(spark, sf_dir)["knn"])
    out = _neighbours(spark, sf_dir, "xdm", k).unionByName(_neighbours(spark, sf_dir, "xcm", k))
    return out.select("space", "id", "other", "sim", "rank")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def _mix_parts(spark: SparkSession, sf_dir: str):
    sizes = cut(mixture.token_sizes(load(spark, sf_dir, "documents")), "sizes")
    sums = cut(mixture.histogram(sizes), "histogram")
    return sizes, sums, cut(mixture.budgets(sums, load(spark, sf_dir, "source_mix")), "budgets")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix_parts(spark, sf_dir)[2].where("exhausted").select("source").distinct()


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, sums, plan = _mix_parts(spark, sf_dir)
    return mixture.mix(sizes, sums, plan).select("doc_id", "source", "tokens", "n")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, sums, plan = _mix_parts(spark, sf_dir)
    return mixture.report(mixture.mix(sizes, sums, plan), plan)


def p8_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the report is fixed before any text is measured."""
    plan = _mix_parts(spark, sf_dir)[2]
    return plan.select("source", F.round("share", 6).alias("target_share"), "max_repeats")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_tokens(load(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return encoding.restored(documents, cut(encoding.garbled_tokens(documents), "garbled-tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_sample, p1_report, p2_found, p2_scores, p3_found, p4_found, p4_composition,
        p5_found, p5_frequencies, p6_found, p6_neighbours, p7_found, p8_found, p8_mix,
        p8_report, p8_targets, p9_found, p9_restored,
    )
}
