"""Term-document and term-category matrices in coordinate form, and term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_category(tdm0: DataFrame, dcm: DataFrame) -> DataFrame:
    """(term, cat_id, f): frequencies summed over the documents of each category; the degree does not matter."""
    docs = dcm.select("doc_id", "cat_id")
    return tdm0.join(docs, "doc_id").groupBy("term", "cat_id").agg(F.sum("f").alias("f"))


def smoothing(cells: DataFrame) -> DataFrame:
    """One row (s): number of terms over the sum of all frequencies, the constant used if none is given."""
    n = cells.select("term").distinct().agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(cells.agg(F.sum("f").alias("total"))).select(F.try_divide("n", "total").alias("s"))


def smoothing_by_category(cells: DataFrame) -> DataFrame:
    """One row (s): number of categories over the sum of all frequencies, for a model of categories."""
    return cells.agg(F.try_divide(F.count_distinct("cat_id"), F.sum("f")).alias("s"))


def checked_weights(tw: DataFrame) -> DataFrame:
    """``tw`` as it is; a weight that is infinite, no number or negative raises an error when read."""
    bad = F.isnan("tw") | (F.abs("tw") == float("inf")) | (F.col("tw") < -1e-12)
    message = F.concat(F.lit("bad weight of term "), F.col("term"))
    return tw.withColumn("tw", F.when(bad, F.raise_error(message).cast("double")).otherwise(F.col("tw")))


def recompiled(tdm0: DataFrame, dcm: DataFrame, min_freq: float, min_doc_freq: float, method: str, s: float) -> tuple[DataFrame, DataFrame]:
    """(tdm, tcm) built anew under other bounds and weights from a model's raw matrix."""
    from lexaris.operators.trim import trim

    cells = trim(tdm0, min_freq, min_doc_freq)
    tdm = weighted(cells, weights(cells, "doc_id", method), s)
    by_cat = term_category(cells, dcm)
    return tdm, weighted(by_cat, weights(by_cat, "cat_id", method), s)


def log_transform(cells: DataFrame, s: float) -> DataFrame:
    return cells.withColumn("v", F.log(F.col("f") + s))


def method_name(method: str) -> str:
    """The weighting that an option value names, by its first letters."""
    m = method.lower()
    if m[:1] == "u" or m[:2] in ("no", "id"):
        return "uniform"
    if m.startswith("entropy") and m[7:8] and m[8:9] == "q" or method.startswith("Hq"):
        return "entropy-quotient"
    if m.startswith("cond") or method.startswith("Hc"):
        return "conditional-entropy"
    if m.startswith("max") or method.startswith("H") or m.startswith("entropy"):
        return "max-entropy-quotient"
    raise ValueError(f"unknown term weight {method!r}")


def _entropy(cells: DataFrame, by: str) -> DataFrame:
    """(term, h): entropy in bits of the term's distribution over ``by``.

    From sums of f and f log f, so that one aggregation with map-side combining does.
    """
    f = F.col("f")
    sums = cells.groupBy("term").agg(F.sum("f").alias("ft"), F.sum(f * F.log2(f)).alias("flf"))
    return sums.select("term", "ft", (F.log2("ft") - F.col("flf") / F.col("ft")).alias("h"))


def weights(cells: DataFrame, by: str, method: str = "entropy", raw: float = 0.0, cooked: float = 1.0) -> DataFrame:
    """(term, tw): raw + cooked x weight; ``by`` is the column that the entropy runs over.

    uniform 1; max-entropy-quotient 1 - H/log2(N); entropy-quotient 1 - H/H(D), H(D) of the
    smoothed document sizes; conditional-entropy H. N is the number of values of ``by``;
    with one value only the quotients are undefined, which raises an error when read.
    """
    name = method_name(method)
    if name == "uniform":
        w = cells.select("term").distinct().withColumn("w", F.lit(1.0))
    else:
        h = _entropy(cells, by)
        if name == "conditional-entropy":
            w = h.select("term", F.col("h").alias("w"))
        else:
            if name == "max-entropy-quotient":
                top = cells.select(by).distinct().agg(F.log2(F.count(F.lit(1))).alias("top"))
            else:
                size = cells.groupBy(by).agg(F.sum("f").alias("n"))
                p = size.crossJoin(F.broadcast(size.agg(F.sum("n").alias("all"), F.min("n").alias("least"))))  # one row
                eps = 0.5 * F.col("least") / F.col("all")
                q = (1 - eps) * (F.col("n") / F.col("all")) + eps
                top = p.agg(F.sum(-q * F.log2(q)).alias("top"))
            w = h.crossJoin(F.broadcast(top)).select("term", (1 - F.col("h") / F.col("top")).alias("w"))  # one row
    return w.select("term", (F.lit(raw) + F.lit(cooked) * F.col("w")).alias("tw"))


def weighted(cells: DataFrame, tw: DataFrame, s: float) -> DataFrame:
    """Cells with v = log(f + s) x tw."""
    return cells.join(tw, "term").withColumn("v", F.log(F.col("f") + s) * F.col("tw"))


def inverted(v: Column, tw: Column, s: float) -> Column:
    """The frequency behind a weighted value; null for weight 0."""
    return F.exp(F.try_divide(v, tw)) - s


def raw_weight(tw: Column, raw: float, cooked: float) -> Column:
    return (tw - raw) / cooked


def marginals(cells: DataFrame) -> DataFrame:
    """(term, tf0, tdf0): the frequency, and the documents in which it is at least 1."""
    return cells.groupBy("term").agg(F.sum("f").alias("tf0"), F.count_if(F.col("f") >= 1).alias("tdf0"))
