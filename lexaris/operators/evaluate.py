"""Evaluation of wanted against got categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.functions.math import harmonic, precision, recall

#: mode: (pattern a pair's class must match, pattern it must not, classes averaged over). Fixed values.
MODES = (
    ("all", ".", "^$", "."),
    ("nz", ".", "^$", "^(?!null$)"),
    ("nz_picky", ".", "^null-", "."),
    ("safe", ".", "^$", "^safe$"),
    ("safe_picky", "^safe-safe$", "^$", "^safe$"),
    ("unsafe", ".", "^$", "^unsafe$"),
    ("unsafe_picky", "^unsafe-unsafe$", "^$", "^unsafe$"),
)


def category_prefix(name: Column, missing: int = -1) -> Column:
    """The number a category name begins with."""
    digits = F.regexp_extract(name, r"^(\d{1,18})", 1)
    return F.coalesce(F.try_to_number(digits, F.lit("9" * 18)).cast("long"), F.lit(missing).cast("long"))


def category_order(name: str) -> list[Column]:
    """Sort columns: numeric prefix (none first), then the name."""
    return [category_prefix(F.col(name)), F.col(name)]


def category_order_by_rest(name: str) -> list[Column]:
    """Sort columns of the corpus reports: numeric prefix (none as 0), then what follows it."""
    return [category_prefix(F.col(name), 0), F.regexp_replace(name, r"^\d{1,18}", "")]


def wanted_got(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """(label, wanted, got) of labels on both sides; the others are dropped."""
    return wanted.select("label", F.col("cat").alias("wanted")).join(got.select("label", F.col("cat").alias("got")), "label")


def one_sided(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """(label, side) of labels on one side only."""
    a = wanted.join(got, "label", "left_anti").select("label", F.lit("wanted").alias("side"))
    return a.unionByName(got.join(wanted, "label", "left_anti").select("label", F.lit("got").alias("side")))


def pairs(both: DataFrame) -> DataFrame:
    return both.groupBy(F.col("wanted").alias("cat1"), F.col("got").alias("cat2")).agg(F.count(F.lit(1)).alias("ndocs"))


def merge_checked(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of two evaluations given by their documents (label, wanted, got); a label in both raises an error when read."""
    twice = shared_labels(first, second).agg(F.count(F.lit(1)).alias("twice"))
    rows = merge(pairs(first), pairs(second)).crossJoin(F.broadcast(twice))  # one row
    wrong = F.raise_error(F.concat(F.col("twice").cast("string"), F.lit(" labels in both evaluations"))).cast("long")
    return rows.select("cat1", "cat2", F.when(F.col("twice") > 0, wrong).otherwise(F.col("ndocs")).alias("ndocs"))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of two evaluations added up."""
    return first.unionByName(second).groupBy("cat1", "cat2").agg(F.sum("ndocs").alias("ndocs"))


def shared_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """Labels in two evaluations that are to be merged; there must be none."""
    return first.select("label").distinct().join(second.select("label"), "label", "left_semi")


def _sides(p: DataFrame, *keep: str) -> DataFrame:
    """Per pair one row for each category touched: (cat, tp, fp, fn)."""
    same = F.col("cat1") == F.col("cat2")
    n = F.col("ndocs")
    lost = F.struct(F.col("cat1").alias("cat"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), n.alias("fn"))
    extra = F.struct(F.col("cat2").alias("cat"), F.lit(0).cast("long").alias("tp"), n.alias("fp"), F.lit(0).cast("long").alias("fn"))
    hit = F.struct(F.col("cat1").alias("cat"), n.alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return p.select(*keep, F.explode(F.when(same, F.array(hit)).otherwise(F.array(lost, extra))).alias("_s")).select(*keep, "_s.*")


def _scores(df: DataFrame) -> DataFrame:
    df = df.withColumn("pr", precision(F.col("tp"), F.col("fp"))).withColumn("rc", recall(F.col("tp"), F.col("fn")))
    return df.withColumn("F", harmonic(F.col("pr"), F.col("rc"))).withColumn("a", (F.col("pr") + F.col("rc")) / 2)


def by_category(p: DataFrame) -> DataFrame:
    """(cat, tp, fp, fn, pr, rc, F, a)."""
    sums = _sides(p).groupBy("cat").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return _scores(sums)


def null_category(cats: DataFrame) -> DataFrame:
    """One row: the category with most wanted documents, ties by category order."""
    return cats.orderBy(F.desc(F.col("tp") + F.col("fn")), *category_order("cat")).limit(1).select(F.col("cat").alias("null_cat"))


def classes(cats: DataFrame, p: DataFrame, psafe: float = 0.025, null_cat: str | None = "(auto)") -> DataFrame:
    """(cat, class): null, safe (more than psafe of all documents wanted) or unsafe."""
    total = p.agg(F.sum("ndocs").alias("total"))
    null = null_category(cats) if null_cat == "(auto)" else cats.sparkSession.createDataFrame([(null_cat,)], "null_cat string")
    both = cats.select("cat", (F.col("tp") + F.col("fn")).alias("n")).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(null))
    kind = F.when(F.col("cat") == F.col("null_cat"), "null").when(F.col("n") > psafe * F.col("total"), "safe")
    return both.select("cat", kind.otherwise("unsafe").alias("class"))


def classed_pairs(p: DataFrame, cls: DataFrame) -> DataFrame:
    one = cls.select(F.col("cat").alias("cat1"), F.col("class").alias("class1"))
    two = cls.select(F.col("cat").alias("cat2"), F.col("class").alias("class2"))
    return p.join(one, "cat1").join(two, "cat2")


def global_modes(p: DataFrame, cls: DataFrame) -> DataFrame:
    """(mode, tp, fp, fn, pr, rc, F): the seven selections, each in total and averaged over categories."""
    rows = classed_pairs(p, cls)
    modes = p.sparkSession.createDataFrame(MODES, "mode string, allow string, deny string, avg string")
    pair_class = F.concat_ws("-", "class1", "class2")
    picked = rows.crossJoin(F.broadcast(modes)).where(  # seven rows
        F.regexp_like(pair_class, F.col("allow")) & ~F.regexp_like(pair_class, F.col("deny"))
    )
    sides = _sides(picked, "mode", "avg").groupBy("mode", "avg", "cat")
    cats = sides.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).join(cls, "cat")
    cats = _scores(cats.where(F.regexp_like("class", F.col("avg"))))
    total = cats.groupBy("mode").agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn")])
    total = _scores(total).withColumn("mode", F.concat("mode", F.lit(".total"))).drop("a")
    mean = cats.groupBy("mode").agg(*[F.avg(c).alias(c) for c in ("tp", "fp", "fn", "pr", "rc")])
    mean = mean.withColumn("F", harmonic(F.col("pr"), F.col("rc"))).withColumn("mode", F.concat("mode", F.lit(".avg")))
    return total.unionByName(mean.select(total.columns))


def error_shares(p: DataFrame, cls: DataFrame) -> DataFrame:
    """(cat1, cat2, ndocs, fdocs, ferrs): each pair's share of the errors behind the mean F of the categories but the null one.

    The weights of the errors of precision and recall are those that follow from the
    mean precision and recall; a category's errors count by its share of the mean errors.
    """
    rows = classed_pairs(p, cls)
    cats = by_category(p).join(cls, "cat")
    real = cats.where(F.col("class") != "null")
    g = real.agg(*[F.avg(c).alias("g_" + c) for c in ("fp", "fn", "pr", "rc")], F.count(F.lit(1)).alias("n_cats"))
    one = F.lit(1.0)
    a, b = harmonic(1 - F.col("g_pr"), one), harmonic(one, 1 - F.col("g_rc"))
    g = g.select(
        F.try_divide(F.try_divide(a, a + b), F.col("g_fp") * F.col("n_cats")).alias("per_fp"),
        F.try_divide(F.try_divide(b, a + b), F.col("g_fn") * F.col("n_cats")).alias("per_fn"),
    )
    all_docs = p.agg(F.sum("ndocs").alias("all_docs"))
    out = rows.crossJoin(F.broadcast(g)).crossJoin(F.broadcast(all_docs))  # one row each
    # n / fn(cat1) of cat1's share fn(cat1) x per_fn, and alike for precision; the null category has no share
    n = F.col("ndocs")
    lost = F.when(F.col("class1") == "null", 0.0).otherwise(n * F.col("per_fn"))
    extra = F.when(F.col("class2") == "null", 0.0).otherwise(n * F.col("per_fp"))
    ferrs = F.when(F.col("cat1") == F.col("cat2"), 0.0).otherwise(F.coalesce(lost, F.lit(0.0)) + F.coalesce(extra, F.lit(0.0)))
    return out.select("cat1", "cat2", "ndocs", (n / F.col("all_docs")).alias("fdocs"), ferrs.alias("ferrs"))


def error_shares_total(p: DataFrame) -> DataFrame:
    """(cat1, cat2, ndocs, ferrs): each wrong pair's share of all wrong documents."""
    wrong = F.when(F.col("cat1") != F.col("cat2"), F.col("ndocs")).otherwise(0)
    all_wrong = p.agg(F.sum(wrong).alias("all"))
    out = p.crossJoin(F.broadcast(all_wrong))  # one row
    return out.select("cat1", "cat2", "ndocs", F.coalesce(F.try_divide(wrong, F.col("all")), F.lit(0.0)).alias("ferrs"))


def top_errors(errors: DataFrame, n: int) -> DataFrame:
    """The ``n`` pairs with the greatest error share."""
    return errors.orderBy(F.desc("ferrs"), "cat1", "cat2").limit(n)


def conditional(p: DataFrame) -> DataFrame:
    """(cat1, cat2, p12, p1g2, p2g1): joint and conditional shares."""
    n = F.col("ndocs").cast("double")
    return p.select(
        "cat1",
        "cat2",
        (n / F.sum("ndocs").over(W.partitionBy())).alias("p12"),  # pairs of categories
        (n / F.sum("ndocs").over(W.partitionBy("cat2"))).alias("p1g2"),
        (n / F.sum("ndocs").over(W.partitionBy("cat1"))).alias("p2g1"),
    )


def accuracy(both: DataFrame) -> DataFrame:
    return both.agg(F.avg((F.col("wanted") == F.col("got")).cast("double")).alias("accuracy"))


def closer_than_wanted(distances: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """(cat1, cat2, n): how often category cat2 is at most as far (or nearer) as the wanted cat1.

    The wanted distance is joined by document, so a document adds one row per category.
    """
    own = distances.join(wanted.select("doc_id", F.col("cat_id").alias("cat1")), "doc_id")
    own = own.where(F.col("cat_id") == F.col("cat1")).select("doc_id", "cat1", F.col("d").alias("d1"))
    near = distances.join(own, "doc_id")
    near = near.where(F.col("d") < F.col("d1") if strict else F.col("d") <= F.col("d1"))
    return near.groupBy("cat1", F.col("cat_id").alias("cat2")).agg(F.count(F.lit(1)).alias("n"))


def mean_similarity(distances: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cat1, cat2, sim): mean similarity 1 - d / 2 of the documents of cat1 to cat2."""
    rows = distances.join(wanted.select("doc_id", F.col("cat_id").alias("cat1")), "doc_id")
    return rows.groupBy("cat1", F.col("cat_id").alias("cat2")).agg(F.avg(1 - F.col("d") / 2).alias("sim"))


def of_row_maximum(cells: DataFrame, row: str, value: str) -> DataFrame:
    """``cells`` with ``best``: whether the value is the greatest of its row; rows are categories, a short list."""
    return cells.withColumn("best", F.col(value) == F.max(value).over(W.partitionBy(row)))


def report(modes: DataFrame, cats: DataFrame, errors: DataFrame, n: int = 10) -> DataFrame:
    """(part, pos, line): the text report; modes, categories in category order, the top errors."""
    pct = lambda c: F.format_string("%6.2f", 100 * F.col(c))
    m = modes.select(F.lit(1).alias("part"), F.row_number().over(W.orderBy("mode")).alias("pos"),
                     F.format_string("%-20s pr=%s rc=%s F=%s", "mode", pct("pr"), pct("rc"), pct("F")).alias("line"))
    c = cats.select(F.lit(2).alias("part"), F.row_number().over(W.orderBy(*category_order("cat"))).alias("pos"),
                    F.format_string("%-36s tp=%4d fp=%4d fn=%4d F=%s", "cat", "tp", "fp", "fn", pct("F")).alias("line"))
    order = W.orderBy(F.desc("ferrs"), "cat1", "cat2")
    e = top_errors(errors, n).select(F.lit(3).alias("part"), F.row_number().over(order).alias("pos"),
                                     F.format_string("%s %s -> %s (%d)", pct("ferrs"), "cat1", "cat2", "ndocs").alias("line"))
    return m.unionByName(c).unionByName(e)
