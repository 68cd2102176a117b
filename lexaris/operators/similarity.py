"""Similarities of documents and categories made of the tails of two normal distributions.

``c1`` is the distribution of the distances of a category's own documents, ``c0`` that of
the others; p1 and p0 are how probable a distance up to the one seen is under each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaris.functions.math import erf_sql, f1, gauss_cdf, gauss_width, smoothed
from lexaris.session import checked

EPS = 1e-5


def tails(distances: DataFrame, fits: DataFrame, wanted: DataFrame) -> DataFrame:
    """``distances`` (doc_id, cat_id, d) with p1, p0 of the category, g1, g0 of all categories, n, share and others.

    ``fits`` is (cat_id, mu0, sd0, mu1, sd1), a row a category. g1 and g0 use the mean of
    the categories' means and deviations. ``n`` is the number of the category's documents,
    ``share`` and ``others`` those of it and of the rest among all.
    """
    size = wanted.groupBy("cat_id").agg(F.count(F.lit(1)).alias("n"))
    everything = fits.agg(*[F.avg(c).alias("g_" + c) for c in ("mu0", "sd0", "mu1", "sd1")])
    all_ = wanted.agg(F.count(F.lit(1)).alias("all"))
    side = fits.join(size, "cat_id", "left").crossJoin(F.broadcast(everything)).crossJoin(F.broadcast(all_))  # one row each
    side = side.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("most", F.greatest(F.lit(1), F.col("n")))
    rows = distances.join(checked(side), "cat_id")
    d = F.col("d")
    # a degenerate fit tells nothing
    p = lambda mu, sd: smoothed(F.coalesce(gauss_cdf(d, F.col(mu), F.col(sd)), F.lit(0.5)), EPS)
    return rows.select(
        "doc_id", "cat_id", "d", "mu0", "sd0", "mu1", "sd1", "n",
        p("mu1", "sd1").alias("p1"), p("mu0", "sd0").alias("p0"), p("g_mu1", "g_sd1").alias("g1"), p("g_mu0", "g_sd0").alias("g0"),
        (F.col("n") / F.col("all")).alias("share"), (1 - F.col("n") / F.col("all")).alias("others"),
    )


def _fb(pr: Column, rc: Column, beta: Column) -> Column:
    a, b = smoothed(pr, EPS), smoothed(rc, EPS)
    return (1 + beta * beta) * (a * b) / (beta * beta * a + b)


def _cut(d: Column, at: Column) -> Column:
    """Distances beyond a cut-off are as far as can be."""
    return F.when(d > at, d + 100.0).otherwise(d)


def _cut0(p: float) -> Column:
    return F.col("mu0") - gauss_width(p, F.col("sd0"))


def _cut1(p: float) -> Column:
    return F.col("mu1") + gauss_width(p, F.col("sd1"))


def formulas() -> dict[str, tuple[Column, bool]]:
    """Each formula by name, and whether the greatest value is the best rather than the least."""
    d, p1, p0, g1, g0 = (F.col(c) for c in ("d", "p1", "p0", "g1", "g0"))
    n, share, others = (F.col(c) for c in ("n", "share", "others"))
    q1, q0 = 1 - p1, 1 - p0
    out = {
        "distance": (d, False),
        "tail of own": (p1, False),
        "tail of others": (p0, False),
        "F1 of tails": (f1(q1, q0, EPS), True),
        "F beta n": (_fb(q1, q0, n.cast("double")), True),
        "F beta share": (_fb(q1, q0, share), True),
        "F beta rest": (_fb(q1, q0, 1 - share), True),
        "F beta 1 - others": (_fb(q1, q0, 1 - others), True),
        "F beta 2 - others": (_fb(q1, q0, 2 - others), True),
        "F beta 1 + share": (_fb(q1, q0, 1 + share), True),
        "F beta exp": (_fb(q1, q0, F.exp(-share)), True),
        "own ^ share": (F.pow(p1, share), False),
        "own of all ^ share": (F.pow(g1, share), False),
        "others of all ^ share": (F.pow(g0, share), False),
        "sum of all": (F.pow(g1, share) + F.pow(g0, others), False),
        "sum": (F.pow(p1, share) + F.pow(p0, others), False),
        "product": (F.pow(p1, share) * F.pow(p0, others), False),
    }
    for p in (0.8, 0.9, 0.95, 0.99, 0.999):
        out[f"cut-off of others {p}"] = (_cut(d, _cut0(p)), False)
    for p in (0.5, 0.6, 0.62, 0.7, 0.8, 0.9):
        out[f"cut-off of own {p}"] = (_cut(d, _cut1(p)), False)
    for p0_, p1_, w in ((0.5, 0.5, 0.5), (0.5, 0.5, 0.65), (0.5, 0.5, 0.71), (0.66, 0.66, 0.71), (0.99, 0.47, 0.5), (0.9, 0.5, 0.55)):
        out[f"cut-off of both {p0_} {p1_} {w}"] = (_cut(d, (1 - w) * _cut0(p0_) + w * _cut1(p1_)), False)
    return out


def accuracies(rows: DataFrame, wanted: DataFrame, digits: int = 9) -> DataFrame:
    """(formula, accuracy): how often the best category by each formula is the wanted one; ties by id.

    All formulas are computed in one pass and one aggregation over documents.
    """
    table = formulas()
    best = []
    for i, (value, greatest) in enumerate(table.values()):
        score = F.round(-value if greatest else value, digits)
        best.append(F.min(F.struct(score.alias("s"), F.col("cat_id"))).alias(f"b{i}"))
    got = rows.groupBy("doc_id").agg(*best).join(wanted.select("doc_id", F.col("cat_id").alias("own")), "doc_id")
    hits = got.agg(*[F.avg((F.col(f"b{i}.cat_id") == F.col("own")).cast("double")).alias(f"a{i}") for i in range(len(table))])
    named = F.array(*[F.struct(F.lit(name).alias("formula"), F.col(f"a{i}").alias("accuracy")) for i, name in enumerate(table)])
    return hits.select(F.explode(named).alias("r")).select("r.*")


def formulas_sql() -> dict[str, tuple[str, bool]]:
    """The same formulas as SQL text over the same columns."""
    from statistics import NormalDist

    width = lambda p: NormalDist().inv_cdf((1 + p) / 2)
    s = lambda x: f"((1 - {EPS}) * ({x}) + {EPS})"
    a, b = s("1 - p1"), s("1 - p0")
    fb = lambda beta: f"((1 + ({beta}) * ({beta})) * ({a} * {b}) / (({beta}) * ({beta}) * {a} + {b}))"
    cut = lambda at: f"(case when d > {at} then d + 100 else d end)"
    cut0, cut1 = (lambda p: f"(mu0 - {width(p)} * sd0)"), (lambda p: f"(mu1 + {width(p)} * sd1)")
    out = {
        "distance": ("d", False), "tail of own": ("p1", False), "tail of others": ("p0", False),
        "F1 of tails": (f"(2 / (1 / {a} + 1 / {b}))", True), "F beta n": (fb("n"), True), "F beta share": (fb("share"), True),
        "F beta rest": (fb("1 - share"), True), "F beta 1 - others": (fb("1 - others"), True), "F beta 2 - others": (fb("2 - others"), True),
        "F beta 1 + share": (fb("1 + share"), True), "F beta exp": (fb("exp(-share)"), True), "own ^ share": ("pow(p1, share)", False),
        "own of all ^ share": ("pow(g1, share)", False), "others of all ^ share": ("pow(g0, share)", False),
        "sum of all": ("pow(g1, share) + pow(g0, others)", False), "sum": ("pow(p1, share) + pow(p0, others)", False),
        "product": ("pow(p1, share) * pow(p0, others)", False),
    }
    for p in (0.8, 0.9, 0.95, 0.99, 0.999):
        out[f"cut-off of others {p}"] = (cut(cut0(p)), False)
    for p in (0.5, 0.6, 0.62, 0.7, 0.8, 0.9):
        out[f"cut-off of own {p}"] = (cut(cut1(p)), False)
    for p0, p1, w in ((0.5, 0.5, 0.5), (0.5, 0.5, 0.65), (0.5, 0.5, 0.71), (0.66, 0.66, 0.71), (0.99, 0.47, 0.5), (0.9, 0.5, 0.55)):
        out[f"cut-off of both {p0} {p1} {w}"] = (cut(f"({1 - w} * {cut0(p0)} + {w} * {cut1(p1)})"), False)
    return out


def tail_sql(d: str, mu: str, sd: str) -> str:
    """The smoothed tail as SQL text."""
    z = f"(({d} - {mu}) / nullif({sd} * 1.4142135623730951, 0))"
    return f"((1 - {EPS}) * coalesce(0.5 * (1 + {erf_sql(z)}), 0.5) + {EPS})"


def tail_f1(d: Column, mu0: Column, sd0: Column, mu1: Column, sd1: Column) -> Column:
    """The older similarity of a distance: F1 of both tails, within [0, 1e38]."""
    tail = lambda mu, sd: smoothed(F.coalesce(gauss_cdf(d, mu, sd), F.lit(0.5)), EPS)
    own, others = tail(mu1, sd1), tail(mu0, sd0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1e38), f1(1 - own, 1 - others, EPS)))
