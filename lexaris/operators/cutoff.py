"""Distance cut-offs per category: fitting, repair, application, fitness, optimisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.functions.math import frac, gauss_cdf, gauss_width, harmonic
from lexaris.session import checked, cut

DEFAULT = 2.0
NEVER = 1e38


def distance_matrix(dist: DataFrame, documents: DataFrame, cats: DataFrame) -> DataFrame:
    """(doc_id, cat_id, d) over all documents and categories, 2 where no distance is given.

    The categories are a short list, sent to all executors.
    """
    full = documents.select("doc_id").crossJoin(checked(cats.select("cat_id")))
    return full.join(dist, ["doc_id", "cat_id"], "left").select("doc_id", "cat_id", F.coalesce("d", F.lit(DEFAULT)).alias("d"))


def fit(matrix: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cat_id, is_member, n, mu, sd): mean and population deviation of members' and others' distances."""
    own = wanted.select("doc_id", F.col("cat_id").alias("own"))
    rows = matrix.join(own, "doc_id").withColumn("is_member", F.col("cat_id") == F.col("own"))
    return rows.groupBy("cat_id", "is_member").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mu"), F.stddev_pop("d").alias("sd")
    )


def fit_sparse(dist: DataFrame, wanted: DataFrame, cats: DataFrame) -> DataFrame:
    """``fit`` of the distances given, the others being DEFAULT, without a row for each of these.

    Sums run over what distances fall short of DEFAULT, to which the missing ones add nothing.
    """
    own = wanted.select("doc_id", F.col("cat_id").alias("own"))
    short = (F.lit(DEFAULT) - F.col("d")).alias("e")
    given = dist.join(cats.select("cat_id"), "cat_id", "left_semi").join(own, "doc_id")
    given = given.select("cat_id", (F.col("cat_id") == F.col("own")).alias("is_member"), short)
    sums = given.groupBy("cat_id", "is_member").agg(F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"))
    n = own.groupBy(F.col("own").alias("cat_id")).agg(F.count(F.lit(1)).alias("m"))
    all_ = own.agg(F.count(F.lit(1)).alias("all"))
    sides = cats.select("cat_id").join(n, "cat_id", "left").crossJoin(F.broadcast(all_))  # one row
    m = F.coalesce("m", F.lit(0))
    sides = sides.select("cat_id", F.explode(F.array(
        F.struct(F.lit(True).alias("is_member"), m.alias("n")), F.struct(F.lit(False).alias("is_member"), (F.col("all") - m).alias("n"))
    )).alias("_s")).select("cat_id", "_s.*").where("n > 0")
    out = sides.join(sums, ["cat_id", "is_member"], "left")
    mean, square = F.coalesce("s", F.lit(0.0)) / F.col("n"), F.coalesce("q", F.lit(0.0)) / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
    return out.select("cat_id", "is_member", "n", (F.lit(DEFAULT) - mean).alias("mu"), sd.alias("sd"))


def with_null_proto(dist: DataFrame, wanted: DataFrame, null_cat: int, proto: int) -> tuple[DataFrame, DataFrame]:
    """Distances and wanted categories in which the null category's documents are wanted of its stand-in too.

    The distances to ``null_cat`` count for ``proto`` as well, so that both are fitted on the same documents.
    """
    twin = dist.where(F.col("cat_id") == null_cat).withColumn("cat_id", F.lit(proto).cast("long"))
    return dist.unionByName(twin), wanted.where(F.col("cat_id") == null_cat).withColumn("cat_id", F.lit(proto).cast("long"))


def repaired(fitted: DataFrame, cats: DataFrame) -> DataFrame:
    """(cat_id, mu0, sd0, mu1, sd1): one row a category, with bad fits replaced.

    A fit on fewer than two documents is bad. For members: the least good mean and half the least good
    deviation; for others: the least good mean and the greatest good deviation.
    """
    side = lambda member, k: fitted.where(F.col("is_member") == member).select(
        "cat_id", F.col("n").alias(f"n{k}"), F.col("mu").alias(f"mu{k}"), F.col("sd").alias(f"sd{k}")
    )
    rows = cats.select("cat_id").join(side(False, 0), "cat_id", "left").join(side(True, 1), "cat_id", "left")
    every = W.partitionBy()  # a row per category
    good0, good1 = F.col("n0") >= 2, F.col("n1") >= 2
    low = lambda good, c: F.min(F.when(good, F.col(c))).over(every)
    top = lambda good, c: F.max(F.when(good, F.col(c))).over(every)
    return rows.select(
        "cat_id",
        F.when(good0, F.col("mu0")).otherwise(low(good0, "mu0")).alias("mu0"),
        F.when(good0, F.col("sd0")).otherwise(top(good0, "sd0")).alias("sd0"),
        F.when(good1, F.col("mu1")).otherwise(low(good1, "mu1")).alias("mu1"),
        F.when(good1, F.col("sd1")).otherwise(low(good1, "sd1") / 2).alias("sd1"),
    )


def cutoffs(fits: DataFrame, p0: float = 0.5, p1: float = 0.5, w1: float = 0.65, sink: int | None = None) -> DataFrame:
    """``fits`` with the cut-off (1 - w1)(mu0 - width(p0)) + w1 (mu1 + width(p1)); the sink is never cut."""
    cut0 = F.col("mu0") - gauss_width(p0, F.col("sd0"))
    cut1 = F.col("mu1") + gauss_width(p1, F.col("sd1"))
    value = (1 - w1) * cut0 + w1 * cut1
    if sink is not None:
        value = F.when(F.col("cat_id") == sink, NEVER).otherwise(value)
    return fits.withColumn("cutoff", value)


def apply(ranks: DataFrame, cuts: DataFrame, sink: int | None = None, digits: int = 6) -> DataFrame:
    """(doc_id, cat_id, d, confp, confi, cut, deg): uncut categories first, each by distance and id."""
    rows = ranks.select("doc_id", "cat_id", "d").join(cuts.select("cat_id", "mu1", "sd1", "cutoff"), "cat_id")
    confp = 1 - gauss_cdf(F.col("d"), F.col("mu1"), F.col("sd1"))
    flag = F.when((F.col("cat_id") != (F.lit(-1) if sink is None else F.lit(sink))) & (F.col("d") > F.col("cutoff")), 1).otherwise(0)
    rows = rows.withColumn("confp", F.round(confp, digits)).withColumn("cut", flag)
    rows = rows.withColumn("confi", F.floor(10 * F.col("confp")).cast("int"))
    order = W.partitionBy("doc_id").orderBy("cut", F.round("d", digits), "cat_id")
    return rows.withColumn("deg", F.row_number().over(order)).drop("mu1", "sd1", "cutoff")


def decide(matrix: DataFrame, cuts: DataFrame, cutval: float = 100.0) -> DataFrame:
    """(doc_id, got): the nearest category when distances beyond the cut-off are raised by ``cutval``; ties by id."""
    rows = matrix.join(cuts.select("cat_id", "cutoff"), "cat_id")
    d = F.when(F.col("d") > F.col("cutoff"), F.col("d") + cutval).otherwise(F.col("d"))
    return rows.groupBy("doc_id").agg(F.min(F.struct(d.alias("d"), F.col("cat_id"))).alias("b")).select("doc_id", F.col("b.cat_id").alias("got"))


def fitness(decided: DataFrame, wanted: DataFrame, sink: int | None = None) -> DataFrame:
    """One row (acc, F, avg, min); the last three over categories but the sink that are both wanted and got."""
    both = wanted.select("doc_id", F.col("cat_id").alias("wanted")).join(decided, "doc_id")
    acc = both.agg(F.avg((F.col("wanted") == F.col("got")).cast("double")).alias("acc"))
    hit = (F.col("wanted") == F.col("got")).cast("long")
    w = both.groupBy(F.col("wanted").alias("cat_id")).agg(F.count(F.lit(1)).alias("nw"), F.sum(hit).alias("tp"))
    g = both.groupBy(F.col("got").alias("cat_id")).agg(F.count(F.lit(1)).alias("ng"))
    cats = w.join(g, "cat_id")
    if sink is not None:
        cats = cats.where(F.col("cat_id") != sink)
    cats = cats.withColumn("pr", frac(F.col("tp"), F.col("ng"))).withColumn("rc", frac(F.col("tp"), F.col("nw")))
    m = cats.agg(
        F.avg("pr").alias("pr"), F.avg("rc").alias("rc"),
        F.avg((F.col("pr") + F.col("rc")) / 2).alias("avg"), F.avg(F.least("pr", "rc")).alias("min"),
    )
    return acc.crossJoin(m).select("acc", harmonic(F.col("pr"), F.col("rc")).alias("F"), "avg", "min")  # one row each


def _fitness_of(name: str, hits: np.ndarray, nw: np.ndarray, ng: np.ndarray, fixed: int | None) -> float:
    """The fitness named ``name`` from what is hit, wanted and got of each category."""
    if name == "acc":
        return float(hits.sum() / max(1, nw.sum()))
    ok = (nw > 0) & (ng > 0)
    if fixed is not None:
        ok[fixed] = False
    if not ok.any():
        return 0.0
    pr, rc = hits[ok] / ng[ok], hits[ok] / nw[ok]
    if name == "avg":
        return float(((pr + rc) / 2).mean())
    if name == "min":
        return float(np.minimum(pr, rc).mean())
    p, r = pr.mean(), rc.mean()
    return float(2 / (1 / p + 1 / r)) if p > 0 and r > 0 else 0.0


def _counts(packed: DataFrame, candidates: np.ndarray, cutval: float) -> np.ndarray:
    """(candidate, kind, category): documents hit, wanted and got under each candidate's cut-offs.

    ``packed`` is (own, d), a row a document with its distances in the order of the
    categories. Each task sums up its documents; the sums, candidates x 3 x categories,
    are added by key.
    """
    m, n = candidates.shape

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((m, 3, n), dtype=np.int64)
        for rows in batches:
            if rows.empty:
                continue
            d, own = np.stack(rows["d"].to_numpy()), rows["own"].to_numpy()
            for i in range(m):
                got = np.argmin(d + cutval * (d > candidates[i]), axis=1)
                out[i, 0] += np.bincount(own[got == own], minlength=n)
                out[i, 1] += np.bincount(own, minlength=n)
                out[i, 2] += np.bincount(got, minlength=n)
        yield pd.DataFrame({"i": range(m), "c": [x.tobytes() for x in out]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, dtype=np.int64) for c in group["c"]], axis=0)
        return pd.DataFrame({"i": [group["i"].iloc[0]], "c": [total.tobytes()]})

    parts = packed.mapInPandas(part, "i int, c binary").groupBy("i").applyInPandas(added, "i int, c binary")
    out = np.zeros((m, 3, n), dtype=np.int64)
    for r in parts.collect():  # a row a candidate
        out[r["i"]] = np.frombuffer(r["c"], dtype=np.int64).reshape(3, n)
    return out


#: Distances of a category kept to draw from under ``select``: evenly spaced quantiles.
QUANTILES = 1000


def optimize(
    matrix: DataFrame, wanted: DataFrame, cuts: DataFrame, rounds: int = 100, fitness_name: str = "F",
    mutate: str = "norm", sink: int | None = None, seed: int = 0, pmutate: float | None = None, cutval: float = 100.0,
    brood: int = 20,
) -> DataFrame:
    """(cat_id, cutoff, fitness0, fitness): cut-offs improved by seeded random mutation.

    Starts from the fitted cut-offs or from none, whichever is fitter. ``rounds`` mutations
    are tried, ``brood`` in one pass over the documents; the fittest of a pass is kept if
    strictly fitter, so fitness never falls. ``mutate`` draws a new cut-off from a
    normal distribution around the others' mean, from the observed distances, or evenly
    between their bounds. The matrix stays a table; the driver holds cut-offs and counts
    of the categories, a short list.
    """
    cat_rows = cuts.orderBy("cat_id").toPandas()
    cats = [int(c) for c in cat_rows["cat_id"]]
    position = F.create_map(*[F.lit(x) for i, c in enumerate(cats) for x in (c, i)])
    cells = matrix.where(F.col("cat_id").isin(cats)).groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("cat_id", "d"))), lambda c: c.d).alias("d")
    )
    own = wanted.where(F.col("cat_id").isin(cats)).select("doc_id", position[F.col("cat_id")].alias("own"))
    packed = cut(cells.where(F.size("d") == len(cats)).join(own, "doc_id").select("own", "d"), "packed")
    fixed = None if sink is None else cats.index(sink)
    rng = np.random.default_rng(seed)
    observed = None
    if mutate != "norm":
        shares = [i / (QUANTILES - 1) for i in range(QUANTILES)] if mutate == "select" else [0.0, 1.0]
        q = matrix.groupBy("cat_id").agg(F.percentile("d", F.array(*[F.lit(v) for v in shares])).alias("q"))
        by_cat = {r["cat_id"]: r["q"] for r in q.collect()}  # a row a category
        observed = [np.array(by_cat[c]) for c in cats]

    def of(candidates: list[np.ndarray]) -> list[float]:
        return [_fitness_of(fitness_name, *c, fixed) for c in _counts(packed, np.stack(candidates), cutval)]

    def mutated(values: np.ndarray) -> np.ndarray:
        mask = rng.random(len(cats)) < (pmutate if pmutate is not None else 1 / len(cats))
        if fixed is not None:
            mask[fixed] = False
        if not mask.any():
            mask[rng.choice([i for i in range(len(cats)) if i != fixed])] = True
        fresh = values.copy()
        for i in np.flatnonzero(mask):
            if mutate == "norm":
                fresh[i] = rng.normal(cat_rows["mu0"][i], 3 * cat_rows["sd0"][i])
            elif mutate == "select":
                fresh[i] = rng.choice(observed[i])
            else:
                fresh[i] = rng.uniform(observed[i][0], observed[i][-1])
        return fresh

    starts = [cat_rows["cutoff"].to_numpy(dtype=float), np.full(len(cats), NEVER)]
    fit_cut, fit_none = of(starts)
    best, now = (starts[0], fit_cut) if fit_cut >= fit_none else (starts[1], fit_none)
    start, left = now, rounds
    while left > 0:
        tried = [mutated(best) for _ in range(min(brood, left))]
        left -= len(tried)
        values = of(tried)
        top = int(np.argmax(values))
        if values[top] > now:
            best, now = tried[top], values[top]
    out = [(c, float(v), start, now) for c, v in zip(cats, best, strict=True)]
    return matrix.sparkSession.createDataFrame(out, "cat_id long, cutoff double, fitness0 double, fitness double")
