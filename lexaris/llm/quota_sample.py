"""Sample documents to target category shares, with a minimum from small categories.

One pass keeps a mergeable reservoir per category: each document draws a uniform
priority from a hash of its id, and a reservoir of size k is the k documents of lowest
priority. Reservoirs merge by union; their state is the number of documents by
category and priority slot, which is all that the merge needs, so the pass is one
count with map-side combining and a category of any size stays spread over all tasks.
After the final counts each reservoir is trimmed to its feasible quota by a priority
threshold; only within the one slot at the threshold are documents ranked.
"""

from __future__ import annotations

import bisect
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.functions.text import clean_name
from lexaris.llm.top_items import top_n
from lexaris.session import cut
from lexaris.tables import best_category, categories, memberships

SLOTS = 4096
SEED = 20_240_601


def pool(docs: DataFrame, doc_cats: DataFrame, cat2id: DataFrame) -> DataFrame:
    """(doc_id, cat_id): each document of docs with a membership, under its best category.

    Best is the lowest deg; null deg last, ties to the smaller cat_id. Documents
    without membership, memberships of unknown documents or of no known category, and
    rows without doc_id take no part. Repeated rows count once, the latest holds.
    """
    best = best_category(memberships(doc_cats, cat2id))
    return best.join(docs.where(F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", "left_semi")


def targets(cat_targets: DataFrame, cat2id: DataFrame) -> DataFrame:
    """(cat_id, share, least): the targets under category ids; repeated rows count once.

    Names of no known category are dropped; a null share or minimum counts as 0, of two
    different rows of one category the greater values hold.
    """
    names = categories(cat2id).where(F.col("cat").isNotNull()).groupBy("cat").agg(F.min("cat_id").alias("cat_id"))
    rows = cat_targets.select(
        clean_name(F.col("name")).alias("cat"),
        F.coalesce(F.col("target_share"), F.lit(0.0)).alias("share"),
        F.coalesce(F.col("min_docs"), F.lit(0)).cast("long").alias("least"),
    )
    return rows.join(names, "cat").groupBy("cat_id").agg(F.max("share").alias("share"), F.max("least").alias("least"))


def shares_out(rows: list[tuple[int, int, float, int]], size: int) -> dict[int, int]:
    """Quota by category of rows (cat_id, n_docs, share, least); they sum to ``size``, or to all documents if these are fewer.

    Each category has factor x share, but its least at least and its documents at most,
    with one factor for all; between the points where a category reaches one of its
    bounds the sum is linear in the factor. If categories with a share cannot take all,
    those without one take the rest in proportion to their spare documents. If the least
    alone exceed ``size``, they hold nevertheless. Exact fractions; what flooring leaves
    goes to the largest remainders, ties to the smaller cat_id.
    """
    cats = [(c, n, Fraction(t) if 0 < t < math.inf else Fraction(0), max(0, min(n, least))) for c, n, t, least in rows]
    size = min(size, sum(n for _, n, _, _ in cats))

    def at(factor: Fraction) -> dict[int, Fraction]:
        return {c: max(Fraction(least), min(Fraction(n), factor * t)) for c, n, t, least in cats}

    size = max(size, sum(least for _, _, _, least in cats))
    points = sorted({Fraction(b) / t for _, n, t, least in cats if t for b in (least, n)} | {Fraction(0)})
    if sum(at(points[-1]).values()) < size:
        full = at(points[-1])
        spare = sum(n - full[c] for c, n, _, _ in cats)
        part = (size - sum(full.values())) / spare
        exact = {c: full[c] + (n - full[c]) * part for c, n, _, _ in cats}
    else:
        i = bisect.bisect_left(points, size, key=lambda f: sum(at(f).values()))
        low, high = points[max(0, i - 1)], points[i]
        below, above = sum(at(low).values()), sum(at(high).values())
        exact = at(low + (high - low) * (size - below) / (above - below) if above > below else high)
    out = {c: math.floor(x) for c, x in exact.items()}
    for c in sorted(exact, key=lambda c: (out[c] - exact[c], c))[: size - sum(out.values())]:
        out[c] += 1
    return out


def quotas(state: DataFrame, wanted: DataFrame, share: float) -> DataFrame:
    """One row per target category: what it has, what is wanted of it, its feasible quota.

    (cat_id, n_docs, target_share, min_docs, wanted, quota, exhausted). The sample is
    to have S = floor(share x documents) documents. ``wanted`` is max(target_share x S,
    min_docs); a category with fewer documents is exhausted. The quotas sum to S, or to
    all documents of the target categories if these are fewer, or to the minima if these
    are more, and follow the target shares by one common factor as far as minima and
    documents allow (``shares_out``).
    """
    size = state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    have = state.groupBy("cat_id").agg(F.sum("n").alias("n_docs"))
    q = wanted.join(have, "cat_id", "left").crossJoin(F.broadcast(size))  # one row
    q = q.withColumn("n_docs", F.coalesce("n_docs", F.lit(0))).withColumn("S", F.floor(F.lit(share) * F.col("total")))
    q = q.withColumn("wanted", F.greatest(F.col("share") * F.col("S"), F.col("least").cast("double")))
    q = q.withColumn("exhausted", F.col("n_docs") < F.col("wanted"))
    rows = q.collect()  # the fixed list of target categories
    quota = shares_out([(r["cat_id"], r["n_docs"], r["share"], r["least"]) for r in rows], rows[0]["S"] if rows else 0)
    return state.sparkSession.createDataFrame(
        [(r["cat_id"], r["n_docs"], r["share"], r["least"], r["wanted"], quota[r["cat_id"]], r["exhausted"]) for r in rows],
        "cat_id long, n_docs long, target_share double, min_docs long, wanted double, quota long, exhausted boolean",
    )


def _prioritised(documents: DataFrame, seed: int) -> DataFrame:
    priority = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11)  # 53 bits, exact as a double
    return documents.select("cat_id", "doc_id", priority.alias("priority")).withColumn(
        "slot", F.shiftright("priority", 53 - 12).cast("int")
    )


def reservoirs(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """(cat_id, slot, n): the mergeable state; the states of parts of the data add up."""
    return _prioritised(documents, seed).groupBy("cat_id", "slot").agg(F.count(F.lit(1)).alias("n"))


def sample(documents: DataFrame, plan: DataFrame, state: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, cat_id): of every category the ``quota`` documents of lowest priority, none twice.

    An empty table gives an empty sample; so does a quota of 0.
    """
    upto = F.sum("n").over(W.partitionBy("cat_id").orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    slots = state.withColumn("upto", upto).join(plan.select("cat_id", "quota"), "cat_id")
    slots = slots.where("upto - n < quota").withColumn("rest", F.col("quota") - F.col("upto") + F.col("n"))
    slots = cut(slots.select("cat_id", "slot", "n", "rest"), "slots")
    rows = _prioritised(documents, seed)
    whole = rows.join(slots.where("n <= rest"), ["cat_id", "slot"]).select("doc_id", "cat_id")
    # one slot per category, 1/4096 of it, is refined further
    edge = cut(rows.join(slots.where("n > rest"), ["cat_id", "slot"]).drop("n", "slot"), "edge")
    inner = top_n(edge, ["cat_id"], [("priority", "double"), ("doc_id", "long")], F.col("rest"), "edge")
    return whole.unionByName(inner.select("doc_id", "cat_id"))


def report(plan: DataFrame) -> DataFrame:
    """(cat_id): the categories that cannot be filled."""
    return plan.where("exhausted").select("cat_id").distinct()
