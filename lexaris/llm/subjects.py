"""Subject areas of documents, by label propagation over the graph of documents and lemmas.

Documents are neighbours by the verified lemmas that they share, and the more alike the
more of these they have in common. This similarity graph is the product of the table of
documents and lemmas with its transpose; it is kept as the two factors, document - lemma -
document, so that a lemma of a million documents is a million edges and not their
square, and no neighbour is left out. A step along the graph is a join with each factor. A lemma carries labels only once it is verified: its labelled
documents must point to one subject, and more clearly than a lemma strewn at random
would by chance. Each round is two joins: documents hand their subjects to their lemmas,
verified lemmas hand theirs back. Documents with categories are seeds and stay clamped;
the others take every subject that holds a quarter of their subject-bearing lemmas.
"""

from __future__ import annotations

import logging
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.session import cut
from lexaris.tables import categories, counted, memberships

log = logging.getLogger(__name__)

#: Share of a lemma's documents that must agree on the subject.
PURITY = 0.7
#: Greatest share of chance among the lemmas verified with the same evidence.
CHANCE = 0.3
#: Steps by which the evidence of a lemma is told apart: whole documents up to this number, then its
#: steps to each doubling.
STEPS = 32
#: Rounds at most, if labels have not stopped changing before.
ROUNDS = 12
#: Change of a subject's share in a lemma up to which the lemma counts as settled.
STILL = 0.05
MIN_F = 2.0
MIN_SHARE = 0.25


def seeds(doc_cats: DataFrame, cat2id: DataFrame) -> DataFrame:
    """(doc_id, subject): the distinct subjects of a document's valid memberships; null subjects are left out."""
    cats = categories(cat2id).where(F.col("subject").isNotNull()).select("cat_id", "subject")
    return memberships(doc_cats, cat2id).join(cats, "cat_id").select("doc_id", "subject").distinct()


def _agreeing(n: int, m: int, shares: list[float]) -> float:
    """How probable it is that m of n documents drawn at random have one and the same subject, and n - m another."""
    ways = math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
    apart = lambda p: (n - m) * math.log1p(-p) if n > m else 0.0
    return sum(math.exp(ways + m * math.log(p) + apart(p)) for p in shares if 0 < p < 1 or (p == 1 and n == m))


def _majority(n: int, shares: list[float]) -> float:
    """How probable it is that more than half of n documents drawn at random have one subject."""
    if n <= 2 * STEPS:
        return sum(_agreeing(n, m, shares) for m in range(n // 2 + 1, n + 1))
    beyond = lambda p: (n / 2 - n * p) / math.sqrt(2 * n * p * (1 - p)) if 0 < p < 1 else math.inf if p == 0 else -math.inf
    return sum(math.erfc(beyond(p)) / 2 for p in shares)


def by_chance(counts: dict[tuple[int, int], int], shares: list[float]) -> set[tuple[int, int]]:
    """The (documents, agreeing documents) that verify a lemma.

    ``counts`` is how many lemmas there are of each kind, ``shares`` the subjects' shares
    of the documents. Lemmas of which no subject has more than half show how many random
    ones there are; from these follows how many agree by chance.
    """
    out = set()
    of_n: dict[int, dict[int, int]] = defaultdict(dict)
    for (n, m), c in counts.items():
        of_n[n][m] = c
    for n, row in of_n.items():
        if n < 2:
            continue
        strewn = sum(c for m, c in row.items() if m <= n // 2)
        if strewn:
            strewn /= max(1e-9, 1 - _majority(n, shares))
        for m, c in row.items():
            if m >= PURITY * n and strewn * _agreeing(n, m, shares) <= CHANCE * c:
                out.add((n, m))
    return out


def _stepped(n: Column) -> Column:
    """``n`` rounded down to whole numbers up to STEPS, to STEPS steps a doubling beyond."""
    width = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1.0)) / STEPS))))
    return (F.floor(n / width) * width).cast("long")


def _evidence(edges: DataFrame, labels: DataFrame, before: DataFrame | None) -> DataFrame:
    """(term, subject, w): labelled documents of each lemma by subject.

    A document with several subjects counts once, divided among them by what the lemma
    meant before, evenly at first.
    """
    labels = labels.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("doc_id")))  # a row per subject
    out = edges.select("doc_id", "term").join(labels, "doc_id")
    if before is None:
        return out.groupBy("term", "subject").agg(F.sum(1.0 / F.col("n")).alias("w"))
    one = out.where("n = 1").groupBy("term", "subject").agg(F.count(F.lit(1)).cast("double").alias("w"))
    p = before.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("term"))).drop("w")  # a row per subject
    several = out.where("n > 1").join(p, ["term", "subject"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)) + 1e-3)
    several = several.withColumn("w", F.col("p") / F.sum("p").over(W.partitionBy("term", "doc_id")))
    return _added(one, several.groupBy("term", "subject").agg(F.sum("w").alias("w")))


def _added(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("term", "subject", "w")
    for part in parts[1:]:
        out = out.unionByName(part.select("term", "subject", "w"))
    return out.groupBy("term", "subject").agg(F.sum("w").alias("w"))


def _shares(evidence: DataFrame) -> DataFrame:
    share = F.col("w") / F.sum("w").over(W.partitionBy("term"))  # a row per subject
    return evidence.select("term", "subject", share.alias("p"))


def _summary(evidence: DataFrame) -> DataFrame:
    top = F.max(F.struct("w", "subject")).alias("t")
    out = evidence.groupBy("term").agg(F.sum("w").alias("all"), top)
    return out.select("term", "all", F.col("t.w").alias("top"), F.col("t.subject").alias("subject"))


def lexicon(evidence: DataFrame, shares: list[float]) -> DataFrame:
    """(term, subject): the verified lemmas.

    What is known of a lemma is rounded to STEPS steps a doubling, so that the kinds of
    evidence are few at any size: the driver gets at most STEPS times STEPS of them for
    each doubling of the number of documents.
    """
    whole = _summary(evidence).withColumn("n", _stepped(F.round("all")))
    parts = F.least(F.col("n"), F.lit(STEPS).cast("long"))
    share = F.round(F.col("top") / F.col("all") * parts) / parts
    whole = whole.where("n > 0").withColumn("m", F.least(F.round(share * F.col("n")).cast("long"), F.col("n")))
    whole = cut(whole, "lemmas")
    kinds = whole.groupBy("n", "m").agg(F.count(F.lit(1)).alias("c")).collect()
    good = by_chance({(r["n"], r["m"]): r["c"] for r in kinds}, shares)
    kind = whole.sparkSession.createDataFrame(sorted(good), "n long, m long")
    verified = whole.join(F.broadcast(kind), ["n", "m"], "left_semi")  # kinds, as above
    return verified.where(F.col("top") >= PURITY * F.col("all")).select("term", "subject")


def document_subjects(edges: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, subject, f, share): subjects of at least MIN_F and MIN_SHARE of the document's bearing lemmas."""
    by_subject = edges.join(words, "term").groupBy("doc_id", "subject").agg(F.sum("f").alias("f"))
    share = F.col("f") / F.sum("f").over(W.partitionBy("doc_id"))  # a row per subject
    out = by_subject.withColumn("share", share)
    return out.where((F.col("f") >= MIN_F) & (F.col("share") >= MIN_SHARE))


def propagate(signatures: DataFrame, labelled: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(subjects of every document by its lemmas, verified lemmas).

    ``signatures`` is (doc_id, term, f), ``labelled`` (doc_id, subject) the seeds. Without
    seeds or signatures both are empty. Ties are no matter: a document keeps all subjects
    that pass. Ends when no label changes and the lemmas are
    settled, else after ``rounds`` rounds with a
    warning that says how many still do.
    """
    signatures, labelled = cut(signatures, "signatures"), cut(labelled, "seeds")
    # a fixed list of subjects
    counts = [r["n"] for r in labelled.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()]
    shares = [n / sum(counts) for n in counts]
    evidence = cut(_evidence(signatures, labelled, None), "evidence")
    # lemmas of which too few labelled documents have any one subject, counted whole, need no further rounds
    having = signatures.join(labelled, "doc_id").groupBy("term", "subject").agg(F.count(F.lit(1)).alias("have"))
    having = having.groupBy("term").agg(F.max("have").alias("have"))
    seen = signatures.join(labelled.select("doc_id").distinct(), "doc_id", "left_semi")
    seen = cut(seen.groupBy("term").agg(F.count(F.lit(1)).alias("all")).join(having, "term"), "seen")
    hopeful = seen.where("have >= 0.33 * all").select("term")
    unseen = signatures.join(seen.select("term"), "term", "left_anti").select("term").distinct()
    edges = cut(signatures.join(hopeful.unionByName(unseen), "term", "left_semi"), "edges")
    # seeds of one subject say the same in every round; the rounds go over the other documents only
    plain = labelled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("subject")).where("n = 1")
    plain = cut(plain.select("doc_id", "subject"), "plain-seeds")
    settled = edges.join(plain, "doc_id").groupBy("term", "subject").agg(F.count(F.lit(1)).cast("double").alias("w"))
    settled = cut(settled, "settled")
    still_open = cut(edges.join(plain, "doc_id", "left_anti"), "open-edges")
    several = cut(labelled.join(plain, "doc_id", "left_anti"), "several")
    labels, words = several, None
    for turn in range(rounds):
        earlier, evidence = evidence, cut(_added(settled, _evidence(still_open, labels, evidence)), "evidence")
        words = cut(lexicon(evidence, shares), "lexicon")
        fresh = document_subjects(still_open, words).join(several, "doc_id", "left_anti").select("doc_id", "subject")
        before, labels = labels, cut(several.unionByName(fresh), "labels")
        changed = labels.join(before, ["doc_id", "subject"], "left_anti").count()
        changed += before.join(labels, ["doc_id", "subject"], "left_anti").count()
        # labels may rest for a round while the lemmas of documents with many subjects still sharpen
        moved = _shares(evidence).join(_shares(earlier).withColumnRenamed("p", "q"), ["term", "subject"], "left")
        moving = moved.where(F.abs(F.col("p") - F.coalesce("q", F.lit(0.0))) > STILL).count()
        log.info("round %d: %d labels changed, %d lemma shares moving", turn + 1, changed, moving)
        if not changed and not moving:
            break
    else:
        log.warning("after %d rounds %d labels and %d lemma shares still changing", rounds, changed, moving)
    return cut(document_subjects(edges, words), "subjects"), words


def subject_areas(tf: DataFrame, doc_cats: DataFrame, cat2id: DataFrame) -> DataFrame:
    """(doc_id, subject, f, share, seed): subjects of every document with counted rows or categories.

    Documents with categories keep these (``seed``); a document with any row in doc_cats,
    usable or not, counts as having some. The others have the subjects that their lemmas
    bear, one or several, or no row. Null ids, blank terms and unusable f take no part;
    of repeated and late rows the latest holds.
    """
    clamped = cut(seeds(doc_cats, cat2id), "clamped")
    found, _ = propagate(counted(tf), clamped)
    known = doc_cats.where(F.col("doc_id").isNotNull()).select("doc_id")
    free = found.join(known, "doc_id", "left_anti").withColumn("seed", F.lit(False))
    kept = clamped.join(found.select("doc_id", "subject", "f", "share"), ["doc_id", "subject"], "left")
    return free.unionByName(kept.withColumn("seed", F.lit(True)).select(free.columns))
