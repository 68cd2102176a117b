"""k-best search: the query language, query vectors, masks, normalisation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaris.functions.math import gauss_cdf
from lexaris.functions.vectors import DISTANCES
from lexaris.session import cut

# fixed values: the prefixes of the query language
PREFIXES = {
    "doc": "doc", "page": "doc", "pag": "doc",
    "class": "cat", "cls": "cat", "cat": "cat", "book": "cat", "bk": "cat", "volume": "cat", "vol": "cat",
    "term": "term",
}

_TOKEN = re.compile(r"(?:(?P<prefix>\w+)[:=])?(?P<body>.*?)(?::(?P<weight>[0-9eE+-]+))?\Z", re.S)


def parse(query: str) -> list[tuple[str, str, float]]:
    """(kind, body, weight) of each part of a query string such as ``Eisen:9 doc=LABEL cat=REGEX``.

    Parts stand between blanks, commas and semicolons. Weights have no decimal point; a
    weight of 0, or one that is no number, is 1. Repeated terms add up.
    """
    out: dict[tuple[str, str], float] = {}
    for token in re.split(r"[,\s;]+", query):
        if not token:
            continue
        m = _TOKEN.match(token)
        kind = PREFIXES.get((m["prefix"] or "term").lower())
        body, weight = m["body"], m["weight"]
        if kind is None:  # not a prefix of the language: part of the term
            rest = re.match(r"(.*?)(?::([0-9eE+-]+))?\Z", token, re.S)
            kind, body, weight = "term", rest[1], rest[2]
        try:
            value = float(weight) if weight else 1.0
        except ValueError:
            value = 1.0
        key = (kind, body)
        out[key] = out.get(key, 0.0) + (value or 1.0) if kind == "term" else 1.0
    return [(kind, body, w) for (kind, body), w in out.items()]


def lookup(labels: DataFrame, column: str, body: str) -> DataFrame:
    """Rows whose label is ``body``; if there is none, all whose label matches it as a regular expression."""
    exact = labels.where(F.col(column) == body)
    return labels.where(F.regexp_like(column, F.lit(body))) if exact.isEmpty() else exact


def query_vector(terms: DataFrame | None, docs: DataFrame | None, cats: DataFrame | None, rank: int) -> Column:
    """The query as a literal vector.

    ``terms`` is (w, x), ``docs`` and ``cats`` have (x). The term part is the weighted mean of
    the terms' vectors; documents and categories add their vectors divided by the number of
    sources, which is the number of documents and categories, and one if there are terms.
    """
    parts: list[float] = [0.0] * rank
    n = sum(0 if d is None else d.count() for d in (docs, cats)) + (0 if terms is None else 1)
    if terms is not None:
        all_w = terms.agg(F.sum("w")).first()[0] or 1.0
        row = terms.agg(*[F.sum(F.col("w") / all_w * F.get("x", F.lit(i))) for i in range(rank)]).first()
        parts = [a + (b or 0.0) for a, b in zip(parts, row, strict=True)]
    for side in (docs, cats):
        if side is not None:
            row = side.agg(*[F.sum(F.get("x", F.lit(i)) / n) for i in range(rank)]).first()
            parts = [a + (b or 0.0) for a, b in zip(parts, row, strict=True)]
    return F.array(*[F.lit(float(v)) for v in parts])


@dataclass(frozen=True)
class Space:
    """What a query is answered from: vectors with labels, and bounds of the model's vocabulary.

    ``terms`` is (term, x, tf0, tdf0), ``docs`` and ``cats`` are (label, x).
    """

    terms: DataFrame
    docs: DataFrame
    cats: DataFrame
    rank: int
    min_freq: float = 0.0
    min_doc_freq: float = 0.0


def gathered(space: Space, query: str) -> Column:
    """The vector of a query string: its terms, and the documents and categories that its labels or patterns name.

    Terms that are not in the vocabulary are dropped. An unknown query is all zero.
    """
    parts = parse(query)
    spark = space.terms.sparkSession
    wanted = [(body, w) for kind, body, w in parts if kind == "term"]
    terms = docs = cats = None
    if wanted:
        known = spark.createDataFrame(wanted, "term string, w double")
        terms = cut(space.terms.join(F.broadcast(known), "term").select("w", "x"), "query-terms")  # a query's own terms
        terms = None if terms.isEmpty() else terms
    for kind, side in (("doc", space.docs), ("cat", space.cats)):
        found = None
        for body in (b for k, b, _ in parts if k == kind):
            hit = lookup(side, "label", body)
            found = hit if found is None else found.unionByName(hit)
        if found is not None:
            found = cut(found.dropDuplicates(["label"]).select("x"), "query-" + kind)
            found = None if found.isEmpty() else found
        docs, cats = (found, cats) if kind == "doc" else (docs, found)
    if terms is None and docs is None and cats is None:
        return F.array(*[F.lit(0.0)] * space.rank)
    return query_vector(terms, docs, cats, space.rank)


def answered(
    space: Space, query: str, k: int = 10, to: str | None = None, letter: str = "u", how: str = "",
    min_freq: float = 0.0, min_doc_freq: float = 0.0, digits: int = 9,
) -> DataFrame:
    """(label, d): the ``k`` documents, categories or terms nearest to a query string.

    Terms rarer than the bounds asked for are infinitely far, where these exceed the model's own.
    """
    kind = space_of(to, space.cats.limit(2).count())
    q = gathered(space, query)
    items = {"docs": space.docs, "cats": space.cats}.get(kind)
    if items is None:
        items = space.terms.withColumnRenamed("term", "label")
    rows = items.withColumn("d", F.round(DISTANCES[letter](F.col("x"), q), digits))
    if kind == "terms" and (min_freq > space.min_freq or min_doc_freq > space.min_doc_freq):
        rows = rows.withColumn("d", masked(F.col("d"), F.col("tf0"), F.col("tdf0"), min_freq, min_doc_freq))
    rows = rows.select("label", "d")
    return normalised(rows.orderBy("d", "label").limit(k), how, rows)


def distance_range(items: DataFrame, query: Column, letter: str = "u") -> DataFrame:
    """One row (least, greatest): the bounds of the distances of all items to a query."""
    d = DISTANCES[letter](F.col("x"), query)
    return items.agg(F.min(d).alias("least"), F.max(d).alias("greatest"))


def space_of(name: str | None, n_cats: int) -> str:
    """Which items to search: documents, categories or terms; by default categories if there are several."""
    if not name:
        return "cats" if n_cats > 1 else "docs"
    return "docs" if name[:1] in "dp" else "cats" if name[:1] in "cbv" else "terms"


def masked(d: Column, tf0: Column, tdf0: Column, min_freq: float, min_doc_freq: float) -> Column:
    """Distance of rare terms raised to infinity."""
    return F.when((tf0 < min_freq) | (tdf0 < min_doc_freq), float("inf")).otherwise(d)


def k_best(items: DataFrame, query: Column, label: str, k: int, letter: str = "u") -> DataFrame:
    """The ``k`` items nearest to ``query``, ties by label; the top is merged from each task's top."""
    d = DISTANCES[letter](F.col("x"), query)
    return items.select(label, d.alias("d")).orderBy("d", label).limit(k)


def normalised(best: DataFrame, how: str, every: DataFrame) -> DataFrame:
    """``best`` with d / 2, or its probability under the distances of ``every`` item, or unchanged."""
    if how and how[0] in "lvc2":
        return best.withColumn("d", F.col("d") / 2)
    if how[:1] == "g" or how[:3] == "nor":
        m = every.agg(F.avg("d").alias("mu"), F.stddev_pop("d").alias("sd"))
        return best.crossJoin(m).withColumn("d", gauss_cdf(F.col("d"), F.col("mu"), F.col("sd"))).drop("mu", "sd")  # one row
    return best
