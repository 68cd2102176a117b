"""Most similar vectors for every vector, by additive quantisation.

Vectors are coded as sums of one full-dimensional codeword from each of several residual
codebooks; the encoder keeps a beam of the best partial sums. The first codebook also
splits the collection into lists, and where there must be more lists than words can be
fitted on the sample, groups of words of the second codebook split these further. A query looks into the lists of its nearest
codewords, scores their members by looking its products with all codewords up in a table
and dividing by the members' stored norms, and ranks the best of them exactly.

The codebooks are fitted on a bounded sample; every vector is coded and searched.
Vectors of the same direction are one class: at most k + 1 of its smallest ids can be
among anyone's k most similar, since ties go to the smaller id, so the class is searched
by these, and its further members share their result. Lists are worked on in blocks of
bounded size, so that a list with a third of all vectors is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.session import cut
from lexaris.tables import latest

DIM = 64
#: Members of a class that are joined under one key.
SPREAD = 100_000


@dataclass(frozen=True)
class Settings:
    """Parameters of the index. ``sample`` bounds the vectors that the codebooks are fitted on."""

    sample: int = 20_000
    books: int = 6
    words: int = 64
    beam: int = 4
    probes: int = 12
    rerank: int = 128
    block: int = 1024
    rounds: int = 8
    rows_a_word: int = 4
    seed: int = 7


def valid_vectors(df: DataFrame, versions: bool) -> DataFrame:
    """(id, x): vectors that take part, scaled to length 1.

    Null, of another length than 64, with null, NaN or infinite values, or all zero: no part.
    Of versions the latest holds, usable or not; without versions, rows of one id that
    differ count by the greatest.
    """
    rows = df.where(F.col("id").isNotNull())
    if versions:
        rows = latest(rows.select("id", "x", "seen_at"), ["id"], ["x"])
    else:
        rows = rows.select("id", "x").groupBy("id").agg(F.max("x").alias("x"))
    rows = rows.where(F.size("x") == DIM)
    broken = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    top = F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    rows = rows.where(~broken).withColumn("top", top).where("top > 0")
    rows = rows.select("id", F.transform("x", lambda v: v / F.col("top")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return rows.withColumn("norm", norm).select("id", F.transform("x", lambda v: v / F.col("norm")).alias("x"))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        if not full.all():
            centres[~full] = x[rng.integers(len(x), size=(~full).sum())]
    return centres


def encode(x: np.ndarray, books: list[np.ndarray], beam: int) -> np.ndarray:
    """Codes of the rows of ``x``, one column a book, by beam search over the residuals."""
    n = len(x)
    residual = x[:, None, :]
    codes = np.zeros((n, 1, 0), dtype=np.int32)
    for book in books:
        # error of each continuation, up to what all continuations of a path share
        error = ((residual**2).sum(2)[:, :, None] - 2 * residual @ book.T + (book**2).sum(1)).reshape(n, -1)
        keep = min(beam, error.shape[1])
        best = np.argpartition(error, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(error, best, 1), axis=1), 1)
        path, word = best // len(book), best % len(book)
        residual = np.take_along_axis(residual, path[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None]], axis=2)
    return codes[:, 0, :]


@dataclass(frozen=True)
class Index:
    """Codebooks, and to which part of its first word's list each word of the second book leads."""

    books: list[np.ndarray]
    part: np.ndarray
    parts: int

    @property
    def lists(self) -> int:
        return len(self.books[0]) * self.parts

    def list_of(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, 0] * self.parts + (self.part[codes[:, 1]] if self.parts > 1 else 0)

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The lists that each row of ``x`` looks into: those of its nearest first words, or their nearest parts."""
        first, probes = self.books[0], min(probes, self.lists)
        near = x @ first.T - 0.5 * (first**2).sum(1)
        heads = np.argpartition(-near, min(probes, len(first)) - 1, axis=1)[:, :probes]
        if self.parts == 1:
            return heads
        second = self.books[1]
        score = np.full((len(x), heads.shape[1], self.parts), -np.inf)
        for i in range(heads.shape[1]):
            rest = x - first[heads[:, i]]
            each = rest @ second.T - 0.5 * (second**2).sum(1) - 0.5 * (rest**2).sum(1)[:, None]
            for part in range(self.parts):
                score[:, i, part] = each[:, self.part == part].max(axis=1)
        score = score.reshape(len(x), -1)
        best = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(heads, best // self.parts, 1) * self.parts + best % self.parts


def fit(x: np.ndarray, lists: int, s: Settings) -> Index:
    """Residual codebooks for about ``lists`` lists, fitted on the rows of ``x``.

    A word is fitted on ``rows_a_word`` rows on average; where that makes too few first words, the
    second book's words are grouped into as many parts as are wanting.
    """
    rng = np.random.default_rng(s.seed)
    most = max(1, len(x) // s.rows_a_word)
    first = max(1, min(lists, most))
    parts = min(-(-lists // first), most)
    books: list[np.ndarray] = []
    residual = x
    for b in range(s.books):
        n = first if b == 0 else max(s.words, parts) if b == 1 else s.words
        books.append(_kmeans(residual, n, s.rounds, rng))
        codes = encode(x, books, s.beam)
        residual = x - sum(book[codes[:, i]] for i, book in enumerate(books))
    parts = min(parts, len(books[1]) if len(books) > 1 else 1)
    part = np.zeros(len(books[1]) if len(books) > 1 else 1, dtype=np.int64)
    if parts > 1:
        centres = _kmeans(books[1], parts, s.rounds, rng)
        part = np.argmax(books[1] @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        used, part = np.unique(part, return_inverse=True)
        parts = len(used)
    return Index(books, part, parts)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _packed(index: Index, s: Settings):
    """Codes vectors: their list, codes, the norm of what the codes stand for, and the lists they look into."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            x, books = _matrix(rows["x"]), index.books
            codes = encode(x, books, s.beam)
            norms = np.linalg.norm(sum(book[codes[:, i]] for i, book in enumerate(books)), axis=1)
            yield pd.DataFrame(
                {
                    "id": rows["id"].to_numpy(),
                    "x": [v.astype("<f8").tobytes() for v in x],
                    "list": index.list_of(codes),
                    "codes": [c.astype("<i4").tobytes() for c in codes],
                    "norm": norms,
                    "probed": list(index.probed(x, s.probes)),
                }
            )

    return code


def _search(books: list[np.ndarray], k: int, s: Settings):
    """The k best members of a block for each query of a block."""

    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or members.empty:
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        q_ids, ids = queries["asker"].to_numpy(), members["id"].to_numpy()
        q = np.frombuffer(b"".join(queries["y"]), "<f8").reshape(len(q_ids), -1)
        x = np.frombuffer(b"".join(members["x"]), "<f8").reshape(len(ids), -1)
        codes = np.frombuffer(b"".join(members["codes"]), "<i4").reshape(len(ids), -1)
        norms = np.maximum(members["norm"].to_numpy(), 1e-12)
        parts = []
        for a in range(0, len(q_ids), s.block):
            part, who = q[a : a + s.block], q_ids[a : a + s.block]
            score = np.zeros((len(part), len(ids)))
            for b, book in enumerate(books):
                score += (part @ book.T)[:, codes[:, b]]
            score /= norms
            score[who[:, None] == ids[None, :]] = -np.inf
            keep = min(s.rerank, len(ids))
            best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            exact = np.empty(best.shape)
            for c in range(0, len(part), 64):
                exact[c : c + 64] = np.einsum("qd,qkd->qk", part[c : c + 64], x[best[c : c + 64]])
            exact, found = np.round(exact, 9), ids[best]
            exact[found == who[:, None]] = -np.inf
            order = np.lexsort((found, -exact), axis=1)[:, :k]
            exact, found = np.take_along_axis(exact, order, 1).ravel(), np.take_along_axis(found, order, 1).ravel()
            ok = np.isfinite(exact)
            parts.append(pd.DataFrame({"id": np.repeat(who, order.shape[1])[ok], "other": found[ok], "sim": exact[ok]}))
        return pd.concat(parts, ignore_index=True)

    return run


def nearest(vectors: DataFrame, k: int, s: Settings = Settings()) -> DataFrame:
    """(id, other, sim, rank): for every vector its ``k`` most similar other vectors.

    ``vectors`` is (id, x) with unique ids and x of length 1. Similarity is the cosine,
    rounded to 9 decimals; ties go to the smaller id. A table of fewer than k + 1 vectors
    gives fewer; an empty one gives an empty result.
    """
    spark = vectors.sparkSession
    answer = "id long, other long, sim double, rank int"
    # one direction, one class; the hash only sorts, the direction itself tells classes apart
    rows = vectors.select("id", "x", F.xxhash64(_direction()).alias("class"))
    rows = cut(rows, "vectors")
    rest = cut(_beyond(rows, k + 1), "rest")
    members = cut(rows.join(rest.select("id"), "id", "left_anti"), "members")
    total = members.count()
    if not total:
        return spark.createDataFrame([], answer)
    share = min(1.0, s.sample / total)
    pick = F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = members.where(pick).select("id", "x").orderBy(F.xxhash64("id", F.lit(s.seed))).limit(s.sample).toPandas()
    if sample.empty:
        sample = members.orderBy("id").limit(s.sample).select("id", "x").toPandas()
    index = fit(_matrix(sample["x"]), max(1, round(total**0.5)), s)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = members.select("id", "x").repartition(tasks).mapInPandas(
        _packed(index, s), "id long, x binary, list int, codes binary, norm double, probed array<int>"
    )
    coded = cut(coded, "coded")
    # blocks of each list's members and of the queries that look into it, so that no task gets a long list whole
    asked = coded.select(F.explode("probed").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("nq"))
    sizes = coded.groupBy("list").agg(F.count(F.lit(1)).alias("nm")).join(asked, "list")
    sizes = sizes.select("list", F.ceil(F.col("nm") / s.block).alias("mb"), F.ceil(F.col("nq") / (4 * s.block)).alias("qb"))
    sizes = cut(sizes, "sizes")
    if index.lists <= 100_000:  # a row of 20 bytes each
        sizes = F.broadcast(sizes)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    data = coded.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("id"), "mb").alias("m"), numbers("qb").alias("q"), "id", "x", "codes", "norm"
    )
    asking = coded.select("id", "x", F.explode("probed").alias("list")).join(sizes, "list").select(
        "list", numbers("mb").alias("m"), F.pmod(F.xxhash64("id"), "qb").alias("q"), F.col("id").alias("asker"), F.col("x").alias("y")
    )
    block = ["list", "m", "q"]
    found = asking.groupBy(*block).cogroup(data.groupBy(*block))
    found = found.applyInPandas(_search(index.books, k, s), "id long, other long, sim double")
    best = _ranked(found, k)
    best = cut(best, "best")

    return best.unionByName(_shared(rest, members, k))


def _direction() -> Column:
    """What makes vectors one class: x to ten places."""
    return F.transform("x", lambda v: F.round(v, 10) + 0.0)


def _beyond(rows: DataFrame, n: int) -> DataFrame:
    """(id, class, along): the members of each class beyond its ``n`` smallest ids.

    Most vectors have a class of their own; only those whose hash comes more than ``n``
    times are compared by their directions. The smallest ids are found by salt first, so
    that no task sorts a class whole.
    """
    often = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n).select("class")
    often = rows.join(often, "class", "left_semi").select("id", "class", _direction().alias("along"))
    often = cut(often, "classes")
    salted = W.partitionBy("class", "along", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    part = often.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= n)
    whole = W.partitionBy("class", "along").orderBy("id")
    first = part.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= n)
    return often.join(first.select("id"), "id", "left_anti")


def _shared(rest: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, other, sim, rank) of the further members of a class: its smallest ids at 1, as ties go to them.

    A class of any size is dealt to several keys by id.
    """
    salts = rest.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / SPREAD).alias("salts"))
    order = W.partitionBy("class", _direction()).orderBy("id")
    heads = members.join(salts, "class").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    heads = heads.select("class", _direction().alias("along"), F.struct(F.col("id").alias("other"), "rank").alias("h"), "salts")
    heads = heads.groupBy("class", "along", "salts").agg(F.collect_list("h").alias("heads"))  # k at most
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    salted = rest.join(salts, "class").withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).drop("salts")
    out = salted.join(heads, ["class", "along", "salt"]).select("id", F.explode("heads").alias("h"))
    return out.select("id", "h.other", F.lit(1.0).alias("sim"), "h.rank")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("id").orderBy(F.desc("sim"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(best: DataFrame, min_sim: float) -> DataFrame:
    """(id_a, id_b): pairs of at least ``min_sim`` in which one is among the other's most similar."""
    pairs = best.where(F.col("sim") >= min_sim)
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
