"""Evaluation texts leaking into documents: a prefix-filtered set join on word shingles.

A passage leaks if a document holds a run of at least RUN words of the item, in order,
with at most one word in EDITS replaced, left out or preceded by a further word. Such a
run keeps, in some window of RUN words, at least KEPT of the window's shingles of
SHINGLE words: a run of n words has n - 2 shingles of three and loses at most three to
each of its n / 6 edits. Two sets that share KEPT of WINDOW elements share one of the
WINDOW - KEPT + 1 rarest, so only these are looked up first. Positions bound the
candidates further, as a run keeps KEPT_IN_RUN shingles close together: the shingles beyond the prefixes
are counted for the documents, items and places that a prefix has found. The run itself
is verified word by word over windows of the size of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.llm.words import words
from lexaris.session import cut

RUN = 14
EDITS = 6
SHINGLE = 3
WINDOW = RUN - SHINGLE + 1
#: The least number of shingles that any run of RUN or more words keeps in one of its windows.
KEPT = 4
PREFIX = WINDOW - KEPT + 1
#: The least number of shingles that any run keeps in all: n - 2 less 3 for each of n / 6 edits, least for n = RUN.
KEPT_IN_RUN = RUN - SHINGLE + 1 - SHINGLE * (RUN // EDITS)
#: Shingles of all items up to this number are sent to every executor; 16 bytes each, 40 in the join with the items.
BROADCAST_ROWS = 1_000_000
#: Places of a shingle that meet the items under one key.
SPREAD = 100_000


def _shingles(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    w = F.col("words")
    at = F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]),
    )
    return df.where(F.size(w) >= SHINGLE).select(*keys, F.posexplode(at).alias(pos, "shingle"))


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words), an item a row; items of fewer than RUN words can leak no run and are dropped.

    Of an item id with different texts each text stands for the item.
    """
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("words"))
    return rows.where(F.size("words") >= RUN).distinct()


def run_found(item: list[str], text: list[str]) -> bool:
    """Whether ``text`` holds a run of the item. Follows, from each start of a stretch of
    equal words, the furthest item word that any path with k edits reaches."""
    where: dict[str, list[int]] = {}
    for j, word in enumerate(text):
        where.setdefault(word, []).append(j)
    n, m = len(item), len(text)

    def slide(i: int, j: int) -> int:
        while i < n and j < m and item[i] == text[j]:
            i, j = i + 1, j + 1
        return i

    for i0 in range(n - RUN + 1):
        for j0 in where.get(item[i0], ()):
            if i0 and j0 and item[i0 - 1] == text[j0 - 1]:
                continue  # starts earlier
            reach = {j0 - i0: slide(i0, j0)}
            ends = list(reach.values())  # behind an equal word: a run does not end in an edit
            k = 0
            while True:
                if any(i - i0 >= max(RUN, EDITS * k) for i in ends):
                    return True
                k += 1
                if EDITS * k > n - i0:
                    break
                beyond: dict[int, int] = {}
                ends = []
                for d, i in reach.items():
                    if i >= n:
                        continue
                    for step_i, step_d in ((1, 0), (1, -1), (0, 1)):  # replaced, left out, put in
                        to, diagonal = i + step_i, d + step_d
                        if to <= n and 0 <= to + diagonal <= m:
                            first, to = to, slide(to, to + diagonal)
                            if to > first:
                                ends.append(to)
                            if to > beyond.get(diagonal, -1):
                                beyond[diagonal] = to
                reach = beyond
    return False


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        ok = [run_found(list(a), list(b)) for a, b in zip(rows["item_words"], rows["text_words"], strict=True)]
        yield rows.loc[ok, ["doc_id", "item_id"]]


def _salts(rarity: DataFrame) -> DataFrame:
    """(shingle, salts): into how many parts the places of a shingle are dealt."""
    return rarity.select("shingle", F.ceil(F.col("df") / SPREAD).alias("salts"))


def _prefix(item_shingles: DataFrame, rarity: DataFrame) -> DataFrame:
    """(item, shingle, item_pos, block_size): of each window the PREFIX rarest shingles; all of a window cut short by the item's end."""
    ranked = item_shingles.join(rarity, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("item_pos") - WINDOW + 1), F.col("item_pos"))
    windows = ranked.withColumn("start", F.explode(starts))
    order = W.partitionBy("item", "start").orderBy("df", "shingle", "item_pos")
    size = W.partitionBy("item", "start")
    windows = windows.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(size))
    kept = windows.where((F.col("rank") <= PREFIX) | (F.col("n") < WINDOW))
    return kept.select("item", "shingle", "item_pos", "block_size").distinct()


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a run of an item.

    Texts are compared as plain words (see ``lexaris.llm.words``), whole texts of
    any length. Null and empty texts hold nothing; rows without an id are left out;
    repeated rows give one row; an empty table on either side gives an empty result.
    """
    # a run lies within two neighbouring blocks of the document, as long as the item with all its edits
    block_size = F.floor(F.size("words") * (EDITS + 1) / EDITS) + 2
    known = item_words(items).withColumn("block_size", block_size).withColumn("item", F.xxhash64("item_id", "words"))
    known = cut(known, "items")
    item_shingles = cut(_shingles(known, ["item", "block_size"], "item_pos"), "item-shingles")
    wanted = item_shingles.select("shingle").distinct()
    few = item_shingles.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)

    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    texts = rows.select("doc_id", words(F.col("text")).alias("words"))
    # the one reading of all texts: where they have any item's shingle, for the rarity of each over all documents
    hits = cut(_shingles(texts, ["doc_id"], "pos").join(small(wanted), "shingle"), "hits")
    rarity = cut(hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "rarity")

    # the join proper: only shingles in a prefix meet, a common one in parts
    prefix = cut(_prefix(item_shingles, rarity), "prefix")
    spot = F.floor(F.col("pos") / F.col("block_size"))
    blocks = F.explode(F.array(spot, spot - 1)).alias("block")
    met = _meet(hits, prefix, rarity, small)
    first = cut(met.select("doc_id", "item", blocks).distinct(), "first")
    # the other shingles are counted where a prefix has met
    near = hits.join(first.select("doc_id").distinct(), "doc_id", "left_semi")
    near = _meet(near, item_shingles, rarity, small).select("doc_id", "item", "item_pos", blocks)
    near = near.join(first, ["doc_id", "item", "block"], "left_semi").distinct()
    counts = near.groupBy("doc_id", "item", "block").agg(F.count(F.lit(1)).alias("kept"))
    candidates = cut(counts.where(F.col("kept") >= KEPT_IN_RUN).drop("kept"), "candidates")

    # only documents with a candidate are taken apart into words again
    texts = rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = texts.select("doc_id", words(F.col("text")).alias("words"))
    pairs = texts.join(candidates, "doc_id").join(known.withColumnRenamed("words", "item_words"), "item")
    start = F.greatest(F.col("block") * F.col("block_size"), F.lit(0))
    length = (F.col("block") + 2) * F.col("block_size") + SHINGLE - start
    pairs = pairs.select(
        "doc_id", "item_id", "item_words", F.slice("words", (start + 1).cast("int"), length.cast("int")).alias("text_words")
    )
    return pairs.mapInPandas(_verified, "doc_id long, item_id long").distinct()


def _meet(hits: DataFrame, item_shingles: DataFrame, rarity: DataFrame, small) -> DataFrame:
    """``hits`` joined with the items by shingle; the places of a common shingle are dealt to several keys."""
    salts = _salts(rarity)
    items = item_shingles.join(salts, "shingle").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    salted = hits.join(small(salts), "shingle").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    return salted.drop("salts").join(small(items.drop("salts")), ["shingle", "salt"])
