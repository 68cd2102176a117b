"""Mix sources to target weights by hash-threshold histograms of token sizes.

Each document has a hash of its id as a uniform position. Per source, token sizes are
summed by hash bucket; the running sum over the buckets shows at which bucket a budget
is reached, for all budgets (whole copies and the partial copy) alike, since the
thresholds are nested. Only the bucket at the boundary is refined, by cutting it into
buckets again, until it holds one document. The mix is then a filter on the hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.functions.text import clean_source
from lexaris.session import cut

BUCKET_BITS = 10
HASH_BITS = 60
SEED = 20_240_602


def default_tokenizer() -> str:
    """The vocabulary file used where none is named; the installation says where it lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _counter(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    encoding = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def token_sizes(documents: DataFrame, tokenizer: str | None = None, workers: int | None = None) -> DataFrame:
    """(doc_id, source, tokens): size of each text; a null or empty text has 0.

    ``tokenizer`` is the path of a rank file on the executors. Very long texts are
    counted whole, cut at line ends into pieces of bounded length for the tokenizer.
    """
    path = tokenizer or default_tokenizer()

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(path)
        for rows in batches:
            sizes = [sum(count(piece) for piece in _pieces(t)) if isinstance(t, str) else 0 for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "source": rows["source"], "tokens": sizes})

    rows = documents.where(F.col("doc_id").isNotNull()).select(
        "doc_id", clean_source(F.col("source")).alias("source"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.mapInPandas(sized, "doc_id long, source string, tokens long")


def _pieces(text: str, longest: int = 100_000) -> Iterator[str]:
    start = 0
    while len(text) - start > longest:
        end = text.rfind("\n", start, start + longest) + 1 or text.rfind(" ", start, start + longest) or start + longest
        end = end if end > start else start + longest
        yield text[start:end]
        start = end
    yield text[start:]


def histogram(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, bucket, size, n): token sizes summed by source and hash bucket; source may be null."""
    spot = _spot(seed)
    bucket = F.shiftrightunsigned(spot, HASH_BITS - BUCKET_BITS)
    return sizes.groupBy("source", bucket.alias("bucket")).agg(
        F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n")
    )


def _spot(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 64 - HASH_BITS)


def budgets(sums: DataFrame, source_mix: DataFrame) -> DataFrame:
    """What each listed source is to give, from the histogram ``sums``.

    (source, key, share, wanted, max_repeats, own, copies, rest, exhausted); ``source``
    is spelled as in source_mix, ``key`` is its cleaned name. Shares are weight / sum of
    weights over distinct rows; null, NaN and negative weights count as 0. The total is the
    size of all documents, unlisted sources included. ``copies`` whole copies of the
    source and ``rest`` tokens of a further one make its budget, at most
    ``max_repeats`` copies (null: 1). A source without documents gives nothing.
    """
    weight = F.greatest(F.nanvl(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    listed = source_mix.where(F.col("source").isNotNull()).select(
        "source",
        clean_source(F.col("source")).alias("key"),
        weight.alias("weight"),
        F.coalesce(F.col("max_repeats"), F.lit(1)).cast("long").alias("max_repeats"),
    )
    # the list of sources is short and fixed: a window over all of it
    listed = listed.distinct().withColumn("share", F.try_divide("weight", F.sum("weight").over(W.partitionBy())))
    by_source = sums.groupBy("source").agg(F.sum("size").alias("own"))
    total = by_source.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("total"))
    own = by_source.where(F.col("source").isNotNull()).select(F.col("source").alias("key"), "own")
    b = listed.join(own, "key", "left").crossJoin(F.broadcast(total))  # one row
    b = b.withColumn("own", F.coalesce("own", F.lit(0)))
    b = b.withColumn("wanted", F.coalesce(F.col("share"), F.lit(0.0)) * F.col("total"))
    most = F.col("max_repeats") * F.col("own")
    b = b.withColumn("exhausted", F.col("wanted") > most)
    b = b.withColumn("budget", F.least(F.col("wanted"), most.cast("double")))
    b = b.withColumn("copies", F.coalesce(F.floor(F.try_divide("budget", "own")), F.lit(0)))
    b = b.withColumn("rest", F.col("budget") - F.col("copies") * F.col("own"))
    return b.select("source", "key", "share", "wanted", "max_repeats", "own", "copies", "rest", "exhausted")


def thresholds(sizes: DataFrame, sums: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, limit): documents at a hash below ``limit`` fill the partial copy without exceeding it."""
    rest = plan.groupBy(F.col("key").alias("source")).agg(F.max("rest").alias("rest"))
    level = sums.join(rest, "source").select("source", "rest", F.lit(0).cast("long").alias("base"), "bucket", "size", "n")
    placed = sizes.where(F.col("source").isNotNull()).select("source", "tokens", _spot(seed).alias("spot"))
    limits: list[DataFrame] = []
    bits = HASH_BITS
    while True:
        bits -= BUCKET_BITS
        width = 1 << bits
        # at most 1024 rows a source
        upto = F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        over = F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "n")
        held = level.withColumn("upto", upto).groupBy("source", "rest", "base")
        held = held.agg(F.min(F.when(F.col("upto") > F.col("rest"), over)).alias("f"))
        # where no bucket goes beyond what is left, the whole interval is in
        state = cut(
            held.select(
                "source",
                (F.col("rest") - F.coalesce("f.before", F.lit(0))).alias("rest"),
                (F.col("base") + F.coalesce(F.col("f.bucket"), F.lit(1 << BUCKET_BITS)) * width).alias("base"),
                (F.coalesce("f.n", F.lit(0)) <= 1).alias("settled"),
            ),
            "thresholds",
        )
        limits.append(state.where("settled").select("source", F.col("base").alias("limit")))
        state = state.where("not settled").drop("settled")
        if bits == 0 or state.isEmpty():
            limits.append(state.select("source", F.col("base").alias("limit")))
            break
        inside = placed.join(state.withColumnRenamed("base", "low"), "source")
        inside = inside.where((F.col("spot") >= F.col("low")) & (F.col("spot") < F.col("low") + width))
        placed = cut(inside.select(*placed.columns), "boundary")  # the boundary bucket only
        bucket = F.shiftrightunsigned(F.col("spot") - F.col("base"), bits - BUCKET_BITS)
        level = placed.join(state, "source").groupBy("source", "rest", "base", bucket.alias("bucket"))
        level = level.agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n"))
    out = limits[0]
    for part in limits[1:]:
        out = out.unionByName(part)
    return out


def mix(sizes: DataFrame, sums: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, n): how often each document comes in the mix, at most max_repeats times.

    Documents of unlisted sources or without source are left out, and so is what comes
    not at all.
    """
    limits = thresholds(sizes, sums, plan, seed)
    rules = plan.groupBy(F.col("key").alias("source")).agg(F.max("copies").alias("copies"))
    rules = rules.join(limits, "source", "left").withColumn("limit", F.coalesce("limit", F.lit(0)))
    n = F.col("copies") + F.when(_spot(seed) < F.col("limit"), 1).otherwise(0)
    return sizes.join(rules, "source").select("doc_id", "source", "tokens", n.alias("n")).where("n > 0")


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, exhausted) by listed source."""
    got = mixed.groupBy(F.col("source").alias("key")).agg(F.sum(F.col("tokens") * F.col("n")).alias("got"))
    out = plan.join(got, "key", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return out.select(
        "source",
        F.col("share").alias("target_share"),
        F.coalesce(F.try_divide("got", F.sum("got").over(W.partitionBy())), F.lit(0.0)).alias("actual_share"),
        F.col("got").alias("tokens"),
        "exhausted",
    )
