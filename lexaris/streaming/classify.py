"""A stream of documents in, their categories out; no state between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaris.operators.classify import best, ranked, raw_distances
from lexaris.operators.signatures import count_tokens, tokenize


def classify_batch(documents: DataFrame, vocabulary: DataFrame, tcm: DataFrame) -> DataFrame:
    """(doc_id, cat_id, d): the nearest category of each document of a batch."""
    tdm0 = count_tokens(tokenize(documents)).join(vocabulary.select("term"), "term", "left_semi")
    used = tcm.select("cat_id").distinct()
    return best(ranked(raw_distances(tdm0, tcm, documents.select("doc_id").distinct(), used)))


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, vocabulary: DataFrame, tcm: DataFrame, once: bool = True):
    """Classifies the Parquet files (doc_id, text) that come into ``source`` and appends to ``sink``.

    Each micro-batch writes the folder of its number, so a batch that is repeated after a
    failure replaces itself.
    """
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        out = classify_batch(batch, vocabulary, tcm).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
