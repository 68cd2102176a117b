"""Frequency of every distinct term, in a vertical layout of record-identifier bitmaps.

Each term has, per chunk of 2^16 record ids, one compressed container of the records
that hold it: a sorted list of 16-bit offsets while that is shorter, else a bitmap of
8 KB. Containers of the same chunk merge by union; beside them run the occurrence
counters. The document frequency of a term is the sum of its containers' cardinalities.
A chunk bounds what one task holds of a term, however common the term is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaris.functions.text import clean_term
from lexaris.session import cut
from lexaris.tables import latest, usable

CHUNK_BITS = 16
#: Members from which the bitmap is the shorter form.
DENSE = (1 << CHUNK_BITS) // 16


def pack(offsets: np.ndarray) -> bytes:
    """A container of distinct offsets: one byte for its form, then the list or the bitmap."""
    members = np.unique(np.asarray(offsets, dtype=np.int64))
    if len(members) <= DENSE:
        return b"\x00" + members.astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
    bits[members] = 1
    return b"\x01" + np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    """The sorted offsets of a container."""
    if container[:1] == b"\x00":
        return np.frombuffer(container, dtype="<u2", offset=1).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(container, dtype=np.uint8, offset=1), bitorder="little")
    return np.flatnonzero(bits)


def union(a: bytes, b: bytes) -> bytes:
    return pack(np.concatenate([unpack(a), unpack(b)]))


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs runs of equal (term, chunk); the input is sorted by term, chunk and offset."""
    kept: pd.DataFrame | None = None

    def built(rows: pd.DataFrame) -> pa.RecordBatch:
        term, chunk = rows["term"].to_numpy(), rows["chunk"].to_numpy()
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])
        starts = np.flatnonzero(new)
        offsets = rows["offset"].to_numpy()
        bits = [pack(offsets[a:b]) for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]
        return pa.RecordBatch.from_pydict(
            {
                "term": pa.array(term[starts], pa.string()),
                "chunk": pa.array(chunk[starts], pa.int64()),
                "bits": pa.array(bits, pa.binary()),
                "gf": pa.array(np.add.reduceat(rows["f"].to_numpy(), starts), pa.float64()),
            }
        )

    for batch in batches:
        rows = batch.to_pandas()
        rows = rows if kept is None else pd.concat([kept, rows], ignore_index=True)
        if rows.empty:
            continue
        last = (rows["term"] == rows["term"].iloc[-1]) & (rows["chunk"] == rows["chunk"].iloc[-1])
        kept, ready = rows[last], rows[~last]  # a run has at most 2^16 records
        if len(ready):
            yield built(ready)
    if kept is not None and len(kept):
        yield built(kept)


def vertical(tf: DataFrame) -> DataFrame:
    """(term, chunk, bits, gf): the containers and counters of every counted term.

    Null, blank, zero, negative and infinite values take no part; terms are trimmed and
    composed; repeated and late rows count once, the latest holds; an empty table gives
    an empty result. Versions of a row can lie anywhere in the table, so nothing can be
    counted before they meet; they do so under the container's key, and the one shuffle
    serves both the choice of the latest and the building of containers.
    """
    rows = tf.where(F.col("doc_id").isNotNull()).select(
        clean_term(F.col("term")).alias("term"),
        F.shiftright("doc_id", CHUNK_BITS).alias("chunk"),
        F.col("doc_id").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int").alias("offset"),
        F.col("f").cast("double").alias("f"),
        "seen_at",
    )
    rows = rows.where(F.col("term").isNotNull()).repartition("term", "chunk")
    rows = latest(rows, ["term", "chunk", "offset"], ["f"]).where(usable(F.col("f")) & (F.col("f") > 0))
    rows = rows.sortWithinPartitions("term", "chunk", "offset")
    return rows.mapInArrow(_containers, "term string, chunk long, bits binary, gf double")


def cardinality(bits: str) -> Column:
    """Members of a container, read in the JVM."""
    col = F.col(bits)
    sparse = ((F.octet_length(col) - 1) / 2).cast("long")
    return F.when(F.hex(col.substr(1, 1)) == "00", sparse).otherwise(F.bitmap_count(col.substr(2, 1 << 13)))


def frequencies(tf: DataFrame, min_freq: float, min_doc_freq: float, max_doc_share: float) -> DataFrame:
    """(term, gf, df, mark) of every term; mark is "rare", "common" or null.

    Rare: gf < min_freq or df < min_doc_freq; common: df > max_doc_share x documents with
    counted rows. The number of documents is the cardinality of the union of all terms'
    containers, taken chunk by chunk.
    """
    parts = cut(vertical(tf), "vertical")
    n_docs = documents(parts).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"))
    terms = parts.groupBy("term").agg(F.sum("gf").alias("gf"), F.sum(cardinality("bits")).alias("df"))
    rare = (F.col("gf") < min_freq) | (F.col("df") < min_doc_freq)
    common = F.col("df") > F.lit(max_doc_share) * F.col("n_docs")
    mark = F.when(rare, "rare").when(common, "common")
    return terms.crossJoin(F.broadcast(n_docs)).select("term", "gf", "df", mark.alias("mark"))  # one row


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union of containers per chunk within the partition; memory is 64 KB a chunk."""
    seen: dict[int, np.ndarray] = {}
    for rows in batches:
        for chunk, bits in zip(rows["chunk"], rows["bits"], strict=True):
            if chunk not in seen:
                seen[chunk] = np.zeros(1 << CHUNK_BITS, dtype=bool)
            seen[chunk][unpack(bits)] = True
            if len(seen) > 512:
                yield pd.DataFrame({"chunk": list(seen), "bits": [pack(np.flatnonzero(v)) for v in seen.values()]})
                seen = {}
    if seen:
        yield pd.DataFrame({"chunk": list(seen), "bits": [pack(np.flatnonzero(v)) for v in seen.values()]})


def documents(parts: DataFrame) -> DataFrame:
    """(chunk, n): how many records occur at all, by union of the containers."""
    once = parts.select("chunk", "bits").mapInPandas(_united, "chunk long, bits binary")
    whole = once.repartition("chunk").mapInPandas(_merged, "chunk long, bits binary")
    return whole.select("chunk", cardinality("bits").alias("n"))


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One container per chunk; all of a chunk's containers are in this partition."""
    seen: dict[int, bytes] = {}
    for rows in batches:
        for chunk, bits in zip(rows["chunk"], rows["bits"], strict=True):
            seen[chunk] = union(seen[chunk], bits) if chunk in seen else bits
    if seen:
        yield pd.DataFrame({"chunk": list(seen), "bits": list(seen.values())})
