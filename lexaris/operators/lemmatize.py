"""Token keys to lemmata: filters, projections and weights, as (doc_id, term, f) in and out.

A key holds TAB-separated ``ATTR=VALUE`` pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the tag and text filters
CONTENT_POS = r"^(?:N|TRUNC|VV|ADJ|ITJ|FM|XY)"
CONTENT_GOOD = r"[a-zA-Z0-9]"
CONTENT_BAD = r"(?:^[^\p{L}\p{N}_\-]*$)|(?:#)"
CAB_POS = r"^(?:N|TRUNC|VV|ADJ)"
CAB_GOOD = r"\p{L}"
CAB_BAD = r"[\.]"
PUNCT = r"\p{P}$+<=>^`|~"


@dataclass(frozen=True)
class Lemmatizer:
    text: str = "norm"
    lemma: str = "lemma"
    pos: str = "pos"
    pos_re: str | None = CONTENT_POS
    good: str | None = CONTENT_GOOD
    bad: str | None = CONTENT_BAD
    lower: bool = True
    weight: float = 1.0
    #: None: the lemma only; "always" or "if parted": its parts and those of sep_lemma too.
    parts: str | None = None
    semantic: float = 0.0


CONTENT = Lemmatizer()
PLAIN = Lemmatizer(text="plain", lemma="plain", pos_re=None)
SEP = Lemmatizer(parts="always")
SEM = Lemmatizer(parts="if parted", weight=3.0, semantic=10.0)
CAB = Lemmatizer(pos_re=CAB_POS, good=CAB_GOOD, bad=CAB_BAD, lower=False)
DDC = Lemmatizer(text="text", pos_re=CAB_POS, good=CAB_GOOD, bad=CAB_BAD, lower=False)
RAW = None

#: Spellings of the names under which lemmatizers are asked for.
NAMES = {
    "raw": RAW, "vzcontent": CONTENT, "content": CONTENT, "vzplain": PLAIN, "plain": PLAIN, "vzsep": SEP, "sep": SEP,
    "vzsem": SEM, "sem": SEM, "default": SEM, "cab": CAB, "ddc": DDC,
}


def by_name(name: str) -> Lemmatizer | None:
    return NAMES[name.lower().rpartition("::")[2]]


def attributes(key: Column) -> Column:
    """map of attribute to value; each pair is parted at its first ``=``; of a repeated attribute the last counts."""
    pairs = F.transform(
        F.filter(F.split(key, "\t"), lambda p: F.contains(p, F.lit("="))),
        lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, F.lit("=")) + 1).alias("v")),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.k == p.k))
    return F.map_from_entries(last)


def _get(name: str) -> Column:
    return F.element_at("_a", F.lit(name))


def lemmatize(tokens: DataFrame, lz: Lemmatizer | None, stop: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, f) of ``tokens`` (doc_id, key, f); ``stop`` is (text), left out by an anti join.

    Tokens without the lemma attribute are dropped; a missing text or tag is empty.
    """
    if lz is None:
        return tokens.groupBy("doc_id", F.col("key").alias("term")).agg(F.sum("f").alias("f"))
    rows = tokens.withColumn("_a", attributes(F.col("key"))).where(_get(lz.lemma).isNotNull())
    text, pos = F.coalesce(_get(lz.text), F.lit("")), F.coalesce(_get(lz.pos), F.lit(""))
    if lz.pos_re:
        rows = rows.where(pos.rlike(lz.pos_re))
    if lz.good:
        rows = rows.where(text.rlike(lz.good))
    if lz.bad:
        rows = rows.where(~text.rlike(lz.bad))
    if stop is not None:
        rows = rows.withColumn("text", text).join(stop.select("text").distinct(), "text", "left_anti")
    lemma = F.lower(_get(lz.lemma)) if lz.lower else _get(lz.lemma)
    item = lambda t, w: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))
    out = F.array(item(lemma, lz.weight))
    none = F.array().cast("array<struct<term:string,w:double>>")
    if lz.parts:
        runs = F.transform(F.regexp_extract_all(lemma, F.lit(rf"([^_\s{PUNCT}]+)"), F.lit(1)), lambda t: item(t, 1))
        sep = _get("sep_lemma")
        sep = F.regexp_replace(F.regexp_replace(sep, r"[|=]", ""), r"-|/[\p{L}\p{M}\p{N}_]+|[~\\][\p{L}\p{M}\p{N}_]+|\+|#", " ")
        sep = F.lower(sep) if lz.lower else sep
        bits = F.transform(F.regexp_extract_all(sep, F.lit(r"(\S+)"), F.lit(1)), lambda t: item(t, 1))
        if lz.parts == "if parted":
            runs = F.when(lemma.rlike(rf"[_\s{PUNCT}]"), runs).otherwise(none)
            bits = F.when(sep.rlike(r"\s"), bits).otherwise(none)
        out = F.concat(out, runs, F.coalesce(bits, none))
    if lz.semantic:
        sem = _get("sem_lemma")
        # without sep_lemma the semantic lemma is passed over
        there = _get("sep_lemma").isNotNull() & (F.coalesce(sem, F.lit("")) != "")
        classed = F.regexp_extract(sem, r"^(SEM\d+)\D", 1)
        sems = F.concat(F.array(item(sem, lz.semantic)), F.when(classed != "", F.array(item(classed, lz.semantic))).otherwise(none))
        out = F.concat(out, F.when(there, sems).otherwise(none))
    rows = rows.select("doc_id", "f", F.explode(out).alias("_o"))
    return rows.groupBy("doc_id", F.col("_o.term").alias("term")).agg(F.sum(F.col("f") * F.col("_o.w")).alias("f"))
