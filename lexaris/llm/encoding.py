"""Garbled text from wrong character encoding: find it, learn how it arose, restore it.

The grain is the word, since a text may be garbled in places only. Words are taken as
vocabulary with their document counts, so all the work below grows with the vocabulary.

1. *Near-twins.* For each word with signs beyond ASCII (character references resolved)
   the words it may have been are those with the same ASCII letters, aligned sign run by
   sign run, of which it is the wrongly decoded form under some pair of encodings. They
   are joined with the words of the collection on the text stripped of non-ASCII signs and
   the aligned signs, which is an equi-join, not a comparison of all pairs.
2. *Transformations.* A pair of encodings counts as seen here if several words have a
   commoner twin under it; a sign counts as garbled under it if most words with the sign
   have such a twin.
   What no listed pair of encodings explains is learned from the twins alone: a word and
   the commonest word with the same ASCII letters are aligned run by run, runs of equal
   length sign by sign, and what one stands for the other in several words, and in most
   of the words that have it, is a mapping (``aligned``).
3. *Application.* The transformations and signs learned are applied to the remaining
   words, which have no twin of their own, and texts are rebuilt from restored words. A
   word wholly beyond ASCII, as Cyrillic ones are, counts if all its signs are learned, or
   if most such words of its document have a twin under the transformation.

Text stored as UTF-8 and read in another encoding shows by itself, as hardly any proper
word happens to be well-formed UTF-8 in that encoding; replacement characters always
show. These need no learned support, only that the restored signs are ones that the
collection uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaris.session import cut

#: Encodings that texts were read in, and single-byte encodings that they were stored in.
READ_AS = (
    "cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2",
    "iso8859_15", "mac_cyrillic",
)
STORED_AS = ("cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850")
#: Distinct words with a commoner twin from which a pair of single-byte encodings counts as seen.
MIN_WORDS = 3
#: Share of a sign's occurrences that are in words with a twin, from which the sign itself counts as garbled.
MIN_SHARE = 0.5
#: Words from which a sign counts as used in the collection.
MIN_USE = 3

REFERENCE = re.compile(r"&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
RUN = re.compile(r"[^\x00-\x7f]+")
#: Typographic signs that may stand beside a garbled run without being part of it.
EDGE = "–—“”„‘’‚«»…"
NOT_ASCII = r"[^\x00-\x7F]|&#[xX]?[0-9A-Fa-f]{1,7};"


def resolve(word: str) -> str:
    """Character references beyond ASCII as the signs they stand for."""

    def sign(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0x80 <= code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return REFERENCE.sub(sign, word)


@lru_cache
def _bytes_of(encoding: str) -> dict[str, int]:
    """Sign to byte for the upper half; bytes that the encoding leaves open stand for the control of that number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


@lru_cache
def _table(stored: str, read: str) -> dict[str, str]:
    """Sign as read to sign as stored, for two single-byte encodings."""
    signs = {b: s for s, b in _bytes_of(stored).items()}
    return {s: signs[b] for s, b in _bytes_of(read).items()}


def from_utf8(run: str, read: str) -> str | None:
    """The run before its UTF-8 bytes were read as ``read``; None if they are not well-formed."""
    table = _bytes_of(read)
    try:
        return bytes(table[s] for s in run).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def _runs(word: str, repair) -> str | None:
    """The word with all its runs repaired that can be; None if none can."""
    changed = False

    def one(m: re.Match) -> str:
        nonlocal changed
        run = m[0]
        lead = run[: len(run) - len(run.lstrip(EDGE))]
        tail = run[len(run.rstrip(EDGE)) :] if len(lead) < len(run) else ""
        for a, b in ((0, 0), (len(lead), 0), (0, len(tail)), (len(lead), len(tail))):
            core = run[a : len(run) - b]
            fixed = repair(core) if core else None
            if fixed is not None and fixed != core:
                changed = True
                return run[:a] + fixed + run[len(run) - b :]
        return run

    out = RUN.sub(one, word)
    return out if changed else None


def _mixed(word: str) -> bool:
    """Whether Latin letters stand beside Greek or Cyrillic ones."""
    latin = any(s.isalpha() and s < "\u0250" for s in word)
    return latin and any(s.isalpha() and "\u0370" <= s < "\u0530" for s in word)


def candidates(word: str) -> list[tuple[str, str]]:
    """(transformation, earlier form) of a word under every pair of encodings that fits."""
    plain = resolve(word)
    out = []
    for read in READ_AS:
        fixed = _runs(plain, lambda run, read=read: from_utf8(run, read))
        if fixed is None:
            continue
        out.append((f"utf-8>{read}", fixed))
        # garbled twice or more: each further step must again be well-formed
        for depth in (2, 3):
            again = _runs(fixed, lambda run, read=read: from_utf8(run, read))
            if again is None:
                break
            out.append((f"utf-8>{read}*{depth}", again))
            fixed = again
    signs = {s for s in plain if s > "\x7f"}
    for read in READ_AS:
        if not signs <= _bytes_of(read).keys():
            continue
        for stored in STORED_AS:
            table = _table(stored, read)
            fixed = "".join(table.get(s, s) for s in plain)
            # the signs must all have moved into printable ones of one script
            if stored != read and fixed != plain and all(map(str.isprintable, fixed)) and not _mixed(fixed):
                out.append((f"{stored}>{read}", fixed))
    return out


def _shouted(before: str, after: str) -> bool:
    """Whether a word in capitals would come to hold small letters."""
    capitals = [s for s in before if s.isascii() and s.isalpha()]
    return len(capitals) > 1 and all(s.isupper() for s in capitals) and any(s.islower() for s in after)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for word, df in zip(rows["word"], rows["df"], strict=True):
            plain = resolve(word)
            letters = sum(s.isascii() and s.isalnum() for s in plain), sum(not s.isascii() and s.isalpha() for s in plain)
            firm = letters[0] >= 2 or letters[1] >= 3 or bool(re.search(r"[\x80-\x9f]", plain))
            signs = sorted({s for s in plain if s > "\x7f"})
            beside = all(re.search(f"[A-Za-z]{re.escape(s)}|{re.escape(s)}[A-Za-z]", plain) for s in signs)
            for chain, fixed in candidates(word):
                if _shouted(plain, fixed):
                    continue
                new = [s for s in set(fixed) if s > "\x7f"]
                # wholly of signs beyond ASCII, as Cyrillic is
                whole = not letters[0] and sum(not s.isascii() and s.isalpha() for s in fixed) >= 3
                out.append((word, df, chain, fixed, firm, signs, beside, whole, new))
        yield pd.DataFrame(out, columns=["word", "df", "chain", "fixed", "firm", "signs", "beside", "whole", "new_signs"])


_SCHEMA = (
    "word string, df long, chain string, fixed string, firm boolean, signs array<string>, beside boolean, "
    "whole boolean, new_signs array<string>"
)


def _bare(token: Column) -> Column:
    """A token without ASCII punctuation around it; a character reference is no punctuation."""
    head = F.regexp_replace(token, r"^(?:<[^<>]*>|(?!&#)[!-/:-@\[-`{-~])+", "")
    return F.regexp_replace(head, r"(?:<[^<>]*>|(?<!&#[0-9a-fA-FxX]{1,8};)(?!;)[!-/:-@\[-`{-~]|(?<!&#[0-9a-fA-FxX]{1,8});)+$", "")


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, token, word): the distinct tokens of a document that have signs beyond ASCII."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    parts = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda t: t.rlike(NOT_ASCII)))
    rows = rows.select("doc_id", F.explode(parts).alias("token"))
    return rows.withColumn("word", _bare(F.col("token"))).where(F.col("word") != "")


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.assign(plain=rows["word"].map(resolve))


def vocabulary(found: DataFrame) -> DataFrame:
    """(word, df, plain) over the tokens with signs beyond ASCII; ``plain`` has character references resolved."""
    words = found.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # only words with references need Python
    referring = F.contains("word", F.lit("&#"))
    resolved = words.where(referring).mapInPandas(_resolved, "word string, df long, plain string")
    return words.where(~referring).withColumn("plain", F.col("word")).unionByName(resolved)


def scored(vocab: DataFrame) -> DataFrame:
    """The candidates of all words without replacement characters, and whether a commoner word is their twin."""
    tasks = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cand = vocab.where(~F.contains("plain", F.lit("�"))).select("word", "df").repartition(tasks)
    cand = cut(cand.mapInPandas(_candidates, _SCHEMA), "candidates")
    skeleton = lambda c: F.regexp_replace(c, NOT_ASCII, "")
    twins = vocab.select(F.col("word").alias("fixed"), F.col("df").alias("twin_df"), skeleton(F.col("word")).alias("ascii"))
    cand = cand.withColumn("ascii", skeleton(F.col("fixed"))).join(twins, ["ascii", "fixed"], "left").drop("ascii")
    utf8 = F.startswith("chain", F.lit("utf-8>"))
    return cut(cand.withColumn("utf8", utf8).withColumn("twin", F.coalesce(F.col("twin_df") > F.col("df"), F.lit(False))), "twins")


def learn(vocab: DataFrame, cand: DataFrame) -> DataFrame:
    """(word, fixed, chain): what each garbled word was, by twins and by learned transformations.

    ``fixed`` still holds U+FFFD where the sign cannot be told. Empty without garbled words.
    """
    seen = cand.where(F.col("twin") & F.col("firm")).groupBy("chain").agg(F.count(F.lit(1)).alias("support"))
    # signs by transformation: how many words have them, how often, and how much of it in words with a twin
    words_with = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("sign"), "df")
    words_with = words_with.where(F.col("sign") > "\x7f").groupBy("sign")
    words_with = words_with.agg(F.count(F.lit(1)).alias("all"), F.sum("df").alias("all_df"))
    by_sign = cand.where(F.col("twin") & F.col("firm") & ~F.col("utf8")).select("chain", "df", F.explode("signs").alias("sign"))
    by_sign = by_sign.groupBy("chain", "sign").agg(F.count(F.lit(1)).alias("twinned"), F.sum("df").alias("twinned_df"))
    learned = by_sign.join(words_with, "sign")
    learned = learned.where((F.col("twinned") >= 2) & (F.col("twinned_df") >= MIN_SHARE * F.col("all_df")))
    # signs that the collection uses
    used = words_with.where(F.col("all") >= MIN_USE).select("sign")

    keys = ["word", "chain"]
    all_used = cand.where("utf8").select(*keys, F.explode("new_signs").alias("sign")).join(used, "sign", "left_anti")
    strange = all_used.select(*keys).distinct()
    unlearned = (
        cand.where("not utf8 and not twin and (beside or whole)")
        .select(*keys, F.explode("signs").alias("sign"))
        .join(learned.select("chain", "sign"), ["chain", "sign"], "left_anti")
        .select(*keys)
        .distinct()
    )
    by_utf8 = cand.where("utf8").join(strange, keys, "left_anti")
    # a twin, or only signs that are in use
    by_utf8 = by_utf8.unionByName(cand.where("utf8 and twin").join(strange, keys, "left_semi"))
    by_twin = cand.where("not utf8 and twin and firm")
    by_sign = cand.where("not utf8 and not twin and (beside or whole)").join(unlearned, keys, "left_anti")
    kept = by_utf8.unionByName(by_twin).unionByName(by_sign).join(seen, "chain", "left")
    kept = kept.withColumn("support", F.coalesce("support", F.lit(0)))
    kept = kept.where(F.col("utf8") | (F.col("support") >= MIN_WORDS))
    # UTF-8 shows by itself; else the commoner twin, else the more frequent transformation, else its name
    rank = F.struct("utf8", F.coalesce("twin_df", F.lit(0)), "support", "chain", "fixed")
    best = kept.groupBy("word").agg(F.max(rank).alias("b"))
    return best.select("word", F.col("b.fixed").alias("fixed"), F.col("b.chain").alias("chain"))


def _runs_of(col: str) -> Column:
    return F.regexp_extract_all(col, F.lit(r"([^\x00-\x7F]+)"), F.lit(1))


def _units(was: Column, now: Column) -> Column:
    """Aligned (was, now) of two arrays of runs: whole runs, signs where two runs are equally long."""
    pairs = F.arrays_zip(was.alias("was"), now.alias("now"))
    signs = lambda p: F.arrays_zip(F.split(p.was, "").alias("was"), F.split(p.now, "").alias("now"))
    even = F.flatten(F.transform(F.filter(pairs, lambda p: F.length(p.was) == F.length(p.now)), signs))
    odd = F.filter(pairs, lambda p: F.length(p.was) != F.length(p.now))
    return F.array_distinct(F.filter(F.concat(even, odd), lambda p: p.was != p.now))


def mappings(found: DataFrame, words: DataFrame) -> DataFrame:
    """(was, now): signs and runs that stand for others, learned from twins aligned with each other.

    ``words`` is (word, df, plain, p), p the plain word with its runs blotted out. The twin
    of a word is the commonest with the same p. A mapping needs MIN_WORDS words, MIN_SHARE of
    the words with the sign, and documents that show another one too, as a wrong decoding
    changes more than one sign.
    """
    commonest = words.groupBy("p").agg(F.max(F.struct("df", "plain")).alias("t"))
    twins = words.join(commonest, "p").where((F.col("t.df") > F.col("df")) & (F.col("t.plain") != F.col("plain")))
    twins = twins.withColumn("twin", F.col("t.plain"))
    units = twins.select("word", F.explode(_units(_runs_of("plain"), _runs_of("twin"))).alias("u")).select("word", "u.*")
    units = units.groupBy("was", "now").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_WORDS)
    runs = _runs_of("plain")
    having = F.array_distinct(F.concat(runs, F.flatten(F.transform(runs, lambda r: F.split(r, "")))))
    having = words.select("word", F.explode(having).alias("was"))
    all_ = having.groupBy("was").agg(F.count(F.lit(1)).alias("all"))
    units = units.join(all_, "was").where(F.col("n") >= MIN_SHARE * F.col("all"))
    best = units.groupBy("was").agg(F.max(F.struct("n", "now")).alias("b")).select("was", F.col("b.now").alias("now"))
    best = cut(best, "mappings")
    if best.isEmpty():
        return best
    shown = found.join(having.join(best, "was"), "word").select("doc_id", "was").distinct()
    several = shown.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    backed = shown.join(several, "doc_id").groupBy("was").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(best.join(backed.select("was"), "was"), "backed-mappings")


def aligned(found: DataFrame, vocab: DataFrame, known: DataFrame) -> DataFrame:
    """(word, fixed, chain): words not known otherwise of which every run has a learned mapping.

    Words with fewer than two ASCII letters teach nothing, as too many share their pattern,
    but take part in the application.
    """
    words = vocab.where(~F.contains("plain", F.lit("�")))
    words = words.withColumn("p", F.regexp_replace("plain", r"[^\x00-\x7F]+", "\x01"))
    learned = mappings(found, words.where(F.length(F.regexp_replace("p", "[^A-Za-z]", "")) >= 2))
    rest = words.join(known.select("word"), "word", "left_anti")
    none = known.select("word", "fixed", "chain").limit(0)
    if learned.isEmpty():
        return none
    pieces = F.regexp_extract_all("plain", F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"), F.lit(1))
    pieces = rest.select("word", F.posexplode(pieces).alias("i", "piece"))
    pieces = pieces.join(learned.select(F.col("was").alias("piece"), F.col("now").alias("run")), "piece", "left")
    done = F.when(F.col("piece").rlike(r"^[\x00-\x7F]"), F.col("piece")).otherwise(F.col("run"))
    pieces = pieces.select("word", "i", F.posexplode(F.when(done.isNotNull(), F.array(done)).otherwise(F.split("piece", ""))).alias("j", "sign"), done.isNotNull().alias("done"))
    pieces = pieces.join(learned.select(F.col("was").alias("sign"), F.col("now").alias("other")), "sign", "left")
    fixed = F.when(F.col("done"), F.col("sign")).otherwise(F.col("other"))
    pieces = pieces.groupBy("word").agg(
        F.bool_and(fixed.isNotNull()).alias("whole"),
        F.sort_array(F.collect_list(F.struct("i", "j", fixed.alias("s")))).alias("parts"),
    )
    out = pieces.where("whole").select("word", F.array_join(F.col("parts.s"), "").alias("fixed"), F.lit("aligned").alias("chain"))
    # a shouted word stays as it is, like those of the listed encodings
    loud = F.col("word").rlike("[A-Z].*[A-Z]") & ~F.col("word").rlike("[a-z]") & F.col("fixed").rlike(r"\p{Ll}")
    return out.where(~loud)


def by_document(found: DataFrame, cand: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, token, word, fixed, chain): words wholly beyond ASCII that their document tells to be garbled.

    A transformation holds for a document if MIN_WORDS such words of it at least, and
    MIN_SHARE of all such words, are restored by a twin under it; then it holds for
    those of the document that are not known otherwise.
    """
    whole = cand.where("whole and firm and not utf8")
    proved = whole.where("twin").join(known.select("word", "chain"), ["word", "chain"], "left_semi").select("word", "chain")
    support = found.join(proved, "word").select("doc_id", "word", "chain").distinct()
    support = support.groupBy("doc_id", "chain").agg(F.count(F.lit(1)).alias("support"))
    support = cut(support.where(F.col("support") >= MIN_WORDS), "support")
    all_ = found.join(support.select("doc_id").distinct(), "doc_id", "left_semi")
    all_ = all_.join(whole.select("word").distinct(), "word", "left_semi").select("doc_id", "word").distinct()
    all_ = all_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("all"))
    holds = support.join(all_, "doc_id").where(F.col("support") >= MIN_SHARE * F.col("all")).drop("all")
    rest = found.join(holds, "doc_id").join(known.select("word"), "word", "left_anti")
    rest = rest.join(whole.where("not twin").select("word", "chain", "fixed"), ["word", "chain"])
    best = rest.groupBy("doc_id", "token", "word").agg(F.max(F.struct("support", "chain", "fixed")).alias("b"))
    return best.select("doc_id", "token", "word", F.col("b.fixed").alias("fixed"), F.col("b.chain").alias("chain"))


def replaced(vocab: DataFrame) -> DataFrame:
    """(word, fixed, chain) of words with replacement characters or references to them, restored by
    the commonest word with the same letters around any one sign each; only resolved where there is none."""
    pattern = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "\x01")
    lost = F.contains("plain", F.lit("�"))
    clean = vocab.where(~lost).select(pattern(F.col("plain")).alias("p"), F.struct("df", "plain").alias("w"))
    clean = clean.groupBy("p").agg(F.max("w").alias("w")).where(F.regexp_replace("p", "[^A-Za-z]", "") != "")
    gone = vocab.where(lost).withColumn("p", pattern(F.col("plain"))).join(clean, "p", "left")
    return gone.select("word", F.coalesce("w.plain", "plain").alias("fixed"), F.lit("replaced").alias("chain"))


def garbled_tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, token, word, fixed, chain): every garbled token of every document.

    Null and empty texts and rows without doc_id have none; repeated rows give one row;
    an empty table gives an empty result. Texts of any length are taken whole.
    """
    found = cut(tokens(documents), "tokens")
    vocab = cut(vocabulary(found), "vocabulary")
    cand = scored(vocab)
    known = cut(learn(vocab, cand).unionByName(replaced(vocab)), "garbled")
    known = cut(known.unionByName(aligned(found, vocab, known)), "garbled-aligned")
    out = found.join(known, "word").select("doc_id", "token", "word", "fixed", "chain")
    return out.unionByName(by_document(found, cand, known)).distinct()


def restored(documents: DataFrame, garbled: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_lost): garbled documents with their words restored.

    ``n_lost`` words keep a replacement character. The map of a document holds its own
    distinct garbled tokens.
    """
    entry = F.struct("token", F.expr("replace(token, word, fixed)").alias("fixed"))
    per_doc = garbled.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_set(entry)).alias("m"),
        F.count(F.lit(1)).alias("n_words"),
        F.count_if(F.contains("fixed", F.lit("�"))).alias("n_lost"),
    )
    rows = documents.join(per_doc.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(r"(\s+|\S+)"), F.lit(1))
    text = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at("m", p), p)), "")
    return rows.join(per_doc, "doc_id").select("doc_id", text.alias("text"), "n_words", "n_lost")
