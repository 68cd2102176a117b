"""Words of a text in a form where spelling and layout do not matter."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def _bare_letters() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and their bases, by rule from the Unicode data."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if base != char and base.isalpha():
            source.append(char)
            target.append(base.lower())
    return "".join(source), "".join(target)


def plain(col: Column) -> Column:
    """Lower case without markup, accents and line-end hyphens; ä, ae and a alike; one blank between words.

    Quoting marks, apostrophes and hyphens within a word are dropped, all other signs
    part words. Null stays null.
    """
    t = F.regexp_replace(col, r"<[^<>]{0,200}>|&#?[0-9A-Za-z]{1,10};", " ")
    t = F.regexp_replace(t, r"[-‐‑¬­][ \t\r]*\n\s*|\p{M}+", "")
    t = F.translate(F.lower(t), *_bare_letters())
    for letter, two in (("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
        t = F.replace(t, F.lit(letter), F.lit(two))
    t = F.regexp_replace(t, "([aou])e", "$1")
    t = F.regexp_replace(t, r"['’‘`´ʼ­‐‑-]+", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def words(col: Column) -> Column:
    """Array of plain words; empty for a null or empty text."""
    return F.filter(F.split(F.coalesce(plain(col), F.lit("")), " "), lambda w: w != "")
