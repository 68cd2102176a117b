"""Text expressions: blanks, canonical composition, names."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a blank around a name or term.
BLANKS = " \t\n\r\f\u000b\u00a0\u2002\u2003\u2009\u3000\ufeff"


def strip_blanks(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


@lru_cache
def _compositions() -> dict[str, str]:
    """Every canonical composition outside Hangul, by rule from the Unicode data."""
    out = {}
    for code in range(0xA0, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        apart = unicodedata.normalize("NFD", char)
        if apart != char and len(apart) > 1 and unicodedata.normalize("NFC", apart) == char:
            out[apart] = char
            # partly composed spellings, such as a composed base and one further mark
            for i in range(2, len(apart)):
                head = unicodedata.normalize("NFC", apart[:i])
                if len(head) == 1:
                    out[head + apart[i:]] = char
    return out


def compose(col: Column) -> Column:
    """NFC inside the JVM.

    Only values holding a combining mark take the slow branch, where each letter is
    looked up together with its marks; marks are expected in canonical order.
    """
    pairs = "\x01".join(f"{apart}\x02{whole}" for apart, whole in sorted(_compositions().items()))
    table = F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))  # folded into one literal
    letters = F.regexp_extract_all(col, F.lit(r"(\P{M}\p{M}*|^\p{M}+)"), F.lit(1))
    return F.when(
        col.rlike(r"\p{M}"),
        F.array_join(F.transform(letters, lambda c: F.coalesce(F.element_at(table, c), c)), ""),
    ).otherwise(col)


def clean_term(col: Column) -> Column:
    """A term trimmed and composed; null where it is null or blank."""
    bare = strip_blanks(col)
    return F.when(F.length(bare) > 0, compose(bare))


def clean_name(col: Column) -> Column:
    """A category name without ``NN_`` prefix, case and blanks around it; null if none is left."""
    bare = F.regexp_replace(F.lower(compose(strip_blanks(col))), r"^[0-9]+_", "")
    return F.when(F.length(bare) > 0, bare)


def clean_source(col: Column) -> Column:
    bare = F.lower(compose(strip_blanks(col)))
    return F.when(F.length(bare) > 0, bare)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def dirname(path: Column) -> Column:
    """The folder of a path; ``.`` where it names none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def trim_suffix(path: Column, pattern: str) -> Column:
    """``path`` without its first match of ``pattern``, such as a suffix."""
    found = F.regexp_extract(path, f"({pattern})", 1)
    at = F.instr(path, found)
    rest = F.concat(F.substr(path, F.lit(1), at - 1), F.substr(path, at + F.length(found)))
    return F.when(found != "", rest).otherwise(path)


def output_name(path: Column, trim: str = r"\.[^.]*$", suffix: str = "") -> Column:
    """Where what is made of the file ``path`` goes: beside it, under its name trimmed and with ``suffix``."""
    return F.concat(dirname(path), F.lit("/"), trim_suffix(basename(path), trim), F.lit(suffix))


def short_label(label: Column) -> Column:
    """The name of a file without folder and suffixes, a page number at its end as ``?p=NUMBER``."""
    return F.regexp_replace(F.regexp_replace(basename(label), r"\.\D.*$", ""), r"\.(\d+)$", "?p=$1")


def underscored(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "_")
