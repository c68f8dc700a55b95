"""Columns of bibliographic strings: titles, author lists, years."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Letters whose accent is not a combining mark, with what they fold to: fixed values.
_BARRED = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ŧ": "t", "ß": "s", "æ": "a", "œ": "o", "þ": "t", "ð": "d"}


def _folding() -> tuple[str, str]:
    pairs = dict(_BARRED)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        low = chr(code).lower()
        base = unicodedata.normalize("NFKD", low)[:1]
        if len(low) == 1 and low not in pairs and base.isascii() and base.isalpha():
            pairs[low] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _folding()


def folded(c: Column) -> Column:
    """Lower case without accents and invisible characters."""
    return F.translate(F.regexp_replace(F.lower(c), "[̀-ͯ­​-‏⁠﻿]", ""), _FROM, _TO)


def title_key(c: Column) -> Column:
    """The words of a title, folded, a space between; NULL for NULL and for titles without a letter or digit."""
    return F.nullif(F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def _last_word(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def surnames(c: Column) -> Column:
    """The folded surnames of an author string, in order.

    Understands `F. Last and G. Last`, `Last, F.; Last, G.`, `First Last, First Last`, `Last, First`, `Last et al.` and `Last`.
    NULL and blank strings give an empty list."""
    a = F.trim(F.regexp_replace(c, r"(?i)[\s,]*\bet\.? al\.?\s*$", ""))
    first_part = lambda x: F.trim(F.split_part(x, F.lit(","), F.lit(1)))
    names = (
        F.when(a.contains(";"), F.transform(F.split(a, r"\s*;\s*"), first_part))
        .when(a.rlike(r"(?i)\s(?:and|&)\s"), F.transform(F.split(a, r"(?i)\s*,?\s+(?:and|&)\s+|\s*,\s*"), _last_word))
        .when(a.rlike(r"^[^,]+,\s*(?:\p{L}\.?[\s-]*)+$") & ~a.rlike(r"^\S+\s+\S+.*,.*\p{L}{2}") | a.rlike(r"^\S+,\s*\S+$"), F.array(first_part(a)))
        .when(a.contains(","), F.transform(F.split(a, r"\s*,\s*"), _last_word))
        .otherwise(F.array(_last_word(a)))
    )
    keys = F.transform(names, lambda x: F.regexp_replace(folded(x), r"[^\p{L}\p{N}]+", ""))
    return F.coalesce(F.filter(keys, lambda x: F.length(x) > 1), F.array().cast("array<string>"))
