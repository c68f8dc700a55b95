"""LaTeX and BibTeX columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, functions as F, types as T

from pathwright.functions.text import normalised_title, squeezed


def plain(c: Column) -> Column:
    """Text without comments, citations, commands, braces and dollar signs, squeezed; what a command wraps stays."""
    s = F.regexp_replace(c, r"%[^\n]*", " ")
    s = F.regexp_replace(s, r"\\cite[a-z|]*\*?(?:\[[^\]]*\])*\{[^}]*\}", " ")
    s = F.regexp_replace(s, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{([^{}]*)\})?", "$1")
    return squeezed(F.regexp_replace(s, r"[{}$]", " "))


def without_comments(c: Column) -> Column:
    """Text without comment environments and without what follows a percent sign on its line; a percent sign after a backslash stays."""
    s = F.regexp_replace(c, r"(?s)\\begin\{comment\}.*?\\end\{comment\}", "")
    return F.regexp_replace(s, r"(?<!\\)%[^\n]*", "")


def sections(c: Column) -> Column:
    """The sections of a text as structs (title, body, key), in order; what precedes the first heading is none of them."""
    parts = F.filter(F.split(c, r"(?=\\section\*?\{)"), lambda p: p.rlike(r"^\\section\*?\{"))
    title = lambda p: F.regexp_extract(p, r"^\\section\*?\{([^{}]*)\}", 1)
    body = lambda p: F.regexp_replace(p, r"^\\section\*?\{[^{}]*\}", "")
    return F.transform(parts, lambda p: F.struct(title(p).alias("title"), body(p).alias("body"), normalised_title(title(p)).alias("key")))


def best_section(c: Column, *names: str) -> Column:
    """The body of the first section whose normalised title contains the first of the names that any contains; NULL without one."""
    every = sections(c)

    def first(name: str) -> Column:
        return F.get(F.filter(every, lambda s: F.contains(s["key"], F.lit(name))), F.lit(0))["body"]

    return F.coalesce(*map(first, names))


def cited_keys(c: Column) -> Column:
    """The keys in all citation commands of a text, in order, repeated as given."""
    groups = F.regexp_extract_all(c, F.lit(r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), 1)
    return F.filter(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k)))), lambda k: k != "")


def cite_group_pattern(keys: Column) -> Column:
    """A pattern for whole citation commands, without optional arguments, that hold one of the keys; NULL for no keys."""
    escaped = F.transform(keys, lambda k: F.concat(F.lit(r"\Q"), k, F.lit(r"\E")))
    return F.when(F.size(keys) > 0, F.concat(F.lit(r"\\cite[a-zA-Z]*\s*\{(?:[^}]*,)?\s*(?:"), F.array_join(escaped, "|"), F.lit(r")\s*(?:,[^}]*)?\}")))


def mark_target(c: Column, keys: Column, surname: Column, year: Column, marker: str = "<CITED HERE>") -> Column:
    """Citation commands of the target as the marker: those with one of its keys, or with one key that holds both its first author's surname, in any
    case, and its year or one beside it. White space may stand before the brace. Needs no Python: the pattern is a column of its own."""
    years = F.array_join(F.transform(F.array(year - 1, year, year + 1), lambda y: y.cast("string")), "|")
    both = F.when(
        (F.length(surname) > 0) & year.isNotNull(),
        F.concat(F.lit(r"\\cite[a-zA-Z]*\s*\{(?:[^}]*,)?(?=[^},]*(?iu:\Q"), surname, F.lit(r"\E))(?=[^},]*(?:"), years, F.lit(r"))[^}]*\}")),
    )
    never = F.lit(r"(?!)")
    s = F.regexp_replace(c, F.coalesce(cite_group_pattern(keys), never), F.lit(marker))
    return F.regexp_replace(s, F.coalesce(both, never), F.lit(marker))


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", re.S)
_FIELD = re.compile(r"(\w+)\s*=\s*")

BIB = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]))


def bib_entries(text: str | None) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, key, fields) of the entries of a BibTeX text; values in braces, nested at will, quotes or bare; field names in lower case.
    An entry that is cut off ends with the text."""
    if not text:
        return
    starts = list(_ENTRY.finditer(text))
    for k, m in enumerate(starts):
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        body = text[m.end() : starts[k + 1].start() if k + 1 < len(starts) else len(text)]
        fields: dict[str, str] = {}
        at = 0
        while f := _FIELD.search(body, at):
            i = f.end()
            value, at = _value(body, i)
            if value is None:
                break
            fields.setdefault(f[1].lower(), " ".join(value.split()))
        yield m[1].lower(), m[2], fields


def _value(body: str, i: int) -> tuple[str | None, int]:
    if i >= len(body):
        return None, i
    if body[i] == "{":
        depth = 0
        for j in range(i, len(body)):
            depth += (body[j] == "{") - (body[j] == "}")
            if depth == 0:
                return body[i + 1 : j], j + 1
        return body[i + 1 :], len(body)
    if body[i] == '"':
        j = body.find('"', i + 1)
        return (body[i + 1 : j], j + 1) if j > 0 else (body[i + 1 :], len(body))
    m = re.compile(r"[^,}\n]*").match(body, i)
    return m[0], max(m.end(), i + 1)


def parse_bib(c: Column) -> Column:
    """The entries of a BibTeX text as an array of structs (kind, key, fields map); an empty one for NULL and text without entries."""
    import pandas as pd

    @F.pandas_udf(BIB)
    def entries(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "key": key, "fields": fields} for k, key, fields in bib_entries(t)] for t in texts])

    return entries(c)
