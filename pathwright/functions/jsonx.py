"""JSON columns as language models return them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unfenced(c: Column) -> Column:
    """Without white space and the code fence around it."""
    s = F.regexp_replace(c, r"^\s*```(?:json|JSON)?\s*", "")
    return F.trim(F.regexp_replace(s, r"\s*```\s*$", ""))


def outermost(c: Column, opened: str = "{", closed: str = "}") -> Column:
    """From the first opening to the last closing bracket; NULL without both."""
    return F.nullif(F.regexp_extract(c, rf"(?s)(\{opened}.*\{closed})", 1), F.lit(""))


def parsed(c: Column, schema: str) -> Column:
    """The value of the schema in a text: of the whole text without its fence, else of what stands from the first to the last brace.
    NULL if neither parses; a field of another type is NULL, as is one that is missing."""
    s = unfenced(c)
    good = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(good(s), good(outermost(s)))


def parsed_list(c: Column, field: str, element: str) -> Column:
    """The list in `field` of an object, or the list that is the whole text, or the one between the first opening and the next closing
    square bracket; NULL if none parses."""
    s = unfenced(c)
    inner = F.nullif(F.regexp_extract(s, r"(?s)(\[.*?\])", 1), F.lit(""))
    wide = outermost(s, "[", "]")
    good = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.startswith(F.ltrim(x), F.lit("[")), F.from_json(x, f"array<{element}>"))
    return F.coalesce(parsed(c, f"struct<{field}: array<{element}>>")[field], good(s), good(wide), good(inner))


def covered_flag(c: Column) -> Column:
    """The boolean `covered` of a judgment, read from the text itself where the JSON is broken; NULL without it."""
    loose = F.lower(F.regexp_extract(c, r'(?i)"covered"\s*:\s*(true|false)', 1))
    return F.coalesce(parsed(c, "struct<covered: boolean>")["covered"], F.when(loose == "true", True).when(loose == "false", False))


def score_value(c: Column) -> Column:
    """The integer `score` of an alignment judgment, read from the text itself where the JSON is broken; NULL without it."""
    loose = F.regexp_extract(c, r'(?i)"?score"?\s*[:=]\s*(\d+)', 1)
    return F.coalesce(parsed(c, "struct<score: int>")["score"], F.nullif(loose, F.lit("")).try_cast("int"))


def clamped_score(c: Column, least: int = 0, most: int = 5) -> Column:
    """A score as text as an integer within bounds: decimals are cut off, what is no number counts as 0. A quoted decimal is no number."""
    whole = F.coalesce(c.try_cast("int"), F.when(c.rlike(r"^-?\d+\.\d+$"), c.try_cast("double").cast("int")), F.lit(0))
    return F.greatest(F.lit(least), F.least(F.lit(most), whole))
