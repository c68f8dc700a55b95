"""Identifier columns: arXiv, DOI, anthology and graph ids in their many spellings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Spellings that stand for a missing value.
STAND_INS = ("", "-", "--", "?", ".", "n/a", "na", "nan", "none", "null", "nil", "unknown", "undefined", "missing", "tbd", "todo")

_ARXIV = r"^(\d{4}\.\d{4,5})(?:v\d+)?$"
_HEX40 = r"^[0-9a-f]{40}$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s​﻿]+|[\s​﻿]+$", "")


def missing_to_null(c: Column) -> Column:
    """NULL for NULL, blank and stand-in values; else the value as it is."""
    return F.when(~F.lower(stripped(c)).isin(*STAND_INS), c)


def canonical_paper_id(c: Column) -> Column:
    """One spelling for the spellings of a paper id: `arxiv:`, `doi:`, `acl:` or `s2:` and the bare id.

    Case, white space, the scheme's name in front, addresses, a version and a file ending do not matter.
    NULL, blank and stand-in values give NULL; an id of no known kind gives `raw:` and its lower case."""
    s = F.lower(stripped(c))
    kept = F.when(~s.isin(*STAND_INS), s)
    bare = F.regexp_replace(kept, r"^https?://[^/]+/", "")
    bare = F.regexp_replace(bare, r"^(?:abs|pdf|paper|html|e-print)/", "")
    bare = F.regexp_replace(bare, r"(?:\.pdf|/)+$", "")
    bare = F.regexp_replace(bare, r"^(?:(?:arxiv|doi|acl|s2|corpus)(?:\s*[:.]\s*|\s+))+", "")
    bare = F.regexp_replace(bare, r"^10\.48550/arxiv\.", "")
    return (
        F.when(bare.rlike(_ARXIV), F.concat(F.lit("arxiv:"), F.regexp_extract(bare, _ARXIV, 1)))
        .when(bare.rlike(_HEX40), F.concat(F.lit("s2:"), bare))
        .when(bare.rlike(r"^10\.\d{3,}/.+"), F.concat(F.lit("doi:"), bare))
        .when(bare.rlike(r"^\d{4}\.[a-z0-9]+-[a-z0-9]+\.\d+$"), F.concat(F.lit("acl:"), bare))
        .when(bare != "", F.concat(F.lit("raw:"), bare))
    )


def valid_graph_id(c: Column) -> Column:
    """Whether the id is 40 lower-case hexadecimal characters."""
    return F.coalesce(c.rlike(_HEX40), F.lit(False))
