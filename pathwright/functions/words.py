"""Word forms of messy text, for Arrow functions (plain Python, no Spark)."""

from __future__ import annotations

import re
import unicodedata

_CITE = re.compile(r"\\(?:cite\w*|ref|label|eqref)\*?(?:\[[^\]]*\])*\{[^{}]*\}|\[\d+(?:\s*[,;-]\s*\d+)*\]|\[CITATION\]", re.I)
_COMMAND = re.compile(r"\\[A-Za-z]+\*?|&[a-z]{2,6};|</?[A-Za-z][^<>]{0,80}>")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case, compatibility forms resolved, accents and invisible characters gone."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text)).lower()
    return "".join(c for c in text if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """The words of a text, without markup, citation marks, case, accents and punctuation.
    A NULL text has no words."""
    if not text:
        return []
    if "\\" in text or "[" in text or "<" in text or "&" in text:
        text = _COMMAND.sub(" ", _CITE.sub(" ", text))
    if "-" in text and "\n" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(folded(text))
