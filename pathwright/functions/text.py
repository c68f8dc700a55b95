"""Text columns: white space, titles, snippets, paragraphs, slugs and type prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Artifact types that count as near each other.
NEAR_TYPES = (("Benchmark", "Metric"),)
#: What a claim's type may be called in a cluster key.
TYPE_TO_ARTIFACTS = {
    "benchmark": ("benchmark", "metric", "evaluation"),
    "metric": ("benchmark", "metric", "evaluation"),
    "dataset": ("dataset", "corpus", "data", "lexicon"),
    "corpus": ("dataset", "corpus", "data"),
    "lexicon": ("dataset", "corpus", "data", "lexicon"),
    "model": ("model", "tool", "system"),
    "method": ("method", "model", "algorithm"),
    "framework": ("framework", "system", "tool", "model"),
    "algorithm": ("algorithm", "method"),
    "system": ("system", "model", "tool", "framework"),
}

SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, EDGES, "")


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def first_given(*columns: Column) -> Column:
    """The first column that is neither NULL nor empty, else the empty string: falsy values are missing."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def split_words(c: Column) -> Column:
    """The words between white space; none for blank text."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def plain_words(c: Column) -> Column:
    """Lower-case words of ASCII letters and digits, everything else being space."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")


def normalised_title(c: Column) -> Column:
    """plain_words with a space between."""
    return F.array_join(plain_words(c), " ")


def match_key(c: Column, marker: str = "<CITED HERE>") -> Column:
    """A citation context without its marker and bracketed references, squeezed and in lower case."""
    return F.lower(squeezed(F.regexp_replace(F.replace(c, F.lit(marker), F.lit("")), r"\[[^\]]+\]", "")))


def title_leaked(description: Column, title: Column) -> Column:
    """Whether a word of more than four characters of the title stands in the description, as a substring and in any case."""
    long = F.filter(split_words(F.lower(title)), lambda w: F.length(w) > 4)
    return F.coalesce(F.exists(long, lambda w: F.contains(F.lower(description), w)), F.lit(False))


def snippet(tldr: Column, abstract: Column, mode: str = "tldr-or-abstract", most: int = 300) -> Column:
    """What is shown of a paper: nothing, its summary, its abstract, or the first of both that it has; cut at the last space
    within `most` characters and marked `...` if longer."""
    t, a = squeezed(F.coalesce(tldr, F.lit(""))), squeezed(F.coalesce(abstract, F.lit("")))
    text = {"none": F.lit(""), "tldr": t, "abstract": a, "tldr-or-abstract": first_given(t, a)}[mode]
    head = F.left(text, F.lit(most))
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("..."))).otherwise(text)


def opening(c: Column, n: int = 18) -> Column:
    """The first n words."""
    return F.array_join(F.slice(split_words(c), 1, n), " ")


def fallback_queries(claim: Column, basis: Column, n: int) -> Column:
    """Search queries where none were generated: the first n basis texts that say something, then the claim's opening, n in all.
    A NULL or empty basis stands for the claim's opening alone, which then comes twice."""
    start = opening(claim)
    texts = F.filter(F.slice(F.coalesce(basis, F.array().cast("array<string>")), 1, n), lambda x: F.coalesce(x, F.lit("")) != "")
    given = F.when(F.size(F.coalesce(basis, F.array().cast("array<string>"))) > 0, texts).otherwise(F.filter(F.array(start), lambda x: x != ""))
    return F.slice(F.concat(given, F.array(start)), 1, n)


def paragraphs(c: Column) -> Column:
    """The stretches between blank lines, stripped; none for blank text."""
    parts = F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n\s*\n"), stripped)
    return F.filter(parts, lambda p: p != "")


def slug(c: Column, most: int = 160, default: str = "run") -> Column:
    """Letters, digits, `-`, `_` and `.`; all else as single hyphens, none at the ends; at most so many characters."""
    s = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9\-_.]+", "-"), r"-+", "-")
    s = F.left(F.regexp_replace(s, r"^-+|-+$", ""), F.lit(most))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def model_slug(c: Column) -> Column:
    """A model's name as part of a file name."""
    return F.translate(c, "/:_.", "----")


def result_slug(stem: Column) -> Column:
    """The label of a prediction file, from its name without ending: known beginnings and the judge's part fall away."""
    s = F.regexp_replace(stem, "^predictions_final_capability_s1_", "")
    s = F.regexp_replace(s, "^predictions_final_", "")
    return model_slug(F.split_part(s, F.lit("__judge_"), F.lit(1)))


def claim_type(claim: Column) -> Column:
    """The single word before a colon that a claim begins with, capitalised; `Unknown` without one."""
    t = F.regexp_extract(claim, r"^([A-Za-z]+)\s*:", 1)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("Unknown")).otherwise(F.initcap(t))


def artifact_types(keys: Column) -> Column:
    """The second parts of cluster keys `relation|artifact|purpose`, in lower case; keys without one give none."""
    parts = F.transform(keys, lambda k: F.get(F.split(F.lower(k), r"\|"), F.lit(1)))
    return F.array_distinct(F.filter(parts, lambda p: p.isNotNull()))


def type_match(a: Column, b: Column) -> Column:
    """1 for the same type in any case, 0.5 for two near types, else 0."""
    x, y = F.initcap(F.trim(a)), F.initcap(F.trim(b))
    near = reduce(lambda p, q: p | q, (x.isin(*g) & y.isin(*g) for g in NEAR_TYPES))
    return F.when(x == y, 1.0).when(near, 0.5).otherwise(0.0)


def type_coverage(kind: Column, keys: Column) -> Column:
    """1 if the type is among the clusters' artifact types, 0.5 if another name for it is, else 0."""
    have, low = artifact_types(keys), F.lower(kind)
    names = F.create_map(*(x for k, v in TYPE_TO_ARTIFACTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    others = F.coalesce(F.try_element_at(names, low), F.array(low))
    return F.when(F.size(have) <= 0, 0.0).when(F.array_contains(have, low), 1.0).when(F.arrays_overlap(others, have), 0.5).otherwise(0.0)


def cluster_title(key: Column) -> Column:
    """A readable title of a key `relation|artifact|purpose`, underscores as spaces; the key itself if it has fewer parts."""
    part = lambda i: F.replace(F.trim(F.get(F.split(key, r"\|"), F.lit(i))), F.lit("_"), F.lit(" "))
    relation = F.when(F.upper(part(0)) == "USES", F.lit("Uses")).otherwise(F.lit("Extends"))
    return F.when(F.size(F.split(key, r"\|")) >= 3, F.trim(F.concat(relation, F.lit(" "), part(1), F.lit(" for "), part(2)))).otherwise(F.coalesce(key, F.lit("")))


def last_names(names: Column) -> Column:
    """The last words of author names, each once, in order; NULL and blank names give none."""
    last = F.transform(F.filter(names, lambda n: F.coalesce(stripped(n), F.lit("")) != ""), lambda n: F.element_at(F.split(stripped(n), SPACE), -1))
    return F.coalesce(F.array_distinct(last), F.array().cast("array<string>"))


def title_aliases(title: Column) -> Column:
    """What a paper may be called: its title, the part before a colon, and the acronym of its capitals if it has 3 to 10; each once."""
    acronym = F.regexp_replace(title, r"[^\p{Lu}]", "")
    names = F.array(
        title,
        F.when(F.contains(title, F.lit(":")), F.split_part(title, F.lit(":"), F.lit(1))),
        F.when(F.length(acronym).between(3, 10), acronym),
    )
    return F.array_distinct(F.filter(names, lambda a: F.coalesce(a, F.lit("")) != ""))


def loose_pattern(alias: Column) -> Column:
    """A pattern that finds the alias as a word whatever hyphens and spaces stand between its parts; NULL if it has no letter or digit."""
    parts = F.filter(F.split(alias, "[^A-Za-z0-9]+"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.concat(F.lit(r"(?i)\b"), F.array_join(parts, r"[-\s]*"), F.lit(r"\b")))


def arxiv_id_in(c: Column) -> Column:
    """The first arXiv id in a text, with its version; NULL without one. Ids of the kind 0000.00000 are understood."""
    return F.nullif(F.regexp_extract(c, r"(\d{4}\.\d{4,5}(?:v\d+)?)", 1), F.lit(""))


def parsed_arxiv_id(c: Column) -> Column:
    """The bare arXiv id of an id or address, without `.pdf` and version; NULL if it is none."""
    s = F.trim(c)
    s = F.coalesce(F.nullif(F.regexp_extract(s, r"arxiv\.org/(?:abs|pdf)/([^?#\s]+)", 1), F.lit("")), s)
    s = F.regexp_replace(F.regexp_replace(s, r"\.pdf$", ""), r"v\d+$", "")
    return F.when(s.rlike(r"^(?:\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})$"), s)


def selector(c: Column) -> Column:
    """The (paper_id, claim_idx) of a selector `paper` or `paper:index`; claim_idx is NULL without an index."""
    indexed = c.rlike(r"^.+:\d+$")
    return F.struct(F.when(indexed, F.regexp_extract(c, r"^(.*):\d+$", 1)).otherwise(c).alias("paper_id"), F.when(indexed, F.regexp_extract(c, r":(\d+)$", 1).cast("int")).alias("claim_idx"))
