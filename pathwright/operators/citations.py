"""Citation contexts: extraction, numbering, marking, counting, labelling and verification."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathwright.functions.text import first_given, last_names, loose_pattern, stripped, title_aliases

MARKER = "<CITED HERE>"
#: Labels in order of priority, and those that make a use.
PRIORITY = ("Extends", "Uses", "CompareOrContrast")
USES = ("Uses", "Extends")
_GROUP = r"\[([0-9,;\s]+)\]"


def contexts_of(with_intent: Column, plain: Column) -> Column:
    """The contexts of a citation as structs (text, intents): those with intents if there are any, blank ones too, marked text before plain;
    else the non-blank plain ones, without intents."""
    none = F.array().cast("array<string>")
    new = F.transform(with_intent, lambda x: F.struct(first_given(stripped(x["context_with_marker"]), stripped(x["context"])).alias("text"), F.coalesce(x["intents"], none).alias("intents")))
    old = F.transform(F.filter(plain, lambda x: F.coalesce(stripped(x), F.lit("")) != ""), lambda x: F.struct(stripped(x).alias("text"), none.alias("intents")))
    return F.coalesce(F.when(F.size(with_intent) > 0, new), old, F.array().cast("array<struct<text:string,intents:array<string>>>"))


def usage_counters(citations: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """Per paper: citations, contexts, citing papers with and without contexts, influential citations, and those with contexts.

    citations: (key, is_influential, contexts array)."""
    has, inf = F.size("contexts") > 0, F.coalesce("is_influential", F.lit(False))
    return citations.groupBy(*key).agg(
        F.count("*").alias("total_citations"), F.sum(F.greatest(F.size("contexts"), F.lit(0))).alias("num_contexts"), F.count_if(has).alias("num_citing_with_context"),
        (F.count("*") - F.count_if(has)).alias("num_citing_without_context"), F.count_if(inf).alias("num_influential_citations"), F.count_if(inf & has).alias("num_influential_with_context"),
    )


def numbered_contexts(citations: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """(key, id, citing_paper_id, citing_title, text): the non-blank contexts of a paper, numbered from 1 by citation and place.

    citations: (key, ord, citing_paper_id, citing_title, contexts array of (text, intents)). The number of contexts per citation gives each
    citation its first number by a running sum, so that only one row per citation is sorted."""
    c = citations.withColumn("_c", F.filter("contexts", lambda x: F.coalesce(stripped(x["text"]), F.lit("")) != ""))
    w = Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_from", F.coalesce(F.sum(F.size("_c")).over(w), F.lit(0)))
    return c.select(*key, "_from", F.coalesce("citing_paper_id", F.lit("")).alias("citing_paper_id"), first_given(F.col("citing_title"), F.lit("Unknown citing paper")).alias("citing_title"), F.posexplode("_c").alias("_p", "_x")).select(
        *key, (F.col("_from") + F.col("_p") + 1).cast("int").alias("id"), "citing_paper_id", "citing_title", stripped(F.col("_x.text")).alias("text")
    )


def bracket_numbers(text: Column) -> Column:
    """All numbers in numeric brackets of a text, in order."""
    return F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_GROUP), 1), lambda g: F.split(g, r"[,\s;]+"))), lambda n: n.rlike("^[0-9]+$"))


def _sole_mode(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, value) of the commonest value of each key; keys whose commonest values tie give no row."""
    n = rows.groupBy(*key, value).agg(F.count("*").alias("_n")).groupBy(*key, "_n").agg(F.count("*").alias("_ties"), F.min(value).alias(value))
    best = n.groupBy(*key).agg(F.max_by(F.struct("_ties", value), "_n").alias("_b"))
    return best.where("_b._ties = 1").select(*key, F.col(f"_b.{value}").alias(value))


def dominant_brackets(contexts: DataFrame, key: Sequence[str] = ("paper_id", "citing_paper_id")) -> DataFrame:
    """(key, number): the number that stands for the target in a citing paper's brackets: the commonest of all, if it alone is the commonest;
    else the commonest among contexts with one bracket of one number, under the same condition. Others give no row."""
    n = contexts.select(*key, bracket_numbers(F.col("text")).alias("_n"), F.size(F.regexp_extract_all("text", F.lit(_GROUP), 1)).alias("_g"))
    every = _sole_mode(n.select(*key, F.explode("_n").alias("number")), key, "number")
    single = _sole_mode(n.where((F.col("_g") == 1) & (F.size("_n") == 1)).select(*key, F.get("_n", F.lit(0)).alias("number")), key, "number")
    return every.unionByName(single.join(every.select(*key), list(key), "left_anti"))


def collapsed(text: Column) -> Column:
    """Neighbouring markers as one, without white space at the ends."""
    s = F.regexp_replace(text, r"(?:<CITED HERE>[\s()\[\],;:]*){2,}", f"{MARKER} ")
    return stripped(F.regexp_replace(s, r"<CITED HERE>(?:\s+<CITED HERE>)+", MARKER))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def marked(text: Column, surname: Column, year: Column, title: Column, number: Column) -> Column:
    """struct(text, changed): a context with the target's citation as the marker.

    In turn: the author's name with what follows it, if it stands there once; brackets that hold the target's number; `Name et al. year`;
    unless the first step hit, the title and what it may be called for short; a single bracket of one number, the target's if that is known.
    Patterns are columns built per row, and each step's text is computed once; all runs inside the JVM."""
    never = F.lit(r"(?!)")
    name = F.when(F.length(surname) > 0, F.concat(F.lit(r"(?i)\b"), _quoted(surname), F.lit(r"\b")))
    span = F.when(F.length(surname) > 0, F.concat(F.lit(r"(?i)\(?\b"), _quoted(surname), F.lit(r"\b\s+(?:et\s+al\.?|and|&)\s*(?:,?\s*\(?[0-9]{4}[a-z]?\)?)?\)?")))
    alone = F.coalesce(F.regexp_count(text, F.coalesce(name, never)) == 1, F.lit(False))
    hit = alone & (F.regexp_count(text, F.coalesce(span, never)) > 0)
    holds = F.when(F.length(number) > 0, F.concat(F.lit(r"\[(?:[0-9,;\s]*[,;\s])?"), number, F.lit(r"(?:[,;\s][0-9,;\s]*)?\]")))
    dated = F.when((F.length(surname) > 0) & year.isNotNull(), F.concat(F.lit(r"(?i)\b"), _quoted(surname), F.lit(r"\s+et\s+al\.?\s*(?:,\s*|\s*)"), year.cast("string"), F.lit("[a-z]?")))
    names = F.coalesce(F.filter(F.transform(title_aliases(title), loose_pattern), lambda p: p.isNotNull()), F.array().cast("array<string>"))

    def then(s: Column, pattern: Column) -> Column:
        return F.when(F.regexp_count(s, F.coalesce(pattern, never)) > 0, collapsed(F.regexp_replace(s, F.coalesce(pattern, never), F.lit(MARKER)))).otherwise(s)

    def bracket(s: Column) -> Column:
        numbers = bracket_numbers(s)
        one = (F.regexp_count(s, F.lit(_GROUP)) == 1) & (F.size(numbers) == 1) & (number.isNull() | (F.get(numbers, F.lit(0)) == number))
        return collapsed(F.when(one, F.regexp_replace(s, _GROUP, MARKER)).otherwise(s))

    s = F.when(hit, collapsed(F.regexp_replace(text, F.coalesce(span, never), F.lit(MARKER)))).otherwise(text)
    s = _once(s, lambda x: then(x, holds))
    s = _once(s, lambda x: then(x, dated))
    s = F.when(hit, s).otherwise(F.reduce(names, s, then))
    s = _once(s, bracket)
    return _once(s, lambda x: F.struct(x.alias("text"), (x != collapsed(text)).alias("changed")))


def mark_contexts(contexts: DataFrame, papers: DataFrame) -> DataFrame:
    """contexts (paper_id, citing_paper_id, id, text) with context_with_marker and changed. papers: (paper_id, title, year, author_names)."""
    p = papers.select("paper_id", F.col("title").alias("_title"), F.col("year").alias("_year"), F.get(last_names(F.col("author_names")), F.lit(0)).alias("_surname"))
    j = contexts.join(p, "paper_id", "left").join(dominant_brackets(contexts), ["paper_id", "citing_paper_id"], "left")
    m = marked(F.col("text"), F.coalesce("_surname", F.lit("")), F.col("_year"), F.coalesce("_title", F.lit("")), F.col("number"))
    return j.withColumn("_m", m).select(*contexts.columns, F.col("_m.text").alias("context_with_marker"), F.col("_m.changed").alias("changed"))


def _prior(labels: Column) -> Column:
    out = F.lit("Background")
    for name in reversed(PRIORITY):
        out = F.when(F.array_contains(labels, name), F.lit(name)).otherwise(out)
    return out


def citing_labels(labels: DataFrame, key: Sequence[str] = ("paper_id", "citing_paper_id")) -> DataFrame:
    """(key, citing_title, label, evidence_context_ids): the label of highest priority among a citing paper's contexts, with the contexts that have
    it; Background without one of priority, and then no evidence. labels: (key, id, label, citing_title)."""
    rows = labels.withColumn(key[-1], F.coalesce(key[-1], F.lit("")))
    hit = {name: F.array_sort(F.collect_set(F.when(F.col("label") == name, F.col("id")))) for name in PRIORITY}
    g = rows.groupBy(*key).agg(F.min_by("citing_title", "id").alias("citing_title"), F.collect_set("label").alias("_l"), *(c.alias(f"_{n}") for n, c in hit.items()))
    g = g.withColumn("label", _prior(F.col("_l")))
    evidence = F.array().cast(dict(g.dtypes)["_Uses"])
    for name in PRIORITY:
        evidence = F.when(F.col("label") == name, F.col(f"_{name}")).otherwise(evidence)
    return g.select(*key, "citing_title", "label", evidence.alias("evidence_context_ids"))


def final_labels(citing: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """(key, final_label) over the citing papers' labels."""
    return citing.groupBy(*key).agg(_prior(F.collect_set("label")).alias("final_label"))


def with_default_label(contexts: DataFrame, labels: DataFrame, key: Sequence[str] = ("paper_id", "id")) -> DataFrame:
    """contexts with label and confidence; Background and 0 where the classifier gave none. Labels are compared in their usual spelling."""
    names = {n.lower(): n for n in (*PRIORITY, "Background", "Motivation", "Future")}
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    l = labels.select(*key, F.coalesce(F.try_element_at(known, F.lower("label")), "label").alias("label"), "confidence")  # noqa: E741
    return contexts.join(l, list(key), "left").fillna({"label": "Background", "confidence": 0.0})


def softmax(scores: Column) -> Column:
    """Class scores as probabilities; the greatest is subtracted first, so that no score is too large. NULL and empty lists stay as they are."""
    e = F.transform(scores, lambda v: F.exp(v.cast("double") - F.array_max(scores).cast("double")))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def confidence_margin(probabilities: Column) -> Column:
    """struct(confidence, margin): the greatest of the class probabilities, and how far it is above the next."""
    p = F.sort_array(probabilities, asc=False)
    top, nxt = F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))
    return F.struct(top.alias("confidence"), (top - nxt).alias("margin"))


def verified(candidates: DataFrame, answers: DataFrame, key: Sequence[str] = ("paper_id", "id")) -> DataFrame:
    """candidates with label, cue_span and rationale of the model's last answer about each; NOT_CONFIRMED where there is no answer, no cue span,
    or no label. answers: (key, ord, label, cue_span, rationale)."""
    a = answers.groupBy(*key).agg(F.max_by(F.struct("label", "cue_span", "rationale"), "ord").alias("_a"))
    j = candidates.withColumnRenamed("label", "original_label").join(a, list(key), "left")
    cue = F.coalesce(F.col("_a.cue_span"), F.lit(""))
    label = F.when(cue == "", F.lit("NOT_CONFIRMED")).otherwise(F.coalesce(F.col("_a.label"), F.lit("NOT_CONFIRMED")))
    return j.select("*", label.alias("label"), cue.alias("cue_span"), F.coalesce(F.col("_a.rationale"), F.lit("")).alias("rationale")).drop("_a")


def verified_summary(rows: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """Per paper: candidates considered, confirmed ones of either kind, and the final label EXTENDS, USES or NOT_CONFIRMED."""
    ext, use = F.count_if(F.col("label") == "EXTENDS"), F.count_if(F.col("label") == "USES")
    return rows.groupBy(*key).agg(
        F.count("*").alias("candidates_considered"), (ext + use).alias("candidates_selected"), ext.alias("confirmed_extends"), use.alias("confirmed_uses"),
        F.when(ext > 0, "EXTENDS").when(use > 0, "USES").otherwise("NOT_CONFIRMED").alias("final_label"),
    )


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))
