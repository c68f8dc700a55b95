"""Two-pass annotation: candidates, a judge, a formatter; assembly of what a prompt shows; checks of payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathwright.functions.jsonx import parsed
from pathwright.functions.text import split_words

#: The roles, artifact types and decisions there are.
ROLES = ("CORE_METHOD", "CONCEPTUAL_FRAMEWORK", "DATA_SOURCE", "TRAINING_DATA", "MODEL_INITIALIZATION", "EVALUATION_PROTOCOL", "IMPLEMENTATION_TOOLING")
ARTIFACTS = ("Resource", "Finding", "Method", "Benchmark", "Dataset", "Tool", "Other")
DECISIONS = ("YES_SUFFICIENT", "NO_NOT_DISCOVERY", "UNCERTAIN")
NO_REF = "__NONE__"


def prompt_packages(papers: DataFrame, sections: DataFrame, texts: DataFrame, bibliography: DataFrame, contexts: DataFrame, clusters: DataFrame, section_chars: int = 12_000, text_chars: int = 24_000, refs: int = 80, most_contexts: int = 60) -> DataFrame:
    """One row per paper with what its prompt shows: sections (or the text, if it has none), references, contexts and cluster evidence, each within
    its bound, in order. Inputs: papers (paper_id, …), sections (paper_id, name, text), texts (paper_id, text), bibliography, contexts and clusters
    (paper_id, ord, …)."""

    def listed(rows: DataFrame, most: int, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c != "paper_id"]
        w = Window.partitionBy("paper_id").orderBy("ord")
        r = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
        return r.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("_r", *fields))).alias(name))

    s = sections.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.left("text", F.lit(section_chars)).alias("text"))))).alias("sections"))
    out = papers.join(s, "paper_id", "left").join(texts.select("paper_id", F.left("text", F.lit(text_chars)).alias("_text")), "paper_id", "left")
    for rows, most, name in ((bibliography, refs, "bibliography"), (contexts, most_contexts, "citation_contexts"), (clusters, 2**31 - 1, "cluster_evidence")):
        out = out.join(listed(rows, most, name), "paper_id", "left")
    return out.withColumn("full_text", F.when(F.col("sections").isNull(), F.col("_text"))).drop("_text")


def attempts(prompts: DataFrame, n: int) -> DataFrame:
    """prompts times their candidate numbers 1..n."""
    return prompts.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(max(1, n)))))


def chosen(candidates: DataFrame, judgments: DataFrame) -> DataFrame:
    """(paper_id, candidate, response): the candidate the judge chose, kept within the candidates there are; the first without a judgment or with one
    that does not parse. candidates: (paper_id, candidate, response); judgments: (paper_id, response) with {"selected_index": from 0}."""
    j = judgments.select("paper_id", parsed(F.col("response"), "struct<selected_index: int>")["selected_index"].alias("_i"))
    n = candidates.groupBy("paper_id").agg(F.count("*").alias("_n")).join(j, "paper_id", "left")
    want = n.select("paper_id", F.greatest(F.lit(1), F.least(F.col("_n"), F.coalesce(F.col("_i") + 1, F.lit(1)))).cast("int").alias("candidate"))
    return candidates.join(want, ["paper_id", "candidate"])


def judge_violations(judgments: DataFrame) -> DataFrame:
    """(paper_id, rule) of judge answers that break their rules: scores from 1 to 10, the chosen candidate has the greatest score, index and id agree.
    judgments: (paper_id, selected_index from 0, selected_candidate_id, scores array of (candidate_id, score))."""
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    own = F.get("scores", F.col("selected_index"))
    rules = F.array(
        F.when(F.exists("scores", lambda s: ~s["score"].between(1, 10)), F.lit("score out of 1..10")),
        F.when(F.coalesce(own["score"] < top, F.lit(True)), F.lit("chosen candidate is not the best scored")),
        F.when(F.coalesce(own["candidate_id"] != F.col("selected_candidate_id"), F.lit(True)), F.lit("index and id disagree")),
    )
    return judgments.select("paper_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def payload_violations(payloads: DataFrame) -> DataFrame:
    """(target_paper_id, claim_id, ingredient_id, rule) of payloads that break their invariants; ingredient_id is NULL for a claim's rule."""
    c = payloads.select("target_paper_id", F.explode("claims").alias("c"))
    claim_rules = F.array(
        F.when(~F.col("c.text").eqNullSafe(F.col("c.rewritten_claim")), F.lit("text differs from rewritten_claim")),
        F.when(F.col("c.decision").isNotNull() & ~F.col("c.decision").isin(*DECISIONS), F.lit("unknown decision")),
    )
    of_claims = c.select("target_paper_id", F.col("c.claim_id").alias("claim_id"), F.lit(None).cast("string").alias("ingredient_id"), F.explode(F.filter(claim_rules, lambda r: r.isNotNull())).alias("rule"))
    i = c.select("target_paper_id", "c.claim_id", F.col("c.enabling_discoveries").alias("_d"), F.explode("c.ingredients").alias("i"))
    none = F.col("i.canonical_ref_id") == NO_REF
    roles = F.coalesce("i.canonical_annotation.roles", F.array().cast("array<string>"))
    listed = F.transform("i.additional_groundings", lambda g: g["ref_id"])
    has = F.exists(F.coalesce("_d", F.array().cast(dict(i.dtypes)["_d"])), lambda d: d["ingredient_id"] == F.col("i.ingredient_id"))
    rules = F.array(
        F.when(none & F.col("i.canonical_grounding").isNotNull(), F.lit("grounding without a reference")),
        F.when(none & has, F.lit("discovery without a reference")),
        F.when((F.size(roles) == 1) & ~F.col("i.canonical_annotation.role").eqNullSafe(F.get(roles, F.lit(0))), F.lit("role differs from the one of roles")),
        F.when((F.size(roles) > 1) & F.col("i.canonical_annotation.role").isNotNull(), F.lit("role set beside several roles")),
        F.when(F.exists(roles, lambda r: ~r.isin(*ROLES)), F.lit("unknown role")),
        F.when(~F.coalesce("i.additional_ref_ids", F.array().cast("array<string>")).eqNullSafe(F.coalesce(listed, F.array().cast("array<string>"))), F.lit("additional_ref_ids differ from the groundings")),
    )
    of_ingredients = i.select("target_paper_id", "claim_id", F.col("i.ingredient_id").alias("ingredient_id"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    return of_claims.unionByName(of_ingredients)


def quote_holds(span: Column, text: Column, least: int = 5, most: int = 25) -> Column:
    """Whether an evidence quote has 5 to 25 words and stands in the text letter for letter."""
    return F.size(split_words(span)).between(least, most) & F.coalesce(F.contains(text, span), F.lit(False))
