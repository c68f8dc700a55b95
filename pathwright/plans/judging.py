"""Generation and judging: contexts of a setting, prompts, parsed answers, matching and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathwright.functions.jsonx import parsed_list
from pathwright.operators import groundings, matching, metrics

PREDICTED = "struct<description: string, role: string, rationale: string, ref_title: string>"
EDGE = "struct<reference_idx: int, predicted_idx: int, gold_idx: int, pred_idx: int, match: string, reasoning: string>"


def generation_prompts(tasks: DataFrame) -> DataFrame:
    """tasks with setting and prompt: with related work (3), with references (2), or the claim alone (1); examples come first.
    tasks: (…, claim, related_work, references array of (title, contexts), few_shots array of texts)."""
    refs = F.array_join(F.transform("references", lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["title"], F.coalesce(F.concat(F.lit(": "), F.left(F.get(r["contexts"], F.lit(0)), F.lit(200))), F.lit("")))), "\n")
    shots = F.array_join(F.coalesce("few_shots", F.array().cast("array<string>")), "\n\n")
    setting = F.when(F.col("related_work").isNotNull(), 3).when(F.size("references") > 0, 2).otherwise(1)
    ask = "List the earlier contributions without which this claim could not stand. Answer with JSON {\"ingredients\": [{\"description\", \"role\", \"rationale\", \"ref_title\"}]}."
    more = F.when(setting == 3, F.concat(F.lit("\n\nRelated work:\n"), "related_work")).when(setting == 2, F.concat(F.lit("\n\nReferences:\n"), refs)).otherwise("")
    prompt = F.concat(F.when(shots != "", F.concat(shots, F.lit("\n\n"))).otherwise(""), F.lit("Claim:\n"), F.coalesce("claim", F.lit("")), more, F.lit("\n\n" + ask))
    return tasks.withColumn("setting", setting).withColumn("prompt", prompt)


def parsed_predictions(rows: DataFrame, response: str = "response") -> DataFrame:
    """rows with predicted_ingredients, n_predicted and error, of a model's answer: ingredients that say something; an answer that does not parse
    is an error."""
    p = parsed_list(F.col(response), "ingredients", PREDICTED)
    r = rows.withColumn("predicted_ingredients", groundings.clean_ingredients(p))
    parse = F.when(F.col("predicted_ingredients").isNull(), F.lit("no ingredients in the answer"))
    error = F.coalesce(F.nullif(F.col("error"), F.lit("")), parse) if "error" in rows.columns else parse
    return r.withColumn("error", error).withColumn("n_predicted", F.greatest(F.coalesce(F.size("predicted_ingredients"), F.lit(0)), F.lit(0)))


def judge_prompts(tasks: DataFrame) -> DataFrame:
    """tasks (…, gold_ingredients, predicted_ingredients) with the prompt of the matching judge."""
    gold, pred = groundings.formatted(F.col("gold_ingredients"), "enabling_contribution"), groundings.formatted(F.col("predicted_ingredients"), "description")
    ask = 'For every pair that names the same contribution answer full or partial: JSON {"matches": [{"reference_idx", "predicted_idx", "match", "reasoning"}]}.'
    return tasks.withColumn("prompt", F.concat(F.lit("Reference contributions:\n"), gold, F.lit("\n\nPredicted contributions:\n"), pred, F.lit("\n\n" + ask)))


def parsed_edges(rows: DataFrame, key: tuple[str, ...] = ("paper_id", "claim_idx"), response: str = "response") -> DataFrame:
    """(key, n_reference, n_predicted, reference_idx, predicted_idx, match, reasoning) of the judge's answers; older index names are understood, and
    an index that is no integer leaves its edge out later."""
    e = rows.select(*key, "n_reference", "n_predicted", F.explode(parsed_list(F.col(response), "matches", EDGE)).alias("_e"))
    return e.select(*key, "n_reference", "n_predicted", F.coalesce("_e.reference_idx", "_e.gold_idx").alias("reference_idx"), F.coalesce("_e.predicted_idx", "_e.pred_idx").alias("predicted_idx"), F.lower("_e.match").alias("match"), "_e.reasoning")


def judge(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Judged rows with recall, precision and f1. claims: (paper_id, claim_idx, n_reference, n_predicted); claims without references are left out."""
    return metrics.matching_metrics(matching.judged(claims.where("n_reference > 0"), edges.select("paper_id", "claim_idx", "reference_idx", "predicted_idx", "match")))


def reference_judgments(claims: DataFrame, matched: DataFrame) -> DataFrame:
    """(paper_id, claim_idx, reference_idx, reference_ingredient, covered, best_match_idx): one row per reference. claims: (…, gold_ingredients);
    matched: (paper_id, claim_idx, matched array)."""
    r = claims.select("paper_id", "claim_idx", F.posexplode("gold_ingredients").alias("_p", "_i")).select("paper_id", "claim_idx", (F.col("_p") + 1).alias("reference_idx"), F.col("_i.enabling_contribution").alias("reference_ingredient"))
    m = matched.select("paper_id", "claim_idx", F.explode("matched").alias("_m")).select("paper_id", "claim_idx", "_m.reference_idx", F.col("_m.predicted_idx").alias("best_match_idx"))
    return r.join(m, ["paper_id", "claim_idx", "reference_idx"], "left").withColumn("covered", F.col("best_match_idx").isNotNull())


def matched_predictions(predicted: Column, pairs: Column, judgments: Column) -> Column:
    """Predicted ingredients with a full match, by the 1-based pairs (predicted_idx, match), else by covered judgments (best_match_idx)."""
    full = F.transform(F.filter(pairs, lambda p: F.lower(p["match"]) == "full"), lambda p: p["predicted_idx"] - 1)
    covered = F.transform(F.filter(judgments, lambda j: j["covered"]), lambda j: j["best_match_idx"] - 1)
    at = F.when(F.size(full) > 0, full).otherwise(F.coalesce(covered, F.array().cast("array<int>")))
    return F.filter(predicted, lambda _, i: F.array_contains(at, i))


def gates(rows: DataFrame, *errors: str) -> None:
    """Raises if a column of errors is set in some row: a stage that failed ends the run."""
    bad = rows.agg(*(F.count_if(F.coalesce(F.col(e).cast("string"), F.lit("")) != "").alias(e) for e in errors)).first().asDict()
    bad = {k: v for k, v in bad.items() if v}
    if bad:
        raise RuntimeError(f"stage failed: {bad}")
