"""Ingredients, their groundings, and the tasks made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathwright.functions.ids import valid_graph_id
from pathwright.functions.text import first_given, title_leaked

#: What a model writes where it has nothing to say.
PLACEHOLDERS = ("", "...", "…", "null", "none", "n/a")


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*PLACEHOLDERS)


def clean_ingredients(ingredients: Column) -> Column:
    """Predicted ingredients of which description, role and rationale say something."""
    return F.filter(ingredients, lambda i: ~(is_placeholder(i["description"]) | is_placeholder(i["role"]) | is_placeholder(i["rationale"])))


def all_clean(ingredients: Column) -> Column:
    """Whether there are ingredients and all of them say something."""
    return F.coalesce((F.size(ingredients) > 0) & (F.size(clean_ingredients(ingredients)) == F.size(ingredients)), F.lit(False))


def grounding_ids(ingredient: Column) -> Column:
    """The valid paper ids of an ingredient's groundings, the canonical one first, each once."""
    extra = F.coalesce(F.transform(ingredient["additional_groundings"], lambda g: g["paper_id"]), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(ingredient["canonical_grounding"]["paper_id"]), extra), valid_graph_id))


def canonical_id(ingredient: Column) -> Column:
    """The canonical grounding's paper id if it is valid."""
    c = ingredient["canonical_grounding"]["paper_id"]
    return F.when(valid_graph_id(c), c)


def role_text(ingredient: Column) -> Column:
    """An ingredient's roles with commas; empty without any."""
    return F.coalesce(F.array_join(ingredient["roles"], ", "), F.lit(""))


def ingredient_tasks(claims: DataFrame) -> DataFrame:
    """One row per gold ingredient with a valid grounding: (paper_id, claim_idx, ingredient_idx from 1, ingredient, canonical_id, target_ids,
    ref_title, role, leaked). leaked: a long word of the grounding's title stands in the ingredient's text. Claims without ingredients give no rows."""
    i = claims.select("paper_id", "claim_idx", F.posexplode("gold_ingredients").alias("_p", "_i"))
    i = i.select("paper_id", "claim_idx", (F.col("_p") + 1).alias("ingredient_idx"), "_i", grounding_ids(F.col("_i")).alias("target_ids"))
    text, title = first_given(F.col("_i.enabling_contribution")), first_given(F.col("_i.canonical_grounding.ref_title"))
    return i.where(F.size("target_ids") > 0).select(
        "paper_id", "claim_idx", "ingredient_idx", text.alias("ingredient"), canonical_id(F.col("_i")).alias("canonical_id"), "target_ids",
        title.alias("ref_title"), role_text(F.col("_i")).alias("role"), title_leaked(text, title).alias("leaked"),
    )


def predicted_tasks(predictions: DataFrame, matched: DataFrame, ingredients: DataFrame, setting: int = 1) -> DataFrame:
    """One row per predicted ingredient that a full match ties to gold ones: (paper_id, claim_idx, predicted_idx, ingredient, covered
    reference indices, target_ids in their order, leaked). Leakage is looked for in setting 2 only, where titles were shown.

    predictions: (paper_id, claim_idx, predicted_ingredients); matched: (paper_id, claim_idx, reference_idx, predicted_idx);
    ingredients: the rows of ingredient_tasks()."""
    p = predictions.select("paper_id", "claim_idx", F.posexplode("predicted_ingredients").alias("_p", "_i")).select("paper_id", "claim_idx", (F.col("_p") + 1).alias("predicted_idx"), F.col("_i.description").alias("ingredient"))
    g = ingredients.select("paper_id", "claim_idx", F.col("ingredient_idx").alias("reference_idx"), "target_ids", "ref_title")
    m = matched.join(g, ["paper_id", "claim_idx", "reference_idx"]).groupBy("paper_id", "claim_idx", "predicted_idx").agg(F.array_sort(F.collect_list(F.struct("reference_idx", "target_ids", "ref_title"))).alias("_m"))
    j = p.join(m, ["paper_id", "claim_idx", "predicted_idx"])
    leaked = F.exists("_m", lambda x: title_leaked(F.col("ingredient"), x["ref_title"])) if setting == 2 else F.lit(False)
    return j.select(
        "paper_id", "claim_idx", "predicted_idx", "ingredient", F.transform("_m", lambda x: x["reference_idx"]).alias("covered"),
        F.array_distinct(F.flatten(F.transform("_m", lambda x: x["target_ids"]))).alias("target_ids"), leaked.alias("leaked"),
    )


def formatted(ingredients: Column, text: str, role: Column | None = None) -> Column:
    """A numbered list of ingredients for a prompt, with role and rationale lines where there are any."""

    def line(x: Column, i: Column) -> Column:
        part = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"\n   {label}: "), v)).otherwise("")
        roles = role_text(x) if role is None and text == "enabling_contribution" else x["role"]
        out = F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x[text], F.lit("")), part("Role", roles))
        return out if text == "enabling_contribution" else F.concat(out, part("Rationale", x["rationale"]))

    lines = F.array_join(F.transform(ingredients, line), "\n")
    return F.coalesce(F.nullif(lines, F.lit("")), F.lit("(No enabling contributions provided.)"))


def evidence(mode: Column, claim: Column, gold: Column, predicted: Column) -> Column:
    """What a mode shows: the claim alone (B1), gold ingredients (B3), predicted ones (B4) or matched predicted ones (B4_MATCHED)."""
    head = F.concat(F.lit("Claim:\n"), F.coalesce(claim, F.lit("")), F.lit("\n\n"))
    return (
        F.when(mode == "B1", F.concat(head, F.lit("Nothing else is known; infer what the claim builds on.")))
        .when(mode == "B3", F.concat(head, F.lit("Known contributions:\n"), formatted(gold, "enabling_contribution")))
        .when(mode.isin("B4", "B4_MATCHED"), F.concat(head, F.when(mode == "B4", "Predicted contributions:\n").otherwise("Matched predicted contributions:\n"), formatted(predicted, "description")))
    )
