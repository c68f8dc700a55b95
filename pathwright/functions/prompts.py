"""Prompts as columns, in our own words. Templates are literals, so that a prompt is one expression of the plan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

JSON_ONLY = "Answer with JSON only, without a code fence."

GROUNDS = (
    "A paper grounds a contribution if it introduced, released or established what the claim builds on: a method, a data set, a tool, a finding or a way to evaluate. "
    "A paper that only treats the same subject does not."
)


def lines(items: Column) -> Column:
    """A list of texts as numbered lines from 1."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x, F.lit("")))), "\n")


def queries(evidence: Column, n: int) -> Column:
    """Asks for n search queries for the papers that ground a claim."""
    return F.concat(F.lit(f"{GROUNDS}\n\n"), evidence, F.lit(f'\n\nWrite {n} short search queries, each for another grounding paper. {JSON_ONLY} {{"queries": ["…"]}}'))


def scores(evidence: Column, rule: Column, candidates: Column) -> Column:
    """Asks for a score from 0 to 5 for each candidate of a batch. candidates: an array of structs (paper_id, title, year, deterministic_score, best_rank,
    frequency, snippet); an empty snippet is not shown."""
    shown = F.transform(
        candidates,
        lambda c: F.struct(c["paper_id"].alias("paper_id"), F.coalesce(c["title"], F.lit("")).alias("title"), c["year"].alias("year"), c["deterministic_score"].alias("deterministic_score"), c["best_rank"].alias("best_rank"), c["frequency"].alias("frequency"), F.nullif(c["snippet"], F.lit("")).alias("snippet")),
    )
    return F.concat(F.lit(f"{GROUNDS}\n\n"), evidence, F.lit("\n\n"), rule, F.lit("\n\nCandidates:\n"), F.to_json(shown), F.lit(f'\n\nScore every candidate from 0 (no ground) to 5 (surely one). {JSON_ONLY} {{"scores": [{{"paper_id", "score", "grounds", "reason"}}]}}'))


def coverage_rule(mode: Column) -> Column:
    """What a good selection is, by mode."""
    return F.when(mode == "B1", F.lit("Think of what the claim must build on, and prefer papers that cover all of it together.")).otherwise(
        F.lit("Prefer papers that cover many of the listed contributions together, not several papers for one.")
    )


def repair(answer: Column, shape: str) -> Column:
    """Asks for a broken answer as the JSON it should have been."""
    return F.concat(F.lit(f"Turn this answer into valid JSON of the shape {shape}. Change nothing in what it says. {JSON_ONLY}\n\n"), F.coalesce(answer, F.lit("")))


def verification(title: Column, authors: Column, year: Column, contexts: Column) -> Column:
    """Asks which contexts use or extend the target. contexts: an array of structs (id, text)."""
    shown = F.array_join(F.transform(contexts, lambda c: F.concat(F.lit("id "), c["id"].cast("string"), F.lit(": "), c["text"])), "\n")
    target = F.concat_ws(", ", title, authors, year.cast("string"))
    ask = 'For each context say whether its authors USE the target in their own work, EXTEND it, or neither (NOT_CONFIRMED), and copy the words that show it. {"labels": [{"id", "label", "cue_span", "rationale"}]}'
    return F.concat(F.lit("Target paper: "), target, F.lit("\n\nContexts, the target marked <CITED HERE>:\n"), shown, F.lit(f"\n\n{ask} {JSON_ONLY}"))


def contribution(title: Column, citing_title: Column, contexts: Column) -> Column:
    """Asks what a citing paper takes from the target. contexts: an array of texts."""
    ask = 'Say in one sentence what the citing paper takes from the target, with a key RELATION|artifact|purpose, RELATION being USES or EXTENDS, and quote the evidence. {"label", "paper_claim", "cluster_title", "cluster_key", "evidence_span", "rationale"}'
    return F.concat(F.lit("Target: "), F.coalesce(title, F.lit("")), F.lit("\nCiting paper: "), F.coalesce(citing_title, F.lit("")), F.lit("\n\n"), lines(contexts), F.lit(f"\n\n{ask} {JSON_ONLY}"))


def refinement(title: Column, clusters: Column) -> Column:
    """Asks which clusters to merge and which to drop. clusters: an array of structs."""
    ask = 'Merge clusters that say the same of the target, never ones of different relation; drop those that say nothing of it. {"kept_groups": [{"cluster_ids", "merged_title", "merged_key", "rationale"}], "dropped_clusters": [{"cluster_id", "reason"}]}'
    return F.concat(F.lit("Target: "), F.coalesce(title, F.lit("")), F.lit("\n\nClusters:\n"), F.to_json(clusters), F.lit(f"\n\n{ask} {JSON_ONLY}"))


def reasoning(package: Column) -> Column:
    """Asks for a paper's claims, what each builds on, and which studies ground that. package: a struct of what is known of the paper."""
    ask = (
        "Write the paper's discovery claims, each atomic. For each list the contributions it could not do without, the smallest sufficient set; for each of those the studies considered, the one that grounds it "
        'or none, and a quote of 5 to 25 words. {"original_discovery_claim", "claim_split_decision", "rewritten_claims": [{"claim_id", "rewritten_claim", "ingredients": [{"ingredient_id", "ingredient", "role", '
        '"candidate_studies_considered", "canonical_grounding_decision", "additional_groundings", "evidence_span"}]}]}'
    )
    return F.concat(F.lit("Paper:\n"), F.to_json(package), F.lit(f"\n\n{ask} {JSON_ONLY}"))


def formatting(reasoned: Column) -> Column:
    """Asks for a reasoned answer as an annotation payload."""
    rules = (
        "text equals rewritten_claim; a canonical_ref_id of __NONE__ has no grounding and no enabling discovery; a single role stands in role too, several only in roles; additional_ref_ids are those of additional_groundings in order."
    )
    return F.concat(F.lit("Bring this into the payload's form. Rules: "), F.lit(rules), F.lit(f" {JSON_ONLY}\n\n"), F.coalesce(reasoned, F.lit("")))


def choice(candidates: Column) -> Column:
    """Asks for the best of several reasoned answers. candidates: an array of texts, shown with their index from 0."""
    shown = F.array_join(F.transform(candidates, lambda x, i: F.concat(F.lit("Candidate "), i.cast("string"), F.lit(":\n"), F.coalesce(x, F.lit("")))), "\n\n")
    ask = 'Score each from 1 to 10 for faithful quotes, atomic claims and small sufficient sets, and choose the best. {"selected_index", "selected_candidate_id", "scores": [{"candidate_id", "score", "reason"}]}'
    return F.concat(shown, F.lit(f"\n\n{ask} {JSON_ONLY}"))


def alignment(a: Column, b: Column) -> Column:
    """Asks how far two claims say the same, from 0 to 3."""
    return F.concat(F.lit("First claim: "), a, F.lit("\nSecond claim: "), b, F.lit(f'\n\nHow far do they say the same, from 0 (nothing) to 3 (the same)? {JSON_ONLY} {{"score", "reasoning"}}'))


def reference_recall(reference: Column, predicted: Column) -> Column:
    """Asks whether one of the predicted contributions covers a reference one. predicted: an array of texts."""
    return F.concat(F.lit("Reference contribution: "), reference, F.lit("\n\nPredicted contributions:\n"), lines(predicted), F.lit(f'\n\nDoes one of them name the same contribution? {JSON_ONLY} {{"covered", "best_match_idx", "reasoning"}}'))
