"""Record layouts as DDL, for readers that must not infer: fixed values."""

from __future__ import annotations

GROUNDING = "ref_id STRING, bib_key STRING, paper_id STRING, external_ids MAP<STRING, STRING>, ref_title STRING, ref_year STRING, ref_authors STRING"
ANNOTATION = "roles ARRAY<STRING>, role STRING, contribution STRING, rationale STRING, evidence_span STRING"
INGREDIENT = f"enabling_contribution_id STRING, enabling_contribution STRING, canonical_ref_id STRING, canonical_grounding STRUCT<{GROUNDING}>, additional_ref_ids ARRAY<STRING>, additional_groundings ARRAY<STRUCT<{GROUNDING}>>, canonical_annotation STRUCT<{ANNOTATION}>"
PREDICTED = "description STRING, role STRING, rationale STRING, ref_title STRING"
EDGE = "reference_idx INT, predicted_idx INT, match STRING, reasoning STRING"
CONTEXT = "context STRING, context_with_marker STRING, intents ARRAY<STRING>"
SHORT = "ref_id STRING, paper_id STRING, ref_title STRING"
PAYLOAD_INGREDIENT = f"ingredient_id STRING, ingredient STRING, canonical_ref_id STRING, canonical_grounding STRUCT<{SHORT}>, additional_ref_ids ARRAY<STRING>, additional_groundings ARRAY<STRUCT<{SHORT}>>, canonical_annotation STRUCT<{ANNOTATION}>"
DISCOVERY = "ref_id STRING, ingredient_id STRING, ingredient STRING, role STRING, roles ARRAY<STRING>"

TABLES = {
    "gold_claims": f"claim_id STRING, claim_idx INT, conference_year INT, target_paper_id STRING, target_title STRING, target_contribution STRING, downstream_usage_evidence STRING, enabling_contributions ARRAY<STRUCT<{INGREDIENT}>>",
    "blind_claims": "idx INT, target_contribution STRING",
    "claim_tasks": f"paper_id STRING, paper_title STRING, claim_idx INT, claim STRING, conference_year INT, target_ids ARRAY<STRING>, target_titles MAP<STRING, STRING>, target_ingredient_groups ARRAY<ARRAY<STRING>>, gold_ingredients ARRAY<STRUCT<{INGREDIENT}>>, predicted_ingredients ARRAY<STRUCT<{PREDICTED}>>",
    "ingredient_tasks": "paper_id STRING, claim_idx INT, ingredient_idx INT, ingredient STRING, canonical_id STRING, target_ids ARRAY<STRING>, ref_title STRING, role STRING, leaked BOOLEAN, extra MAP<STRING, STRING>",
    "predictions": f"paper_id STRING, claim_idx INT, paper_title STRING, claim STRING, source STRING, setting INT, generator_model STRING, n_predicted INT, predicted_ingredients ARRAY<STRUCT<{PREDICTED}>>, error STRING",
    "match_edges": f"paper_id STRING, claim_idx INT, {EDGE}",
    "judged": f"paper_id STRING, claim_idx INT, n_reference INT, n_predicted INT, matched_pairs ARRAY<STRUCT<{EDGE}>>, recall_judgments ARRAY<STRUCT<reference_idx: INT, reference_ingredient: STRING, covered: BOOLEAN, best_match_idx: INT, reasoning: STRING>>, recall DOUBLE, precision DOUBLE, f1 DOUBLE, error STRING",
    "search_hits": "paper_id STRING, claim_idx INT, mode STRING, query_idx INT, query STRING, rank INT, hit_paper_id STRING, title STRING, year INT, authors ARRAY<STRING>, abstract STRING, tldr STRING",
    "candidates": "paper_id STRING, claim_idx INT, mode STRING, cand_paper_id STRING, paper_title STRING, year INT, authors ARRAY<STRING>, best_rank INT, frequency INT, retrieved_by ARRAY<STRUCT<query_idx: INT, query: STRING, rank: INT>>, snippet STRING, deterministic_score DOUBLE",
    "llm_scores": "paper_id STRING, claim_idx INT, mode STRING, cand_paper_id STRING, llm_score INT, llm_grounds ARRAY<INT>, llm_reason STRING",
    "citations": f"paper_id STRING, ord INT, isInfluential BOOLEAN, contextsWithIntent ARRAY<STRUCT<{CONTEXT}>>, contexts ARRAY<STRING>, citingPaper STRUCT<paperId: STRING, title: STRING, externalIds: MAP<STRING, STRING>>",
    "paper_metadata": "paperId STRING, title STRING, year INT, publicationDate STRING, authors ARRAY<STRUCT<authorId: STRING, name: STRING>>, url STRING, venue STRING, externalIds MAP<STRING, STRING>, tldr STRUCT<model: STRING, text: STRING>, abstract STRING, citationCount INT, referenceCount INT",
    "context_labels": "paper_id STRING, id INT, label STRING, confidence DOUBLE, confidence_margin DOUBLE, cue_span STRING, rationale STRING, citing_paper_id STRING, citing_title STRING, text STRING",
    "verified_contexts": "paper_id STRING, id INT, label STRING, cue_span STRING, rationale STRING, text STRING, citing_paper_id STRING, citing_title STRING, original_label STRING",
    "citing_paragraphs": "paper_id STRING, citing_paper_id STRING, citing_title STRING, arxiv_id STRING, main_tex_file STRING, bib_texts MAP<STRING, STRING>, target_bib_keys ARRAY<STRING>, target_citing_paragraphs ARRAY<STRING>, matched_paragraphs ARRAY<STRUCT<context_id: INT, context: STRING, context_with_marker: STRING, paragraph: STRING, overlap: DOUBLE>>, error STRING",
    "contributions": "paper_id STRING, contribution_id INT, citing_paper_id STRING, citing_title STRING, label STRING, paper_claim STRING, cluster_title STRING, cluster_key STRING, evidence_span STRING, rationale STRING, contexts ARRAY<STRING>, source STRING",
    "clusters": "paper_id STRING, cluster_id STRING, count INT, representative_claim STRING, cluster_key STRING, cluster_title STRING, claim_indices ARRAY<INT>, source_cluster_ids ARRAY<STRING>, merge_rationale STRING",
    "annotation_payload": f"target_paper_id STRING, target_title STRING, target_year INT, annotator_id STRING, active_claim_id STRING, claims ARRAY<STRUCT<claim_id: STRING, text: STRING, rewritten_claim: STRING, cluster_id: STRING, decision: STRING, notes: STRING, ingredients: ARRAY<STRUCT<{PAYLOAD_INGREDIENT}>>, enabling_discoveries: ARRAY<STRUCT<{DISCOVERY}>>>>",
    "judge_result": "paper_id STRING, selected_index INT, selected_candidate_id STRING, rationale STRING, scores ARRAY<STRUCT<candidate_id: STRING, score: INT, reason: STRING>>",
    "provider_responses": "provider STRING, stage STRING, prompt_sha STRING, attempt INT, response STRING, error STRING",
    "run_results": "run_id STRING, paper_id STRING, stage STRING, attempt INT, result STRING, error STRING",
}
