"""Silver annotation over citation graphs: all papers at once, each step a DataFrame in and out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pathwright.functions.jsonx import parsed
from pathwright.operators import candidates, citations as cit, clusters as clu, paragraphs as par


@dataclass(frozen=True)
class Settings:
    """Knobs of the annotation plan."""

    verify_top_k: int = 50
    verify_batch: int = 25
    paragraph_overlap: float = 0.5
    annotation_candidates: int = 3


def usage(citations: DataFrame) -> DataFrame:
    """Citations (paper_id, ord, isInfluential, contextsWithIntent, contexts, citingPaper) as (paper_id, ord, citing_paper_id, citing_title,
    external_ids, is_influential, contexts)."""
    return citations.select(
        "paper_id", "ord", F.col("citingPaper.paperId").alias("citing_paper_id"), F.col("citingPaper.title").alias("citing_title"), F.col("citingPaper.externalIds").alias("external_ids"),
        F.coalesce("isInfluential", F.lit(False)).alias("is_influential"), cit.contexts_of(F.col("contextsWithIntent"), F.col("contexts")).alias("contexts"),
    )


def labelled(contexts: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled contexts, labels per citing paper, and per paper."""
    rows = cit.with_default_label(contexts, labels)
    citing = cit.citing_labels(rows)
    return rows, citing, cit.final_labels(citing)


def to_verify(labelled_contexts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Contexts that may be uses, the most confident of each paper, with their batch."""
    c = labelled_contexts.where(F.col("label").isin(*cit.USES))
    return candidates.batches(candidates.top_by(c, ["paper_id"], "confidence", "id", s.verify_top_k), ["paper_id"], [F.desc("confidence"), "id"], s.verify_batch)


def verification_answers(responses: DataFrame) -> DataFrame:
    """(paper_id, id, ord, label, cue_span, rationale) of the verifier's answers (paper_id, batch, response); one that does not parse gives none."""
    v = parsed(F.col("response"), "struct<labels: array<struct<id: int, label: string, cue_span: string, rationale: string>>>")["labels"]
    r = responses.select("paper_id", "batch", F.posexplode(v).alias("_p", "_l"))
    return r.select("paper_id", "_l.id", (F.col("batch") * 100_000 + F.col("_p")).alias("ord"), "_l.label", "_l.cue_span", "_l.rationale")


def contributions(responses: DataFrame) -> DataFrame:
    """(paper_id, ord, citing_paper_id, label, paper_claim, cluster_title, cluster_key, evidence_span, rationale) of the extractor's answers, in the
    order of citing papers; one that does not parse is not confirmed."""
    v = parsed(F.col("response"), "struct<label: string, paper_claim: string, claim: string, cluster_title: string, cluster_claim: string, cluster_key: string, evidence_span: string, rationale: string>")
    given = lambda *c: F.coalesce(*(F.nullif(F.col(f"_v.{x}"), F.lit("")) for x in c), F.lit(""))
    r = responses.select("paper_id", "citing_paper_id", v.alias("_v")).select(
        "paper_id", F.col("citing_paper_id").alias("ord"), "citing_paper_id", F.col("_v.label").alias("label"), given("paper_claim", "claim").alias("paper_claim"),
        given("cluster_title", "cluster_claim").alias("cluster_title"), given("cluster_key").alias("cluster_key"), given("evidence_span").alias("evidence_span"), given("rationale").alias("rationale"),
    )
    return clu.contribution_fields(r)


def citing_paragraphs(texts: DataFrame, targets: DataFrame, entries: DataFrame, contexts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(paper_id, citing_paper_id, context_id, p_idx, overlap, paragraph): of each confirmed context the paragraph of the citing paper's source that
    it stands in, with the target's citations marked.

    texts: (paper_id, citing_paper_id, text); targets: (paper_id, title, surname, year); entries: bibliography entries (paper_id, citing_paper_id,
    bib_key, title, author, year); contexts: (paper_id, citing_paper_id, context_id, text)."""
    from pathwright.functions import latex
    from pathwright.functions.text import paragraphs

    key = ["paper_id", "citing_paper_id"]
    every = texts.select(*key).distinct().join(targets, "paper_id")
    keys = par.target_keys(entries, every, key).groupBy(*key).agg(F.collect_set("bib_key").alias("keys"))
    j = texts.join(targets, "paper_id").join(keys, key, "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    marked = latex.mark_target(latex.without_comments(F.col("text")), F.col("keys"), F.coalesce("surname", F.lit("")), F.col("year").cast("int"))
    p = j.select(*key, F.posexplode(paragraphs(marked)).alias("p_idx", "paragraph"))
    return par.best_paragraphs(contexts, p, key, s.paragraph_overlap).join(p, [*key, "p_idx"])


def stop_reasons(papers: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(paper_id, stopped_after): the first stage that gave a paper no rows; NULL for papers that passed all. stages: (name, rows with paper_id)."""
    out = papers.select("paper_id").distinct()
    reason: Column = F.lit(None).cast("string")
    for name, rows in reversed(stages):
        out = out.join(rows.select("paper_id").distinct().withColumn(f"_{name}", F.lit(True)), "paper_id", "left")
        reason = F.when(F.col(f"_{name}").isNull(), F.lit(name)).otherwise(reason)
    return out.select("paper_id", reason.alias("stopped_after"))
