"""Grounding evaluation: claims to queries, searches, fused candidates, rankings and metrics, as one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pathwright.functions.text import fallback_queries
from pathwright.operators import candidates as cand, metrics, progress
from pathwright.plans.judging import matched_predictions
from pathwright.session import spread
from pathwright.sources import providers

MODES = ("B1", "B3", "B4")


def tasks_of(claims: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """(paper_id, claim_idx, mode, claim, target_ids, target_ingredient_groups, basis): claims times modes. basis holds the texts queries are made
    of: none for B1, gold contributions for B3, predicted descriptions for B4, those with a full match for B4_MATCHED, which needs the claims' judged
    matched_pairs (predicted_idx, match), recall_judgments (covered, best_match_idx), or both."""
    c = progress.grid(claims, mode=list(modes))
    pairs = F.col("matched_pairs") if "matched_pairs" in claims.columns else F.array().cast("array<struct<predicted_idx:int,match:string>>")
    judgments = F.col("recall_judgments") if "recall_judgments" in claims.columns else F.array().cast("array<struct<covered:boolean,best_match_idx:int>>")
    if "B4_MATCHED" in modes and not {"matched_pairs", "recall_judgments"} & set(claims.columns):
        raise ValueError("B4_MATCHED needs matched_pairs or recall_judgments of the claims")
    gold, predicted = F.transform("gold_ingredients", lambda i: i["enabling_contribution"]), F.transform("predicted_ingredients", lambda i: i["description"])
    basis = F.when(F.col("mode") == "B3", gold).when(F.col("mode") == "B4", predicted)
    if "B4_MATCHED" in modes:
        matched = F.transform(matched_predictions(F.col("predicted_ingredients"), pairs, judgments), lambda i: i["description"])
        basis = basis.when(F.col("mode") == "B4_MATCHED", matched)
    return c.select("paper_id", "claim_idx", "mode", "claim", "target_ids", "target_ingredient_groups", basis.alias("basis"))


def queries_of(tasks: DataFrame, n: int = 5) -> DataFrame:
    """(paper_id, claim_idx, mode, query_idx from 1, query) without a model: fallback queries."""
    q = F.posexplode(fallback_queries(F.col("claim"), F.col("basis"), n)).alias("_p", "query")
    return tasks.select("paper_id", "claim_idx", "mode", q).select("paper_id", "claim_idx", "mode", (F.col("_p") + 1).alias("query_idx"), "query")


def fused(tasks: DataFrame, search: Callable[[DataFrame], DataFrame], n_queries: int = 5, most: int = 100) -> DataFrame:
    """Ranked candidates of every task. search: (key, query_idx, query) -> hits with hit_paper_id, title, year and rank, and query, or it is joined.
    Queries are spread by claim, so that equal ones of its modes meet, and hits that meet them by a broadcast are fused and ranked where they are."""
    q = spread(queries_of(tasks, n_queries), "paper_id", "claim_idx")
    hits = search(q)
    hits = hits if "query" in hits.columns else hits.join(q, ["paper_id", "claim_idx", "mode", "query_idx"])
    hits = hits.withColumns({"authors": F.array().cast("array<string>"), "snippet": F.lit("")})
    return cand.fuse(hits, most=most)


def ranked(tasks: DataFrame, corpus: DataFrame, n_queries: int = 5, k: int = 20, most: int = 100, more: dict[str, Column] | None = None) -> DataFrame:
    """(paper_id, claim_idx, mode, more columns made of `claim`, cand_paper_id, paper_title, year, best_rank, frequency, deterministic_score, rank): the
    candidates of every task that fused gives with lexical_search over the corpus, without the list of a paper's hits. Where the index is broadcast, hits
    are fused as they are found, what is shuffled is a row per task, and further columns of the corpus come along."""
    found = providers.lexical_index(corpus)
    if found is None:
        f = fused(tasks, lambda q: providers.lexical_search(q, corpus, k), n_queries, most).select(*cand.CLAIM, "cand_paper_id", "paper_title", "year", "best_rank", "frequency", "deterministic_score", "rank")
        return f.join(tasks.select(*cand.CLAIM, *(c.alias(n) for n, c in more.items())), [*cand.CLAIM]) if more else f
    key = (*cand.CLAIM, "claim")
    t = spread(tasks.select(*key, fallback_queries(F.col("claim"), F.col("basis"), n_queries).alias("_q")), "paper_id", "claim_idx")
    h = t.select(*key, providers.fused_search(found[0], k, most)(F.transform("_q", providers.search_terms)).alias("_h"))
    h = spread(h.select(*key, *(F.col(f"_h.{c}").alias(f"_{c}") for c in ("at", "best", "hits"))), "paper_id", "claim_idx")
    h = h.select(*cand.CLAIM, "_at", "_best", "_hits", *(c.alias(n) for n, c in (more or {}).items()))  # once a task
    h = h.select("*", F.posexplode("_at").alias("_p", "place"))
    h = h.select(*cand.CLAIM, *(more or ()), "place", F.get("_best", F.col("_p")).alias("best_rank"), F.get("_hits", F.col("_p")).alias("frequency"), (F.col("_p") + 1).alias("rank"))
    h = h.join(F.broadcast(found[1].withColumnsRenamed({"hit_paper_id": "cand_paper_id", "title": "paper_title"})), "place").drop("place")
    return h.withColumn("deterministic_score", cand.hit_score(F.col("frequency"), F.col("best_rank")))


def evaluate(tasks: DataFrame, ranked: DataFrame, budgets: Sequence[int] = (5, 10), ranker: str = "deterministic") -> DataFrame:
    """Metric rows per mode and budget."""
    r = ranked.select("paper_id", "claim_idx", "mode", "rank", "cand_paper_id")
    return metrics.ranking_metrics(r, tasks, budgets).withColumn("ranker", F.lit(ranker))
