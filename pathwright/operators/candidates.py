"""Search hits to ranked candidates: fusion, ranking, budgets, batches and reranking by scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathwright.functions.jsonx import clamped_score

CLAIM = ("paper_id", "claim_idx", "mode")


def hit_score(frequency: Column, best_rank: Column) -> Column:
    """Hits + 1 / best rank."""
    return F.round(frequency + F.lit(1.0) / F.greatest(F.lit(1), best_rank), 6)


def fuse(hits: DataFrame, key: Sequence[str] = CLAIM, most: int = 100) -> DataFrame:
    """The distinct papers among a claim's hits: (key, cand_paper_id, paper_title, year, authors, snippet, best_rank, frequency,
    retrieved_by, deterministic_score, rank), the best `most` of each claim.

    hits: (key, query_idx, query, rank, hit_paper_id, title, year, authors, snippet). Score is hits + 1 / best rank; rank is by
    score, best rank, title and first appearance. A paper's fields are those of its first appearance, by query and rank. Hits
    without an id are left out; a claim without hits gives no row."""
    at = F.struct("query_idx", "rank")
    h = hits.where(F.coalesce("hit_paper_id", F.lit("")) != "")
    g = h.groupBy(*key, F.col("hit_paper_id").alias("cand_paper_id")).agg(
        F.min_by(F.struct("title", "year", "authors", "snippet"), at).alias("_first"),
        F.min("rank").alias("best_rank"),
        F.count("*").cast("int").alias("frequency"),
        F.min(at).alias("_at"),
        F.array_sort(F.collect_list(F.struct("query_idx", "rank", "query"))).alias("_by"),
    )
    g = g.select(
        *key, "cand_paper_id", F.col("_first.title").alias("paper_title"), "_first.year", "_first.authors", "_first.snippet", "best_rank", "frequency",
        F.transform("_by", lambda x: F.struct(x["query_idx"].alias("query_idx"), x["query"].alias("query"), x["rank"].alias("rank"))).alias("retrieved_by"),
        hit_score(F.col("frequency"), F.col("best_rank")).alias("deterministic_score"), "_at",
    )
    order = Window.partitionBy(*key).orderBy(F.desc("deterministic_score"), "best_rank", F.coalesce("paper_title", F.lit("")), "_at", "cand_paper_id")
    return g.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_at")


def top(ranked: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The rows within a budget of k per ranking."""
    return ranked.where(F.col(rank) <= k)


def batches(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """rows with `position`, from 1 within the key, and `batch`, the n-sized batch it falls in, from 0."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).withColumn("batch", ((F.col("position") - 1) / n).cast("int"))


def top_by(rows: DataFrame, key: Sequence[str], by: str, order: str, k: int) -> DataFrame:
    """The k rows of each key with the greatest `by`, ties by `order`; all rows if k is not positive."""
    if k <= 0:
        return rows
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(by), order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def valid_scores(items: DataFrame, asked: DataFrame, key: Sequence[str] = CLAIM) -> DataFrame:
    """(key, cand_paper_id, llm_score, llm_grounds, llm_reason) of the score items that hold: the paper was asked for, and the item is
    the first about it. items: (key, position, cand_paper_id, score as text, grounds, reason)."""
    w = Window.partitionBy(*key, "cand_paper_id").orderBy("position")
    first = items.withColumn("cand_paper_id", F.trim("cand_paper_id")).join(asked.select(*key, "cand_paper_id").distinct(), [*key, "cand_paper_id"], "left_semi")
    first = first.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.select(*key, "cand_paper_id", clamped_score(F.col("score")).alias("llm_score"), F.coalesce("grounds", F.array().cast("array<int>")).alias("llm_grounds"), F.coalesce("reason", F.lit("")).alias("llm_reason"))


def rerank(candidates: DataFrame, scores: DataFrame, key: Sequence[str] = CLAIM) -> DataFrame:
    """Candidates by score, then as they were: with llm_score (0 if unscored), missing_llm_score and the new rank."""
    j = candidates.join(scores.select(*key, "cand_paper_id", "llm_score", "llm_grounds", "llm_reason"), [*key, "cand_paper_id"], "left")
    return by_score(j, key)


def by_score(rows: DataFrame, key: Sequence[str] = CLAIM) -> DataFrame:
    """Candidates that bear their llm_score, NULL if unscored, ranked by it: as rerank does, without a join."""
    j = rows.withColumn("missing_llm_score", F.col("llm_score").isNull()).withColumn("llm_score", F.coalesce("llm_score", F.lit(0)))
    w = Window.partitionBy(*key).orderBy(F.desc("llm_score"), F.desc("deterministic_score"), "best_rank", F.coalesce("paper_title", F.lit("")), "rank")
    return j.withColumn("_new", F.row_number().over(w)).drop("rank").withColumnRenamed("_new", "rank")


def without_source(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits that are not the source paper itself, under any of its ids. sources: (paper_id, source_id)."""
    s = sources.select(F.col("paper_id").alias("_p"), F.col("source_id").alias("_s")).distinct()
    return hits.join(s, (F.col("paper_id") == F.col("_p")) & (F.col("hit_paper_id") == F.col("_s")), "left_anti")


def up_to_year(rows: DataFrame, year: str, most: Column | str) -> DataFrame:
    """Rows of at most that year; rows of an unknown year stay."""
    return rows.where(F.col(year).isNull() | (F.col(year) <= (F.col(most) if isinstance(most, str) else most)))


def bounded_search(hits: DataFrame, key: Sequence[str], limit: int, most: Column | str | None = None) -> DataFrame:
    """The first `limit` hits of each search after the bound of the year, ranked anew; three authors of each."""
    h = hits if most is None else up_to_year(hits, "year", most)
    w = Window.partitionBy(*key).orderBy("rank", "hit_paper_id")
    h = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return h.drop("rank").withColumnRenamed("_r", "rank").withColumn("authors", F.slice("authors", 1, 3))
