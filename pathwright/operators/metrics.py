"""Recall, precision, F1, any-hit and coverage of rankings and matchings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or NULL."""
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0))), F.lit(0.0))


def f1(recall: Column, precision: Column) -> Column:
    """The harmonic mean; 0 where both are 0, NULL where one is NULL."""
    return F.when(recall + precision == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def paper_scores(selected: Column, gold: Column) -> Column:
    """struct(recall, precision, f1, any_hit) of selected ids against gold ones: recall over distinct gold ids, precision over the
    list as it is. 0 for empty lists."""
    hits = F.size(F.array_intersect(selected, gold))
    recall, precision = ratio(hits, F.size(F.array_distinct(gold))), ratio(hits, F.size(selected))
    return F.struct(recall.alias("recall"), precision.alias("precision"), f1(recall, precision).alias("f1"), F.when(hits > 0, 1.0).otherwise(0.0).alias("any_hit"))


def coverage(selected: Column, groups: Column) -> Column:
    """The share of groups of which an id was selected; 0 without groups."""
    hit = F.size(F.filter(groups, lambda g: F.coalesce(F.arrays_overlap(g, selected), F.lit(False))))
    return ratio(hit, F.greatest(F.size(groups), F.lit(0)))


def recall_at(ids: Column, targets: Column, k: int) -> Column:
    """Whether one of the first k ids is a target."""
    return F.coalesce(F.arrays_overlap(F.slice(ids, 1, k), targets), F.lit(False))


def ranking_metrics(rankings: DataFrame, claims: DataFrame, budgets: Sequence[int], dims: Sequence[str] = ("mode",), key: Sequence[str] = ("paper_id", "claim_idx")) -> DataFrame:
    """Means over the claims with targets, per dims and budget, of the pool's and the selection's recall, precision, F1, any-hit and
    coverage, at four digits. rankings: (key, dims, rank, cand_paper_id); claims: (key, dims, target_ids, target_ingredient_groups).

    Only sizes and hits are aggregated per claim, and one more aggregation gives the means; claims without candidates count with 0,
    claims whose target_ids are NULL or empty not at all."""
    c = claims.where(F.size("target_ids") > 0).select(*key, *dims, "target_ids", "target_ingredient_groups")
    r = rankings.groupBy(*key, *dims).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_paper_id"))), lambda x: x["cand_paper_id"]).alias("_pool"))
    j = c.join(r, [*key, *dims], "left").withColumn("_pool", F.coalesce("_pool", F.array().cast("array<string>")))
    groups = F.coalesce("target_ingredient_groups", F.array().cast("array<array<string>>"))
    j = j.select(*dims, "target_ids", groups.alias("_groups"), "_pool", paper_scores(F.col("_pool"), F.col("target_ids")).alias("_p"), coverage(F.col("_pool"), groups).alias("_pc"))
    j = j.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    j = j.withColumn("_sel", F.slice("_pool", F.lit(1), F.col("budget")))
    j = j.select(*dims, "budget", "_p", "_pc", paper_scores(F.col("_sel"), F.col("target_ids")).alias("_s"), coverage(F.col("_sel"), F.col("_groups")).alias("_sc"))
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return j.groupBy(*dims, "budget").agg(
        F.count("*").alias("claims"),
        mean("_p.recall", "candidate_pool_recall"), mean("_p.precision", "candidate_pool_precision"), mean("_p.f1", "candidate_pool_f1"),
        mean("_p.any_hit", "candidate_pool_any_hit"), mean("_pc", "candidate_pool_ingredient_coverage"),
        mean("_s.recall", "mean_recall"), mean("_s.precision", "mean_precision"), mean("_s.f1", "mean_f1"), mean("_s.any_hit", "any_hit_rate"), mean("_sc", "ingredient_coverage"),
    )


def matching_metrics(rows: DataFrame) -> DataFrame:
    """rows of (n_matched, n_reference, n_predicted) with recall, precision and f1: recall 0 without references, precision NULL without
    predictions, f1 at three digits and NULL where one of both is."""
    recall = ratio(F.col("n_matched"), F.col("n_reference"))
    precision = F.try_divide(F.col("n_matched").cast("double"), F.nullif(F.col("n_predicted"), F.lit(0)))
    return rows.withColumn("recall", recall).withColumn("precision", precision).withColumn("f1", F.round(f1(F.col("recall"), F.col("precision")), 3))


def judgment_scores(judgments: Column, n_predicted: Column) -> Column:
    """struct(recall, precision) from per-reference judgments (covered, best_match_idx): the share covered, and the distinct predictions
    that cover one by their number."""
    hit = F.filter(judgments, lambda j: j["covered"])
    distinct = F.size(F.array_distinct(F.filter(F.transform(hit, lambda j: j["best_match_idx"]), lambda i: i.isNotNull())))
    return F.struct(ratio(F.size(hit), F.greatest(F.size(judgments), F.lit(0))).alias("recall"), F.try_divide(distinct.cast("double"), F.nullif(n_predicted, F.lit(0))).alias("precision"))


def summary(rows: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Of judged rows (recall, precision, f1, n_reference, n_predicted, error, n_judge_errors): NULL-skipping means at three digits, rates of
    full, partial and zero recall, errors, and mean sizes at two digits."""
    rate = lambda cond: F.round(ratio(F.count_if(cond), F.count("recall")), 3)
    r = F.col("recall")
    return rows.groupBy(*dims).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_gen_errors"),
        F.coalesce(F.sum("n_judge_errors"), F.lit(0)).alias("n_judge_errors"),
        F.round(F.avg("recall"), 3).alias("mean_recall"), F.round(F.avg("precision"), 3).alias("mean_precision"), F.round(F.avg("f1"), 3).alias("mean_f1"),
        rate(r == 1).alias("full_recall_rate"), rate((r > 0) & (r < 1)).alias("partial_recall_rate"), rate(r == 0).alias("zero_recall_rate"),
        F.round(F.avg("n_reference"), 2).alias("mean_n_reference"), F.round(F.avg("n_predicted"), 2).alias("mean_n_predicted"),
    )


def comparison_summary(rows: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Of rows (c1_score, c2_type_match, c4_type_coverage): means and rates at three digits; an absent c1_score is left out of its own."""
    rate = lambda cond, n: F.round(F.try_divide(F.count_if(cond).cast("double"), F.nullif(n, F.lit(0))), 3)
    n, c1, c2, c4 = F.count("*"), F.col("c1_score"), F.col("c2_type_match"), F.col("c4_type_coverage")
    return rows.groupBy(*dims).agg(
        n.alias("n_papers"), F.round(F.avg(c1), 3).alias("c1_mean_score"), rate(c1 >= 2, F.count(c1)).alias("c1_agreement_rate"),
        rate(c2 == 1, n).alias("c2_exact_match_rate"), rate(c2 >= 0.5, n).alias("c2_partial_plus_rate"),
        F.round(F.avg(c4), 3).alias("c4_mean_coverage"), rate(c4 == 1, n).alias("c4_exact_match_rate"), rate(c4 >= 0.5, n).alias("c4_partial_plus_rate"),
    )


def block_counters(results: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Errors and mean sizes of blocks of results (error, n_candidates, n_ranked, n_scored, n_missing)."""
    mean = lambda c: F.round(F.avg(c), 4)
    return results.groupBy(*dims).agg(
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_errors"), mean("n_candidates").alias("mean_candidates"), mean("n_ranked").alias("mean_ranked"),
        mean("n_scored").alias("mean_scored"), mean("n_missing").alias("mean_missing"),
    )
