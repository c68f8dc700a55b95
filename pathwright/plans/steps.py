"""Model steps composed: prompt, call, parse, repair, and what holds where an answer fails.

A call is any function from prompts (…, prompt) to the same rows with response and error: recorded answers
(providers.recorded), live ones (providers.completed), or a rule. Each step is one plan; failures are rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathwright.functions import prompts
from pathwright.functions.jsonx import parsed, parsed_list
from pathwright.functions.text import fallback_queries, stripped
from pathwright.operators import candidates as cand, citations as cit, clusters as clu, groundings
from pathwright.plans import annotation, judging, silver
from pathwright.session import written

Call = Callable[[DataFrame], DataFrame]
KEY = ("paper_id", "claim_idx", "mode")
SCORE = "struct<paper_id: string, score: string, grounds: array<int>, reason: string>"


def answered(rows: DataFrame, call: Call, parse: Callable[[Column], Column], shape: str, repair: Call | None = None) -> DataFrame:
    """rows (…, prompt) with response, value, repaired and error. Answers that do not parse go to `repair`, which is asked for the shape; a call that
    failed is not repaired. Answers are written before they are read twice, so that a live model is asked once."""
    a = written(call(rows))
    a = a.withColumn("value", parse(F.col("response")))
    failed = F.nullif(F.col("error"), F.lit(""))
    if repair is None:
        return a.withColumn("repaired", F.lit(False)).withColumn("error", F.coalesce(failed, F.when(F.col("value").isNull(), F.lit("the answer does not parse"))))
    good = a.where(failed.isNotNull() | F.col("value").isNotNull()).withColumn("repaired", F.lit(False)).withColumn("error", failed)
    bad = a.where(failed.isNull() & F.col("value").isNull()).drop("value", "error").withColumnsRenamed({"prompt": "_prompt", "response": "_response"})
    r = written(repair(bad.withColumn("prompt", prompts.repair(F.col("_response"), shape)))).withColumn("value", parse(F.col("response")))
    r = r.withColumn("repaired", F.col("value").isNotNull()).withColumn("error", F.when(F.col("value").isNull(), F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("neither answer nor repair parses"))))
    r = r.drop("prompt", "response").withColumnsRenamed({"_prompt": "prompt", "_response": "response"})
    return good.unionByName(r)


def again(rows: DataFrame, call: Call, parse: Callable[[Column], Column], attempts: int = 2) -> DataFrame:
    """rows (…, prompt) with response, value, error and attempt: asked anew where the answer does not parse, at most so many times."""
    done, left = None, rows
    for n in range(1, max(1, attempts) + 1):
        a = written(call(left)).withColumn("value", parse(F.col("response"))).withColumn("attempt", F.lit(n))
        a = a.withColumn("error", F.coalesce(F.nullif(F.col("error"), F.lit("")), F.when(F.col("value").isNull(), F.lit("the answer does not parse"))))
        keep = a if n == max(1, attempts) else a.where("value is not null")
        done = keep if done is None else done.unionByName(keep)
        left = a.where("value is null").select(*rows.columns)
    return done


def generated_queries(tasks: DataFrame, call: Call, n: int = 5, repair: Call | None = None) -> DataFrame:
    """(paper_id, claim_idx, mode, query_idx from 1, query, error): the model's queries that say something, the first n; the fallback queries where the
    call failed, its answer does not parse or holds none, and then error says so. tasks: those of grounding.tasks_of() with gold_ingredients and
    predicted_ingredients."""
    evidence = groundings.evidence(F.col("mode"), F.col("claim"), F.col("gold_ingredients"), F.col("predicted_ingredients"))
    p = tasks.select(*KEY, "claim", "basis", prompts.queries(evidence, n).alias("prompt"))
    a = answered(p, call, lambda c: parsed(c, "struct<queries: array<string>>")["queries"], '{"queries": ["…"]}', repair)
    own = F.slice(F.filter(F.transform("value", stripped), lambda q: q != ""), 1, n)
    some = F.coalesce(F.size(own) > 0, F.lit(False))
    q = F.when(some, own).otherwise(fallback_queries(F.col("claim"), F.col("basis"), n))
    error = F.when(~some, F.coalesce("error", F.lit("empty query generation")))
    rows = a.select(*KEY, error.alias("error"), F.posexplode(q).alias("_p", "query"))
    return rows.select(*KEY, (F.col("_p") + 1).alias("query_idx"), "query", "error")


def scored_candidates(tasks: DataFrame, ranked: DataFrame, call: Call, most: int = 30, batch: int = 10, repair: Call | None = None) -> tuple[DataFrame, DataFrame]:
    """(reranked, errors): the candidates by the scores of the best `most` of each claim, asked in batches, and (key, batch, error) of the batches that
    failed; their candidates count as unscored. tasks as for generated_queries(); ranked: candidates of candidates.fuse()."""
    ranked = written(ranked)
    asked = cand.batches(cand.top(ranked, most), KEY, ["rank"], batch)
    shown = F.struct("rank", F.col("cand_paper_id").alias("paper_id"), F.col("paper_title").alias("title"), "year", "deterministic_score", "best_rank", "frequency", "snippet")
    b = asked.groupBy(*KEY, "batch").agg(F.array_sort(F.collect_list(shown)).alias("_c"))
    evidence = groundings.evidence(F.col("mode"), F.col("claim"), F.col("gold_ingredients"), F.col("predicted_ingredients"))
    p = b.join(tasks, list(KEY)).select(*KEY, "batch", prompts.scores(evidence, prompts.coverage_rule(F.col("mode")), F.col("_c")).alias("prompt"))
    a = answered(p, call, lambda c: parsed_list(c, "scores", SCORE), '{"scores": [{"paper_id", "score", "grounds", "reason"}]}', repair)
    i = a.select(*KEY, "batch", F.posexplode("value").alias("_p", "_s"))
    items = i.select(*KEY, (F.col("batch") * 100_000 + F.col("_p")).alias("position"), F.col("_s.paper_id").alias("cand_paper_id"), "_s.score", "_s.grounds", "_s.reason")
    return cand.rerank(ranked, cand.valid_scores(items, ranked)), a.where("error is not null").select(*KEY, "batch", "error")


def generated(tasks: DataFrame, call: Call, attempts: int = 2) -> DataFrame:
    """tasks of judging.generation_prompts() with predicted_ingredients, n_predicted, attempt and error: asked again where no ingredients parse."""
    a = again(judging.generation_prompts(tasks), call, lambda c: parsed_list(c, "ingredients", judging.PREDICTED), attempts)
    return judging.parsed_predictions(a.drop("value"))


def judged(tasks: DataFrame, call: Call, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(judged, errors): claims (paper_id, claim_idx, gold_ingredients, predicted_ingredients) with matching and metrics, and (paper_id, claim_idx,
    error) of those whose judge gave nothing that parses; they are not judged. Claims without gold contributions are left out; without
    predictions nobody is asked."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    t = tasks.withColumns({"n_reference": size("gold_ingredients"), "n_predicted": size("predicted_ingredients")}).where("n_reference > 0")
    p = judging.judge_prompts(t.where("n_predicted > 0")).select("paper_id", "claim_idx", "n_reference", "n_predicted", "prompt")
    a = written(again(p, call, lambda c: parsed_list(c, "matches", judging.EDGE), attempts).drop("value"))
    errors = a.where("error is not null").select("paper_id", "claim_idx", "error")
    sizes = t.select("paper_id", "claim_idx", "n_reference", "n_predicted").join(errors.select("paper_id", "claim_idx"), ["paper_id", "claim_idx"], "left_anti")
    return judging.judge(sizes, judging.parsed_edges(a.where("error is null"))), errors


def verified(contexts: DataFrame, papers: DataFrame, call: Call, settings: silver.Settings = silver.Settings()) -> DataFrame:
    """Contexts that may be uses, as the model confirms them, asked in batches of a paper; a batch whose answer does not parse confirms none.
    contexts: labelled (paper_id, id, label, confidence, text); papers: (paper_id, title, authors, year)."""
    c = written(silver.to_verify(contexts, settings))
    b = c.groupBy("paper_id", "batch").agg(F.array_sort(F.collect_list(F.struct("position", "id", "text"))).alias("_c")).join(papers, "paper_id", "left")
    known = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    p = b.select("paper_id", "batch", prompts.verification(known("title"), known("authors"), known("year"), F.col("_c")).alias("prompt"))
    return cit.verified(c, silver.verification_answers(call(p)))


def extracted(texts: DataFrame, papers: DataFrame, call: Call) -> DataFrame:
    """Contributions of citing papers: of (paper_id, citing_paper_id, citing_title, texts array) each as the model states it; an answer that does not
    parse is not confirmed. papers: (paper_id, title)."""
    j = texts.join(papers.select("paper_id", "title"), "paper_id", "left")
    return silver.contributions(call(j.select("paper_id", "citing_paper_id", prompts.contribution(F.col("title"), F.col("citing_title"), F.col("texts")).alias("prompt"))))


REFINED = "struct<kept_groups: array<struct<cluster_ids: array<string>>>, dropped_clusters: array<struct<cluster_id: string, reason: string>>>"


def refined(clusters: DataFrame, papers: DataFrame, call: Call) -> DataFrame:
    """Clusters merged and dropped as the model says, where its answer parses; else all kept as they are. clusters: those of exact_key_clusters()."""
    c = written(clusters.withColumn("ord", F.col("cluster_id")).withColumn("cluster_id", F.col("cluster_id").cast("string")))
    shown = F.array_sort(F.collect_list(F.struct("ord", "cluster_id", "cluster_key", "cluster_title", "count")))
    p = c.groupBy("paper_id").agg(shown.alias("_c")).join(papers.select("paper_id", "title"), "paper_id", "left")
    v = written(call(p.select("paper_id", prompts.refinement(F.col("title"), F.col("_c")).alias("prompt")))).select("paper_id", parsed(F.col("response"), REFINED).alias("v"))
    k = v.select("paper_id", F.posexplode("v.kept_groups").alias("_g", "_k")).select("paper_id", (F.col("_g") + 1).alias("group"), F.posexplode("_k.cluster_ids").alias("position", "cluster_id"))
    d = v.select("paper_id", F.posexplode("v.dropped_clusters").alias("position", "_d")).select("paper_id", "position", "_d.cluster_id", "_d.reason")
    return clu.merged_clusters(c, clu.normalised_decisions(c, k, d))


def annotated(packages: DataFrame, reason: Call, choose: Call, form: Call, candidates: int = 3, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """(paper_id, candidate, response, payload, error): of several reasoned answers the one the judge chooses, brought into the payload's form; asked
    with prompts of packages (paper_id, …). A reasoning that failed is no candidate; a paper with none, or whose payload does not parse, has an error."""
    shown = F.struct(*(c for c in packages.columns if c not in key))
    p = annotation.attempts(packages.select("paper_id", prompts.reasoning(shown).alias("prompt")), candidates)
    a = written(reason(p)).where("response is not null and coalesce(error, '') = ''")
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("candidate"))
    a = written(a.select("paper_id", number.alias("candidate"), "response"))
    many = a.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("candidate", "response"))), lambda x: x["response"]).alias("_r"))
    judgments = choose(many.where(F.size("_r") > 1).select("paper_id", prompts.choice(F.col("_r")).alias("prompt")))
    best = annotation.chosen(a, written(judgments).select("paper_id", "response"))
    formed = written(form(best.select("paper_id", "candidate", F.col("response").alias("_reasoned"), prompts.formatting(F.col("response")).alias("prompt"))))
    payload = F.when(F.try_parse_json(F.col("response")).isNotNull(), F.col("response"))
    out = formed.select("paper_id", "candidate", F.col("_reasoned").alias("response"), payload.alias("payload"), F.coalesce(F.nullif(F.col("error"), F.lit("")), F.when(payload.isNull(), F.lit("the payload does not parse"))).alias("error"))
    return packages.select("paper_id").distinct().join(out, "paper_id", "left").withColumn("error", F.when(F.col("candidate").isNull(), F.lit("no reasoning")).otherwise(F.col("error")))
