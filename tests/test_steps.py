"""Model steps over rules that stand in for models."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pathwright.plans import steps
from pathwright.sources import providers


def replies(column, answers, error=None):
    """A call that answers by the value of a column; what has no answer fails."""
    table = F.create_map(*(x for k, v in answers.items() for x in (F.lit(k), F.lit(v)))) if answers else F.create_map().cast("map<string,string>")
    said = lambda: F.try_element_at(table, F.col(column).cast("string"))
    return lambda p: p.withColumn("response", said()).withColumn("error", F.when(said().isNull(), F.lit(error or "no answer")))


GOLD = "gold_ingredients array<struct<enabling_contribution: string, roles: array<string>>>, predicted_ingredients array<struct<description: string, role: string, rationale: string>>"
TASKS = f"paper_id string, claim_idx int, mode string, claim string, basis array<string>, {GOLD}"


def tasks(spark):
    return spark.createDataFrame([(p, 0, "B1", f"claim of {p}", None, [], []) for p in "abcd"], TASKS)


def test_queries_with_fallback_and_repair(spark):
    call = replies("paper_id", {"a": '{"queries": ["x", " ", "y", "z"]}', "b": "no json", "c": '{"queries": []}'})
    got = {}
    for r in steps.generated_queries(tasks(spark), call, 2, replies("paper_id", {"b": '{"queries": ["mended"]}'})).collect():
        got.setdefault(r["paper_id"], []).append((r["query_idx"], r["query"], r["error"]))
    assert sorted(got["a"]) == [(1, "x", None), (2, "y", None)] and got["b"] == [(1, "mended", None)]
    assert {e for _, _, e in got["c"]} == {"empty query generation"} and {e for _, _, e in got["d"]} == {"no answer"} and {q for _, q, _ in got["d"]} == {"claim of d"}


def test_scores_in_batches(spark):
    rows = [("a", 0, "B1", f"t{i}", f"title {i}", None, [], "", 1, 1, 1.0 - i / 10, i + 1) for i in range(5)]
    ranked = spark.createDataFrame(rows, "paper_id string, claim_idx int, mode string, cand_paper_id string, paper_title string, year int, authors array<string>, snippet string, best_rank int, frequency int, deterministic_score double, rank int")
    s = lambda i, x: {"paper_id": f"t{i}", "score": x}
    call = replies("batch", {"0": json.dumps({"scores": [s(0, 1), s(1, 9), s(0, 5), {"paper_id": "stranger", "score": 5}]})})
    best, errors = steps.scored_candidates(tasks(spark), ranked, call, most=4, batch=2)
    assert [(r["cand_paper_id"], r["llm_score"], r["missing_llm_score"]) for r in best.orderBy("rank").collect()] == [("t1", 5, False), ("t0", 1, False), ("t2", 0, True), ("t3", 0, True), ("t4", 0, True)]
    assert [(r["batch"], r["error"]) for r in errors.collect()] == [(1, "no answer")]


def test_judging_asks_again_and_reports(spark):
    g, p = [("g", []), ("h", [])], [("x", "r", "w")]
    rows = [(k, 0, g, p) for k in "abc"] + [("d", 0, g, []), ("e", 0, [], p)]
    t = spark.createDataFrame(rows, f"paper_id string, claim_idx int, {GOLD}")
    edge = '{"matches": [{"reference_idx": 2, "predicted_idx": 1, "match": "full"}]}'
    n = spark.sparkContext.accumulator(0)

    def call(prompts):
        n.add(1)
        return replies("paper_id", {"a": edge, "b": "?" if n.value == 1 else edge, "c": "?"})(prompts)

    got, errors = steps.judged(t, call)
    assert {r["paper_id"]: (r["n_matched"], r["recall"]) for r in got.collect()} == {"a": (1, 0.5), "b": (1, 0.5), "d": (0, 0.0)}
    assert [tuple(r) for r in errors.collect()] == [("c", 0, "the answer does not parse")]


def test_generation_asks_again(spark):
    t = spark.createDataFrame([("a", "claim", None, None, None), ("b", "claim", None, None, None)], "paper_id string, claim string, related_work string, references array<struct<title: string, contexts: array<string>>>, few_shots array<string>")
    good = '{"ingredients": [{"description": "d", "role": "r", "rationale": "w"}, {"description": "N/A", "role": "r", "rationale": "w"}]}'
    got = {r["paper_id"]: (r["n_predicted"], r["attempt"], r["error"]) for r in steps.generated(t, replies("paper_id", {"a": good, "b": "?"})).collect()}
    assert got == {"a": (1, 1, None), "b": (0, 2, "the answer does not parse")}


def test_silver_steps(spark):
    c = spark.createDataFrame([("p", i, "Uses", 1.0 - i / 10, f"text {i}") for i in range(3)], "paper_id string, id int, label string, confidence double, text string")
    papers = spark.createDataFrame([("p", "Title", "A. B", 2000)], "paper_id string, title string, authors string, year int")
    answer = json.dumps({"labels": [{"id": 0, "label": "USES", "cue_span": "we use"}, {"id": 1, "label": "EXTENDS", "cue_span": ""}]})
    v = steps.verified(c, papers, replies("paper_id", {"p": answer}))
    assert {r["id"]: r["label"] for r in v.collect()} == {0: "USES", 1: "NOT_CONFIRMED", 2: "NOT_CONFIRMED"}
    texts = spark.createDataFrame([("p", f"c{i}", "Citing", ["one"]) for i in range(4)], "paper_id string, citing_paper_id string, citing_title string, texts array<string>")
    said = lambda k: json.dumps({"label": "USES", "paper_claim": k, "cluster_key": f"USES|data|{k}", "evidence_span": "e"})
    x = steps.extracted(texts, papers, replies("citing_paper_id", {"c0": said("k"), "c1": said("l"), "c2": said("m"), "c3": "?"}))
    assert {r["citing_paper_id"]: r["label"] for r in x.collect()} == {"c0": "USES", "c1": "USES", "c2": "USES", "c3": "NOT_CONFIRMED"}
    from pathwright.operators import clusters as clu

    decided = json.dumps({"kept_groups": [{"cluster_ids": ["1", "3"]}], "dropped_clusters": [{"cluster_id": "2", "reason": "r"}]})
    for answer, want in ((decided, [["1", "3"]]), ("?", [["1"], ["2"], ["3"]])):
        got = steps.refined(clu.exact_key_clusters(x), papers, replies("paper_id", {"p": answer})).orderBy("cluster_id").collect()
        assert [list(r["source_cluster_ids"]) for r in got] == want


def test_annotation(spark):
    p = spark.createDataFrame([("p", "T"), ("q", "U"), ("r", "V")], "paper_id string, title string")
    reason = lambda x: x.withColumn("response", F.when(F.col("paper_id") != "r", F.concat("paper_id", F.col("candidate").cast("string")))).withColumn("error", F.when(F.col("paper_id") == "r", "down"))
    got = {r["paper_id"]: (r["response"], r["payload"], r["error"]) for r in steps.annotated(p, reason, replies("paper_id", {"p": '{"selected_index": 2}', "q": "?"}), replies("paper_id", {"p": '{"claims": []}', "q": "broken"})).collect()}
    assert got == {"p": ("p3", '{"claims": []}', None), "q": ("q1", None, "the payload does not parse"), "r": (None, None, "no reasoning")}


def test_recorded_answers_serve_as_calls(spark):
    t = tasks(spark).where("paper_id = 'a'")
    prompt = []
    steps.generated_queries(t, lambda p: (prompt.append(p.first()["prompt"]), replies("paper_id", {})(p))[1]).collect()
    r = spark.range(1).select(F.lit("queries").alias("stage"), F.sha2(F.lit(prompt[0]), 256).alias("prompt_sha"), F.lit(1).alias("attempt"), F.lit('{"queries": ["kept"]}').alias("response"), F.lit(None).cast("string").alias("error"))
    assert [x["query"] for x in steps.generated_queries(t, lambda p: providers.recorded(p, r, "queries")).collect()] == ["kept"]
