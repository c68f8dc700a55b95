"""Operators over tiny rows, with results worked out by hand, and properties against brute force."""

from __future__ import annotations

import itertools
import json
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pathwright.functions.text import plain_words
from pathwright.operators import candidates as cand, citations as cit, clusters as clu, groundings as gr, matching, metrics, nested, paragraphs as par, progress
from pathwright.plans import annotation, judging, silver
from pathwright.queries import reference


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


HITS = "paper_id string, claim_idx int, mode string, query_idx int, query string, rank int, hit_paper_id string, title string, year int, authors array<string>, snippet string"


def hits(spark, *given):
    return spark.createDataFrame([("p", 0, "B1", q, f"q{q}", r, i, t, None, [], "") for q, r, i, t in given], HITS)


def test_fusion(spark):
    h = hits(spark, (1, 1, "a", "B"), (1, 2, "b", None), (1, 3, "a", "B"), (2, 1, "b", "x"), (2, 2, None, "no id"), (2, 3, "c", "A"), (3, 3, "d", "A"))
    f = cand.fuse(h)
    assert rows(f, "rank", "cand_paper_id", "best_rank", "frequency", "deterministic_score") == [(1, "b", 1, 2, 3.0), (2, "a", 1, 2, 3.0), (3, "c", 3, 1, 1.333333), (4, "d", 3, 1, 1.333333)]
    assert rows(f.where("cand_paper_id = 'b'"), "paper_title") == [(None,)]  # of its first appearance
    assert cand.fuse(h, most=1).count() == 1 and cand.fuse(h.limit(0)).count() == 0


def test_rerank_keeps_unscored(spark):
    ranked = cand.fuse(hits(spark, (1, 1, "a", "t"), (1, 2, "b", "t"), (1, 3, "c", "t")))
    items = spark.createDataFrame([("p", 0, "B1", 1, " b ", "9", None, None), ("p", 0, "B1", 2, "b", "1", None, None), ("p", 0, "B1", 3, "z", "5", None, None), ("p", 0, "B1", 4, "c", "bad", None, None)], "paper_id string, claim_idx int, mode string, position int, cand_paper_id string, score string, grounds array<int>, reason string")
    out = cand.rerank(ranked, cand.valid_scores(items, ranked))
    assert rows(out, "rank", "cand_paper_id", "llm_score", "missing_llm_score") == [(1, "b", 5, False), (2, "a", 0, True), (3, "c", 0, False)]


def test_rerank_takes_every_mode(spark):
    d = "/root/testdata/sf0.001"
    query = reference.queries()
    got = rows(query["llm_rerank_modes"](spark, d), "paper_id", "claim_idx", "mode", "cand_paper_id")
    assert sorted(got) == sorted(rows(query["candidate_fusion"](spark, d), "paper_id", "claim_idx", "mode", "cand_paper_id")) and {x[2] for x in got} == {"B1", "B3", "B4"}
    names = ("paper_id", "claim_idx", "cand_paper_id", "llm_score", "missing_llm_score", "rank")
    assert sorted(rows(query["llm_rerank_modes"](spark, d).where("mode = 'B1'"), *names)) == sorted(rows(query["llm_rerank"](spark, d), *names))


def test_batches_top_and_bounds(spark):
    d = spark.createDataFrame([("p", i, float(i % 3)) for i in range(7)], "k string, id int, c double")
    assert rows(cand.batches(d, ["k"], ["id"], 3), "id", "batch") == [(i, i // 3) for i in range(7)]
    assert rows(cand.top_by(d, ["k"], "c", "id", 3), "id") == [(1,), (2,), (5,)]
    assert cand.top_by(d, ["k"], "c", "id", 0).count() == 7
    y = spark.createDataFrame([("q", 1, "a", None, ["1", "2", "3", "4"]), ("q", 2, "b", 2020, []), ("q", 3, "c", 2021, []), ("q", 4, "d", 2019, [])], "k string, rank int, hit_paper_id string, year int, authors array<string>")
    assert rows(cand.bounded_search(y, ["k"], 2, F.lit(2020)), "rank", "hit_paper_id") == [(1, "a"), (2, "b")]
    s = spark.createDataFrame([("p", "a")], "paper_id string, source_id string")
    assert rows(cand.without_source(hits(spark, (1, 1, "a", "t"), (1, 2, "b", "t")), s), "hit_paper_id") == [("b",)]


def test_metrics(spark):
    c = spark.createDataFrame([("p", 0, "B1", ["g1", "g2"], [["g1"], ["g2", "x"]]), ("q", 0, "B1", ["g3"], [["g3"]]), ("r", 0, "B1", [], []), ("s", 0, "B1", None, None)], "paper_id string, claim_idx int, mode string, target_ids array<string>, target_ingredient_groups array<array<string>>")
    r = spark.createDataFrame([("p", 0, "B1", 1, "x"), ("p", 0, "B1", 2, "g1"), ("r", 0, "B1", 1, "g")], "paper_id string, claim_idx int, mode string, rank int, cand_paper_id string")
    m = {x["budget"]: x for x in metrics.ranking_metrics(r, c, [1, 5]).collect()}
    assert m[1]["claims"] == 2 and m[1]["mean_recall"] == 0 and m[1]["ingredient_coverage"] == 0.25
    assert (m[5]["mean_recall"], m[5]["mean_precision"], m[5]["any_hit_rate"], m[5]["ingredient_coverage"]) == (0.25, 0.25, 0.5, 0.5)
    j = metrics.matching_metrics(spark.createDataFrame([(1, 2, 4), (0, 2, 0), (0, 0, 3), (0, 2, 2)], "n_matched int, n_reference int, n_predicted int"))
    assert [tuple(x)[3:] for x in j.collect()] == [(0.5, 0.25, 0.333), (0.0, None, None), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    s = metrics.summary(j.withColumns({"error": F.lit(""), "n_judge_errors": F.lit(0)})).first()
    assert (s["mean_recall"], s["mean_precision"], s["zero_recall_rate"], s["partial_recall_rate"]) == (0.125, 0.083, 0.75, 0.25)
    w = spark.createDataFrame([([(True, 1), (True, 1), (False, 2)], 4), ([], 0)], "j array<struct<covered: boolean, best_match_idx: int>>, n int")
    assert [tuple(x["s"]) for x in w.select(metrics.judgment_scores(F.col("j"), F.col("n")).alias("s")).collect()] == [(2 / 3, 0.25), (0.0, None)]
    k = metrics.comparison_summary(spark.createDataFrame([(3, 1.0, 0.5), (None, 0.5, 0.0)], "c1_score int, c2_type_match double, c4_type_coverage double")).first()
    assert (k["c1_mean_score"], k["c1_agreement_rate"], k["c2_partial_plus_rate"], k["c4_mean_coverage"]) == (3.0, 1.0, 1.0, 0.25)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(1, 5), st.integers(1, 5))))
def test_matching_is_maximum(edges):
    got = matching.maximum_matching(list(edges))
    assert set(got) <= edges and len({r for r, _ in got}) == len({p for _, p in got}) == len(got)
    best = max(k for k in range(6) if any(len({r for r, _ in c}) == len({p for _, p in c}) == k for c in itertools.combinations(edges, k)))
    assert len(got) == best


def test_matching_over_claims(spark):
    e = spark.createDataFrame([("p", 0, 1, 1, "full"), ("p", 0, 1, 2, "full"), ("p", 0, 2, 1, "full"), ("p", 0, 2, 1, "full"), ("p", 0, 2, 2, "partial"), ("p", 0, 9, 1, "full"), ("p", 0, None, 1, "full"), ("q", 0, 1, 1, "none")], "paper_id string, claim_idx int, reference_idx int, predicted_idx int, match string")
    c = spark.createDataFrame([("p", 0, 2, 2), ("q", 0, 1, 1), ("r", 0, 1, 0)], "paper_id string, claim_idx int, n_reference int, n_predicted int")
    assert rows(judging.judge(c, e), "paper_id", "n_matched", "n_partial", "recall") == [("p", 2, 1, 1.0), ("q", 0, 0, 0.0), ("r", 0, 0, 0.0)]
    assert matching.maximum_matching([(1, 1), (1, 2), (2, 1)]) == [(1, 2), (2, 1)]
    assert matching.maximum_matching([(r, p) for r in range(1, 3000) for p in (r, r + 1)])[-1] == (2999, 2999)


G = "struct<ref_id: string, bib_key: string, paper_id: string, ref_title: string, ref_year: string, ref_authors: string>"
GOLD = f"array<struct<enabling_contribution_id: string, enabling_contribution: string, canonical_ref_id: string, canonical_grounding: {G}, additional_ref_ids: array<string>, additional_groundings: array<{G}>, roles: array<string>>>"


def test_groundings(spark):
    a, b = "a" * 40, "b" * 40
    g = lambda i, t="": ("r", None, i, t, None, None)
    gold = [("E1", "a parser of trees", "r", g(a, "Parsers: trees"), [], [g(b), g(a), g("B" * 40), g("c" * 39)], ["X", "Y"]), ("E2", "t", "__NONE__", None, [], None, None)]
    c = spark.createDataFrame([("p", 0, gold), ("q", 0, None)], f"paper_id string, claim_idx int, gold_ingredients {GOLD}")
    t = gr.ingredient_tasks(c)
    assert rows(t, "paper_id", "ingredient_idx", "canonical_id", "target_ids", "role", "leaked") == [("p", 1, a, [a, b], "X, Y", True)]
    p = spark.createDataFrame([("p", 0, [("uses parsers: of", "r", "x", None), ("other", "r", "x", None)])], "paper_id string, claim_idx int, predicted_ingredients array<struct<description: string, role: string, rationale: string, ref_title: string>>")
    m = spark.createDataFrame([("p", 0, 1, 1)], "paper_id string, claim_idx int, reference_idx int, predicted_idx int")
    assert rows(gr.predicted_tasks(p, m, t, 2), "predicted_idx", "covered", "target_ids", "leaked") == [(1, [1], [a, b], True)]
    assert rows(gr.predicted_tasks(p, m, t, 1), "leaked") == [(False,)]
    d = spark.createDataFrame([([("N/A", "r", "x", None), ("a", "…", "x", None), ("a", "r", None, None), ("a", "r", "x", None)],), ([],), (None,)], "i array<struct<description: string, role: string, rationale: string, ref_title: string>>")
    assert [len(x["c"]) if x["c"] is not None else None for x in d.select(gr.clean_ingredients(F.col("i")).alias("c")).collect()] == [1, 0, None]
    assert [x["c"] for x in d.select(gr.all_clean(F.col("i")).alias("c")).collect()] == [False, False, False]


CTX = "paper_id string, citing_paper_id string, id int, text string"


def test_brackets(spark):
    c = spark.createDataFrame([("p", "a", 1, "x [3, 4] y [3]"), ("p", "b", 1, "x [1] [2]"), ("p", "b", 2, "z [2]"), ("p", "b", 3, "[1] and [1; 2]"), ("p", "b", 4, "w [2]"), ("p", "c", 1, "[1] [2]"), ("p", "d", 1, None), ("p", "e", 1, "[5,6]"), ("p", "e", 2, "[6,5]"), ("p", "e", 3, "q [7]")], CTX)
    assert rows(cit.dominant_brackets(c), "citing_paper_id", "number") == [("a", "3"), ("b", "2"), ("e", "7")]
    c = spark.createDataFrame([("p", "e", 1, "[5,6]"), ("p", "e", 2, "[6,5]"), ("p", "f", 1, "[5,6]"), ("p", "f", 2, "x [7]"), ("p", "f", 3, "y [7,5,6]"), ("p", "f", 4, "[7] [5] [6]")], CTX)
    assert rows(cit.dominant_brackets(c), "citing_paper_id", "number") == [("f", "7")]


def test_marking(spark):
    cases = [
        ("As Smith et al. (2020) show [1].", "Smith", 2020, "Title X", None, "As <CITED HERE> show <CITED HERE>.", True),
        ("Smith and Smith et al. 2020 say", "Smith", 2020, "", None, "Smith and <CITED HERE> say", True),
        ("Li here", "Li", 2020, "", None, "Li here", False),
        ("we follow [2, 3] and [4]", "", None, "", "3", "we follow <CITED HERE> and [4]", True),
        ("the Big-Fast net works", "", None, "Big Fast Net: a thing", None, "the <CITED HERE> works", True),
        ("one [7] here", "", None, "", None, "one <CITED HERE> here", True),
        ("one [7] here", "", None, "", "8", "one [7] here", False),
        ("both [1, 2] here", "", None, "", None, "both [1, 2] here", False),
    ]
    d = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, t string, s string, y int, n string, b string")
    got = d.select("i", cit.marked(F.col("t"), F.col("s"), F.col("y"), F.col("n"), F.col("b")).alias("m")).orderBy("i").collect()
    assert [(r["m"]["text"], r["m"]["changed"]) for r in got] == [c[5:] for c in cases]
    assert [r["x"] for r in spark.createDataFrame([("<CITED HERE>, <CITED HERE> [<CITED HERE>] x",)], "t string").select(cit.collapsed(F.col("t")).alias("x")).collect()] == ["<CITED HERE> x"]


def test_contexts(spark):
    s = "array<struct<context: string, context_with_marker: string, intents: array<string>>>"
    d = spark.createDataFrame([([(" a ", None, ["x"]), ("", None, None)], ["z"]), ([], [" y ", " "]), (None, None)], f"w {s}, c array<string>")
    assert [[tuple(x) for x in r["o"]] for r in d.select(cit.contexts_of(F.col("w"), F.col("c")).alias("o")).collect()] == [[("a", ["x"]), ("", [])], [("y", [])], []]
    n = spark.createDataFrame([("p", 2, None, None, [("b",), (" ",)]), ("p", 1, "c1", "T", [("a",), ("a2",)])], "paper_id string, ord int, citing_paper_id string, citing_title string, contexts array<struct<text: string>>")
    assert rows(cit.numbered_contexts(n), "id", "citing_paper_id", "citing_title", "text") == [(1, "c1", "T", "a"), (2, "c1", "T", "a2"), (3, "", "Unknown citing paper", "b")]
    u = cit.usage_counters(spark.createDataFrame([("p", True, ["a"]), ("p", None, []), ("p", False, None)], "paper_id string, is_influential boolean, contexts array<string>")).first()
    assert tuple(u)[1:] == (3, 1, 1, 2, 1, 1)


def test_labels(spark):
    l = spark.createDataFrame([("p", "a", 1, "Motivation", "t"), ("p", "b", 2, "Uses", "t"), ("p", "b", 3, "Extends", "t"), ("p", None, 4, "CompareOrContrast", "u"), ("p", "", 5, "Future", "u")], "paper_id string, citing_paper_id string, id int, label string, citing_title string")  # noqa: E741
    c = cit.citing_labels(l)
    assert rows(c, "citing_paper_id", "label", "evidence_context_ids") == [("", "CompareOrContrast", [4]), ("a", "Background", []), ("b", "Extends", [3])]
    assert rows(cit.final_labels(c), "final_label") == [("Extends",)]
    p = spark.createDataFrame([([0.1, 0.7, 0.2],), ([1.0],)], "p array<double>")
    assert [tuple(round(v, 6) for v in r["m"]) for r in p.select(cit.confidence_margin(F.col("p")).alias("m")).collect()] == [(0.7, 0.5), (1.0, 1.0)]
    x = spark.createDataFrame([("p", 1), ("p", 2)], "paper_id string, id int")
    y = spark.createDataFrame([("p", 1, "uses", 0.9)], "paper_id string, id int, label string, confidence double")
    assert rows(cit.with_default_label(x, y), "id", "label", "confidence") == [(1, "Uses", 0.9), (2, "Background", 0.0)]


def test_verification(spark):
    c = spark.createDataFrame([("p", i, "Uses") for i in (1, 2, 3, 4)], "paper_id string, id int, label string")
    a = spark.createDataFrame([("p", 1, 0, "USES", "", ""), ("p", 2, 1, "USES", "cue", "r"), ("p", 2, 2, "EXTENDS", "cue", "r"), ("p", 4, 3, None, "cue", None)], "paper_id string, id int, ord int, label string, cue_span string, rationale string")
    v = cit.verified(c, a)
    assert rows(v, "id", "label", "original_label") == [(1, "NOT_CONFIRMED", "Uses"), (2, "EXTENDS", "Uses"), (3, "NOT_CONFIRMED", "Uses"), (4, "NOT_CONFIRMED", "Uses")]
    assert tuple(cit.verified_summary(v).first())[1:] == (4, 1, 1, 0, "EXTENDS")


def test_best_paragraph_against_all_pairs(spark):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("abcdefghij") for _ in range(n))
    cs = [("k%d" % (i % 2), i, text(r.randint(0, 6))) for i in range(12)]
    ps = [("k%d" % (i % 2), i, text(r.randint(0, 8))) for i in range(10)]
    c = spark.createDataFrame(cs, "citing_paper_id string, context_id int, text string")
    p = spark.createDataFrame(ps, "citing_paper_id string, p_idx int, paragraph string")
    want = []
    for k, i, t in cs:
        w = set(t.split())
        best = max(((len(w & set(q.split())) / len(w), -j) for kk, j, q in ps if kk == k), default=(0, 0)) if w else (0, 0)
        if w and best[0] >= 0.5:
            want.append((i, -best[1], round(best[0], 3)))
    assert rows(par.best_paragraphs(c, p), "context_id", "p_idx", "overlap") == sorted(want)


def test_confirmed_and_fallback(spark):
    c = spark.createDataFrame([("p", "a", 1, "One [1] two"), ("p", "a", 2, "one  two"), ("p", "b", 1, "x")], CTX)
    f = spark.createDataFrame([("p", "a", "ONE two"), ("p", "b", "y")], "paper_id string, citing_paper_id string, text string")
    assert rows(par.confirmed_contexts(c, f), "citing_paper_id", "text") == [("a", "One [1] two"), ("b", "y")]
    k = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "paper_id string, citing_paper_id string")
    one = spark.createDataFrame([("p", "a", ["x", "x"])], "paper_id string, citing_paper_id string, texts array<string>")
    two = spark.createDataFrame([("p", "a", ["z"]), ("p", "b", ["y"])], "paper_id string, citing_paper_id string, texts array<string>")
    assert rows(par.fallback_sources(k, one, two), "citing_paper_id", "texts", "source") == [("a", ["x"], "paragraphs"), ("b", ["y"], "usage_contexts")]


def test_target_keys_and_windows(spark):
    e = spark.createDataFrame([("p", "k1", "The Title", "Smith, J", "1999"), ("p", "k2", None, "Smith", "2020"), ("p", "k3", "Other", "Smith", "2020"), ("p", "k4", "Other", "Jones", "2020"), ("p", "k5", "Other", "Smith", "1990")], "paper_id string, bib_key string, title string, author string, year string")
    t = spark.createDataFrame([("p", "The title: more", "Smith", 2020)], "paper_id string, title string, surname string, year int")
    assert rows(par.target_keys(e, t), "bib_key") == [("k1",), ("k2",), ("k3",)]
    x = spark.createDataFrame([("p", "a" * 400 + r"\cite{k1}" + "b" * 400)], "paper_id string, text string")
    w = par.cited_windows(x, spark.createDataFrame([("p", "k1"), ("p", "zz")], "paper_id string, bib_key string")).collect()
    assert len(w) == 1 and w[0]["window"].startswith("a" * 350 + r"\cite{k1}")


CON = "paper_id string, ord int, label string, paper_claim string, cluster_key string, cluster_title string, rationale string"


def test_clusters(spark):
    c = spark.createDataFrame([("p", 0, "USES", "c0", " USES|a|b ", "", "r0"), ("p", 1, "NOT_CONFIRMED", "x", "USES|a|b", "", ""), ("p", 2, "EXTENDS", "c2", "", "T", "r2"), ("p", 3, "USES", "c3", "USES|a|b", "Z", "r3"), ("p", 4, "USES", "", "USES|a|b", "", "")], CON)
    assert rows(clu.exact_key_clusters(c), "cluster_id", "cluster_key", "cluster_title", "count", "members") == [(1, "USES|a|b", "Uses a for b", 2, [0, 3]), (2, "EXTENDS|contribution|unspecified", "T", 1, [2])]
    s = clu.support(c, ["paper_id"]).first()
    assert (s["examples"], s["rationales"], s["uses_count"], s["extends_count"], s["member_count"]) == (["c0", "x", "c2"], ["r0", "r2"], 3, 1, 5)
    d = spark.createDataFrame([("p", 0, "USES|a|x"), ("p", 1, "EXTENDS|b|x"), ("p", 2, "bad"), ("q", 0, None)], "paper_id string, ord int, cluster_key string")
    assert rows(clu.dominant_keys(d, ["paper_id"]), "paper_id", "dominant_key") == [("p", "USES|a|x"), ("q", "USES|contribution|unspecified")]
    f = spark.createDataFrame([("USES", "c", "", "", "span"), ("USES", "c", "t", "k", ""), (None, "c", "", "", "span")], "label string, paper_claim string, cluster_title string, cluster_key string, evidence_span string")
    assert [tuple(r)[:4] for r in clu.contribution_fields(f).collect()] == [("USES", "c", "c", "USES|contribution|unspecified"), ("NOT_CONFIRMED", "", "", ""), ("NOT_CONFIRMED", "c", "", "")]


def test_refinement(spark):
    c = spark.createDataFrame([("p", f"C{i}", i, f"USES|k{i}|x", f"T{i}", [i]) for i in (1, 2, 3, 4)], "paper_id string, cluster_id string, ord int, cluster_key string, cluster_title string, members array<int>")
    kept = spark.createDataFrame([("p", 1, 0, "C3"), ("p", 1, 1, "C1"), ("p", 2, 0, "C3"), ("p", 2, 1, "C2"), ("p", 2, 2, "C9")], "paper_id string, `group` int, position int, cluster_id string")
    dropped = spark.createDataFrame([("p", 0, "C2", " ")], "paper_id string, position int, cluster_id string, reason string")
    d = clu.normalised_decisions(c, kept, dropped)
    assert rows(d.fillna(-1, ["group"]), "cluster_id", "group") == [("C1", 1), ("C2", -1), ("C3", 1), ("C4", 1_000_004)]
    m = clu.merged_clusters(c, d)
    assert rows(m, "cluster_id", "cluster_key", "cluster_title", "members", "source_cluster_ids") == [(1, "USES|k1|x", "T1", [1, 3], ["C1", "C3"]), (2, "USES|k4|x", "T4", [4], ["C4"])]


def test_progress(spark):
    t = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), (None, 0, 3), ("a", 1, 4)], "paper_id string, claim_idx int, ord int")
    done = spark.createDataFrame([("a", 0), (None, 0)], "paper_id string, claim_idx int")
    assert rows(progress.pending(t, done, ["paper_id", "claim_idx"]), "ord") == [(2,), (3,), (4,)]
    assert rows(progress.first_entities(t, "paper_id", "ord", 1), "ord") == [(1,), (4,)]
    assert progress.first_entities(t, "paper_id", "ord", 0).count() == 4
    got = {(r["paper_id"], r["claim_idx"]): [] for r in t.collect()}
    for r in progress.few_shots(t, t, 2).orderBy("shot").collect():
        got[r["paper_id"], r["claim_idx"]].append(r["ord"])
    assert got == {("a", 0): [2, 3], ("b", 0): [1, 3], (None, 0): [1, 2], ("a", 1): [1, 2]}
    ref = spark.createDataFrame([("p", i, i < 5) for i in range(40)] + [("q", i, False) for i in range(40)], "paper_id string, ord int, is_influential boolean")
    assert rows(progress.shown_references(ref).groupBy("paper_id").count(), "paper_id", "count") == [("p", 5), ("q", 30)]


def test_plans(spark):
    r = spark.createDataFrame([("p", 0, '{"labels": [{"id": 3, "label": "USES", "cue_span": "c", "rationale": ""}]}'), ("p", 1, "broken")], "paper_id string, batch int, response string")
    assert rows(silver.verification_answers(r), "id", "label") == [(3, "USES")]
    c = spark.createDataFrame([("p", "z", '{"label": "USES", "claim": "c", "evidence_span": "e"}'), ("p", "y", "no")], "paper_id string, citing_paper_id string, response string")
    assert rows(silver.contributions(c), "citing_paper_id", "label", "cluster_key") == [("y", "NOT_CONFIRMED", ""), ("z", "USES", "USES|contribution|unspecified")]
    p = spark.createDataFrame([("a",), ("b",)], "paper_id string")
    assert rows(silver.stop_reasons(p, [("contexts", p), ("labels", p.where("paper_id = 'a'"))]), "paper_id", "stopped_after") == [("a", None), ("b", "labels")]
    k = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, "z")], "paper_id string, candidate int, response string")
    j = spark.createDataFrame([("p", '{"selected_index": 7}')], "paper_id string, response string")
    assert rows(annotation.chosen(k, j), "paper_id", "response") == [("p", "y"), ("q", "z")]


def test_payload_rules(spark):
    payload = {"target_paper_id": "p", "claims": [{"claim_id": "C1", "text": "a", "rewritten_claim": "b", "decision": "YES_SUFFICIENT", "enabling_discoveries": [{"ingredient_id": "I1"}], "ingredients": [{"ingredient_id": "I1", "canonical_ref_id": "__NONE__", "canonical_grounding": {"ref_id": "x"}, "additional_ref_ids": ["q"], "additional_groundings": [], "canonical_annotation": {"role": None, "roles": ["DATA_SOURCE"]}}]}]}
    schema = "target_paper_id string, claims array<struct<claim_id: string, text: string, rewritten_claim: string, decision: string, enabling_discoveries: array<struct<ingredient_id: string>>, ingredients: array<struct<ingredient_id: string, canonical_ref_id: string, canonical_grounding: struct<ref_id: string>, additional_ref_ids: array<string>, additional_groundings: array<struct<ref_id: string>>, canonical_annotation: struct<role: string, roles: array<string>>>>>>"
    d = spark.createDataFrame([(json.dumps(payload),)], "v string").select(F.from_json("v", f"struct<{schema.replace('target_paper_id string', 'target_paper_id: string').replace('claims array', 'claims: array')}>").alias("v")).select("v.*")
    assert sorted(r["rule"] for r in annotation.payload_violations(d).collect()) == ["additional_ref_ids differ from the groundings", "discovery without a reference", "grounding without a reference", "role differs from the one of roles", "text differs from rewritten_claim"]
    s = spark.createDataFrame([("p", 0, "A", [("A", 3), ("B", 11)])], "paper_id string, selected_index int, selected_candidate_id string, scores array<struct<candidate_id: string, score: int>>")
    assert sorted(r["rule"] for r in annotation.judge_violations(s).collect()) == ["chosen candidate is not the best scored", "score out of 1..10"]


PAYLOADS = [
    ('{"rewritten_claims": [null, {"ingredients": [{"candidate_studies_considered": ["A", null, {"study": "B"}], "additional_groundings": {"ref_id": "x"}}]}]}', {("claim", 1, -1, -1), ("ingredient", 1, 0, -1), ("candidate", 1, 0, 0), ("candidate", 1, 0, 2), ("grounding", 1, 0, 0)}),
    ('So:\n```json\n{"claims": {"enabling_contributions": "[{\\"candidate_studies_considered\\": \\"plain\\"}]"}}\n```', {("claim", 0, -1, -1), ("ingredient", 0, 0, -1), ("candidate", 0, 0, 0)}),
    ('Result {final}: {"rewritten_claims": [{"claim_id": "C1"}]} bye', {("claim", 0, -1, -1)}),
    (json.dumps(json.dumps({"rewritten_claims": ["text"]})), {("claim", 0, -1, -1)}),
    ('﻿{"rewritten_claims": null}', set()),
    ('{"rewritten_claims": [{"claim_id": "C1"}, {"clai', set()),
    ("null", set()), ("", set()), (None, set()), ("[]", set()), ("[" * 100_000, set()),
]


def test_nested(spark):
    d = spark.createDataFrame([(i, p, "x") for i, (p, _) in enumerate(PAYLOADS)] + [(0, PAYLOADS[0][0], "again")], "output_id long, payload string, node_id string")
    got = {(r["output_id"], r["level"], r["claim_pos"], r["ingredient_pos"], r["child_pos"]) for r in nested.elements(d).collect()}
    assert got == {(i, *e) for i, (_, es) in enumerate(PAYLOADS) for e in es}
    assert nested.elements(d.limit(0)).count() == 0


def test_nested_stores_once(spark):
    same = '{"rewritten_claims": [{"claim_id": "C1", "ingredients": [{"ingredient": "x"}, {"ingredient": "x"}]}]}'
    d = spark.createDataFrame([(1, same), (2, same.replace(": ", ":")), (3, '{"rewritten_claims": [{"ingredients": [{"ingredient": "x"}, {"ingredient": "x"}], "claim_id": "C1"}]}')], "output_id long, payload string")
    t = nested.shred(d, "output_id", "payload")
    assert t.roots.select("node_id").distinct().count() == 1 and t.nodes.where("level = 'ingredient'").count() == 1 and t.bridge.count() == 3
    assert nested.occurrences(t, "output_id").count() == 9
    assert rows(nested.flat_table(t, "claim"), "claim_id") == [("C1",)]
    p = spark.createDataFrame([(1, '{"rewritten_claims": [{"ingredients": [{"candidate_studies_considered": ["say \\"hi\\""]}]}]}')], "output_id long, payload string")
    assert rows(nested.flat_table(nested.shred(p, "output_id", "payload"), "candidate"), "study", "why") == [('say "hi"', None)]


json_values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=2), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("ab", max_size=2), c, max_size=3), max_leaves=8)


@settings(max_examples=100, deadline=None)
@given(json_values)
def test_identity_is_of_the_value(v):
    record = {"rewritten_claims": [v], "k": v}
    shuffled = json.loads(json.dumps(record, sort_keys=True))
    a, b = {}, {}
    assert nested.shredded(record, nested.REASONING, a, {}) == nested.shredded(shuffled, nested.REASONING, b, {}) and a == b
    assert nested.find_record("x " + json.dumps(record) + " y") == record


def test_words_agree_with_sql_words(spark):
    assert [r["w"] for r in spark.createDataFrame([("A b",)], "t string").select(plain_words(F.col("t")).alias("w")).collect()] == [["a", "b"]]


def test_reranking_shuffles_no_candidates(spark):
    """Hits cross the network as places of titles, a row per query; candidates are fused, ranked and reranked where these are opened."""
    from pathwright.plans import grounding
    from pathwright.sources import providers

    claim = [(f"p{i}", 0, m, f"fast parser of kind {i}", ["a"], [["a"]], [f"neural parser {i}", "slow trees"]) for i in range(20) for m in ("B1", "B3")]
    tasks = spark.createDataFrame(claim, "paper_id string, claim_idx int, mode string, claim string, target_ids array<string>, target_ingredient_groups array<array<string>>, basis array<string>")
    corpus = spark.createDataFrame([(f"t{i:02d}", f"neural parser of slow kind {i}", None) for i in range(40)], "hit_paper_id string, title string, year int")
    got = reference._reranked(tasks, grounding.fused(tasks, lambda q: providers.lexical_search(q, corpus)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and ("mode#" in x or "cand_paper_id" in x or "hit_paper_id" in x)]
    scores = got.groupBy(*cand.CLAIM).agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.max("llm_score").alias("best")).collect()
    assert len(scores) == 40 and all(x["n"] == x["last"] >= 20 and x["best"] >= 2 for x in scores)


def test_ranked_is_fused_search(spark):
    """Hits fused as they are found, as arrays of numbers, are those fused from a table of hits: with equal titles, an id that says nothing, and a cut."""
    from pathwright.plans import grounding
    from pathwright.sources import providers

    r = random.Random(5)
    text = lambda n: " ".join(f"w{int(r.paretovariate(0.7)) % 40}" for _ in range(n))
    claims = [(f"p{i % 17}", i, m, text(9), [text(r.randrange(7)) if r.random() < 0.9 else None for _ in range(r.randrange(6))] if m == "B3" else None) for i in range(40) for m in ("B1", "B3")]
    tasks = spark.createDataFrame([*claims, ("q", 0, "B1", "unknown", None), ("q", 1, "B1", None, None)], "paper_id string, claim_idx int, mode string, claim string, basis array<string>")
    titles = [(f"t{i % 90:02d}" if i else "", text(5) if i % 4 else "w1 w2 W3", 2000 + i % 3) for i in range(90)]
    corpus = spark.createDataFrame(titles, "hit_paper_id string, title string, year int")
    names = (*cand.CLAIM, "cand_paper_id", "paper_title", "year", "best_rank", "frequency", "deterministic_score", "rank")
    for k, most in ((6, 100), (20, 7)):
        want = rows(grounding.fused(tasks, lambda q, k=k: providers.lexical_search(q, corpus, k), most=most), *names)
        assert rows(grounding.ranked(tasks, corpus, k=k, most=most), *names) == want and len(want) > 400
    old, providers.INDEX_POSTINGS = providers.INDEX_POSTINGS, 0
    try:
        assert rows(grounding.ranked(tasks, corpus, k=k, most=most), *names) == want
    finally:
        providers.INDEX_POSTINGS = old


def test_reranking_splits_titles_once(spark):
    """The words of a title are split once, not for every candidate, and those it shares with the claim are looked for once a candidate."""
    plan = reference.queries()["llm_rerank_modes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1 and plan.count("[^a-z0-9") == 1
