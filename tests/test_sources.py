"""Readers, providers and sinks over files made here."""

from __future__ import annotations

import gzip
import io
import json
import math
import random
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathwright.sources import exports, providers, sinks, tex
from pathwright.streaming import claims as stream


def test_exports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"target_paper_id": "p", "claim_idx": 2, "conference_year": 2024, "target_contribution": "", "rewritten_claim": "c", "enabling_contributions": []}, {"idx": 0, "target_contribution": "blind"}, {"target_paper_id": "q", "conference_year": 2023, "claims": [{"rewritten_capability": "x"}, {"target_contribution": "y"}, {}]}]))
    e = exports.read_export(spark, str(tmp_path / "a.json"))
    got = sorted(tuple(r)[:3] for r in exports.claim_tasks(e).collect())
    assert got == [("0", 0, "blind"), ("p", 2, "c"), ("q", 0, "x"), ("q", 1, "y")]
    assert exports.claim_tasks(e, year=2024).count() == 1
    (tmp_path / "p.json").write_text(json.dumps({"summary": {}, "papers": [{"paper_id": "p", "predicted_ingredients": [{"description": "d", "role": "r", "rationale": "x"}]}, {"paper_id": "q", "claim_idx": 1, "error": "e"}]}))
    p = exports.read_predictions(spark, str(tmp_path / "p.json"))
    assert sorted((r["paper_id"], r["claim_idx"]) for r in p.collect()) == [("p", 0), ("q", 1)]
    assert [r["paper_id"] for r in exports.finished_predictions(p).collect()] == ["p"]
    (tmp_path / "i.json").write_text('["a", {"id": "b", "id_type": "ACL"}]')
    ids = exports.read_ids(spark, str(tmp_path / "i.json"))
    assert sorted(tuple(r) for r in ids.collect()) == [(0, "a", ""), (1, "b", "ACL")]
    assert exports.start_from(ids, "b").count() == 1 and exports.start_from(ids, None).count() == 2


def test_active_claims(spark):
    d = spark.createDataFrame([([("C2", "x"), ("C1", "y")], None, 5), ([("C2", "x"), ("C1", "y")], "C2", 1), ([("C2", "x")], None, 3)], "c array<struct<claim_id: string, text: string>>, a string, i int")
    assert [r["x"] and r["x"]["text"] for r in d.select(exports.claim_at(F.col("c"), F.col("i"), F.col("a")).alias("x")).collect()] == ["y", "y", None]


def _tar(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in files.items():
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    pad = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=4000))
    (tmp_path / "p1.tar.gz").write_bytes(_tar({"main.tex": "\\begin{document}\\input{sec/a}\\input{sec/a}" + pad, "sec/a.tex": "A", "b.bib": "@x{k,}", "../evil.tex": "no", "a.tex": "first"}))
    (tmp_path / "p2.gz").write_bytes(gzip.compress(("\\documentclass " + pad).encode()))
    (tmp_path / "p3.gz").write_bytes(b"short")
    f = tex.read_archives(spark, str(tmp_path))
    assert sorted((r["paper_id"], r["path"]) for r in f.collect()) == [("p1", "a.tex"), ("p1", "b.bib"), ("p1", "main.tex"), ("p1", "sec/a.tex"), ("p2", "main.tex")]
    for recursive in (False, True):
        assert sorted(tuple(r) for r in tex.main_files(f, recursive).collect()) == [("p1", "main.tex"), ("p2", "main.tex")]
    t = {r["paper_id"]: r["text"] for r in tex.processed_texts(f, tex.main_files(f)).collect()}
    assert t["p1"].startswith("\\begin{document}A% input again: sec/a.tex")
    assert [r["bibliography"] for r in tex.bibliographies(f).collect()] == ["@x{k,}"]


def test_recorded_and_live(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b"), (3, "bad")], "i int, prompt string")
    r = spark.createDataFrame([("s", __import__("hashlib").sha256(b"a").hexdigest(), 1, "ra", None)], "stage string, prompt_sha string, attempt int, response string, error string")
    assert sorted((x["i"], x["response"], x["error"]) for x in providers.recorded(p, r, "s").collect()) == [(1, "ra", None), (2, None, "no recorded response"), (3, None, "no recorded response")]

    def make():
        def ask(text):
            if text == "bad":
                raise ValueError("broken")
            return text.upper()

        return ask

    got = sorted((x["i"], x["response"], x["error"]) for x in providers.completed(p, make).collect())
    assert got == [(1, "A", None), (2, "B", None), (3, None, "ValueError: broken")]


def test_retry():
    waits, calls = [], iter([Exception("429"), Exception("timeout"), "ok"])

    def f():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert providers.Retry(jitter=0, sleep=waits.append).call(f) == ("ok", None) and waits == [2.0, 4.0]
    assert providers.Retry(jitter=0).wait(9) == 60.0


def test_pages_and_lists(spark):
    p = spark.createDataFrame([("a", 2500), ("b", 1000), ("c", None)], "paper_id string, total int")
    assert sorted((r["paper_id"], r["offset"]) for r in providers.pages(p, "total").collect()) == [("a", 0), ("a", 1000), ("a", 2000), ("b", 0), ("c", 0)]
    f = spark.createDataFrame([("a", 1000, ["y"], None), ("a", 0, ["x"], ""), ("b", 0, ["z"], "failed")], "paper_id string, offset int, edges array<string>, error string")
    assert [tuple(r) for r in providers.whole_lists(f).collect()] == [("a", ["x", "y"])]


def test_search(spark):
    c = spark.createDataFrame([("t1", "fast parser trees", 2020), ("t2", "slow parser", None), ("t3", "cats", 1)], "hit_paper_id string, title string, year int")
    q = spark.createDataFrame([("p", 0, "B1", 1, "a fast PARSER"), ("p", 0, "B1", 2, "")], "paper_id string, claim_idx int, mode string, query_idx int, query string")
    assert sorted((r["rank"], r["hit_paper_id"], round(r["score"], 3)) for r in providers.lexical_search(q, c).collect()) == [(1, "t1", 1.0), (2, "t2", 0.398)]  # of the weights of the known terms


def test_resolution(spark):
    ids = spark.createDataFrame([("AbCdEfGh12", "openreview"), ("2101.00001", "ArXiv"), ("Some Title", ""), ("nothing", "")], "id string, id_type string")
    notes = spark.createDataFrame([("AbCdEfGh12", "2101.00009", "T")], "id string, arxiv_id string, title string")
    by_id = spark.createDataFrame([("2101.00009", "r9"), ("2101.00001", "r1")], "id string, record string")
    by_title = spark.createDataFrame([("some title", "rt")], "title string, record string")
    assert sorted((r["id"], r["record"], r["resolved_by"]) for r in providers.resolved_papers(ids, notes, by_id, by_title).collect()) == [("2101.00001", "r1", "id"), ("AbCdEfGh12", "r9", "note id"), ("Some Title", "rt", "title"), ("nothing", None, None)]
    n = spark.createDataFrame([('{"title": {"value": "T"}, "x": {"value": "see arXiv:2101.00009"}}',), ('{"title": "U"}',)], "c string")
    assert [tuple(r["f"]) for r in n.select(providers.note_fields(F.col("c")).alias("f")).collect()] == [("T", "2101.00009"), ("U", None)]


def test_rule_labels(spark):
    d = spark.createDataFrame([("We extend X",), ("Unlike X, we use it",), ("nothing",), (None,)], "text string")
    assert [r["label"] for r in providers.rule_labels(d).collect()] == ["Extends", "Uses", "Background", "Background"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1)], "k string, v int")
    path = str(tmp_path / "t")
    assert sinks.read_finished(spark, path, "k string, v int").count() == 0
    sinks.append_finished(d, path)
    sinks.append_finished(d, path)
    assert sinks.read_finished(spark, path, "k string, v int").count() == 2
    assert sinks.markdown(d) == "| k | v |\n|---|---|\n| a | 1 |"
    r = sinks.run_record(spark, "r1", {"model": "m"}).first()
    assert r["run_id"] == "r1" and r["settings"] == {"model": "m"} and r["started_at"].endswith("Z")
    sinks.write_results(d, d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "metrics")).count() == 1


def test_streaming(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int").write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        s = spark.readStream.schema("k string, v int").parquet(src)
        q = stream.process(s, lambda b: b.withColumn("w", F.col("v") + 1), out, chk, ["k"])
        q.awaitTermination(120)
    assert sorted((r["k"], r["w"]) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 3)]


# --- search


def _searched(spark, queries, titles, k=20):
    q = spark.createDataFrame([("p", i, "B1", 1, t) for i, t in enumerate(queries)], "paper_id string, claim_idx int, mode string, query_idx int, query string")
    c = spark.createDataFrame(titles, "hit_paper_id string, title string, year int")
    return {(r["claim_idx"], r["rank"]): (r["hit_paper_id"], round(r["score"], 9)) for r in providers.lexical_search(q, c, k).collect()}


def test_search_keeps_terms_that_stand_in_every_title(spark):
    titles = [(f"t{i:03d}", f"Neural parsing of the {i}th kind", 2000) for i in range(600)]
    got = _searched(spark, ["neural parsing", "unknown words only", "", "neural 17th"], titles)
    assert [got[0, r][0] for r in range(1, 21)] == [f"t{i:03d}" for i in range(20)] and got[3, 1][0] == "t017"
    assert {i for i, _ in got} == {0, 3} and _searched(spark, ["a"], []) == {}


def test_search_by_joins_is_search_by_index(spark):
    r = random.Random(4)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 300}"
    titles = [(f"t{i:03d}", " ".join(word() for _ in range(r.randrange(9))) if i % 50 else None, None) for i in range(400)]
    queries = [" ".join(word() for _ in range(r.randrange(1, 10))) for _ in range(60)]
    few = _searched(spark, queries, titles, 7)
    old, providers.INDEX_POSTINGS = providers.INDEX_POSTINGS, 0
    try:
        assert _searched(spark, queries, titles, 7) == few and len(few) > 200
    finally:
        providers.INDEX_POSTINGS = old


def test_failures_that_may_pass():
    calls = []

    def f(message):
        def g():
            calls.append(message)
            raise RuntimeError(message)

        return g

    retry = providers.Retry(attempts=3, sleep=lambda s: None)
    for message, n in (("RateLimitError: slow down", 3), ("ServiceUnavailable", 3), ("bad key", 1), ("overloaded", 3)):
        calls.clear()
        retry.call(f(message))
        assert len(calls) == n


def test_references_of_either_spelling(spark):
    from pathwright.sources.exports import with_reference_ids

    raw = spark.createDataFrame([(("",), ("s2a", {"ACL": "x"})), ((None,), (None, {"ArXiv": "1", "DOI": "2"})), (("own",), ("s2b", None)), ((None,), (None, None))], "r struct<ref_id: string>, s struct<paperId: string, externalIds: map<string,string>>")
    assert [x["ref_key"] for x in with_reference_ids(raw, "r", "s").collect()] == ["s2a", "1", "own", None]


def test_markdown_leaves_nothing_out_unseen(spark):
    assert sinks.markdown(spark.range(3), 3).count("\n") == 4
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(4), 3)


def test_matched_predictions_are_what_b4_matched_asks_with(spark):
    from pathwright.plans import grounding

    row = ("p", 0, "claim", ["t"], [["t"]], [("gold",)], [("first",), ("second",), ("third",)])
    ddl = "paper_id string, claim_idx int, claim string, target_ids array<string>, target_ingredient_groups array<array<string>>, gold_ingredients array<struct<enabling_contribution: string>>, predicted_ingredients array<struct<description: string>>"
    pairs = "matched_pairs array<struct<predicted_idx: int, match: string>>, recall_judgments array<struct<covered: boolean, best_match_idx: int>>"
    modes = ("B4", "B4_MATCHED")
    basis = lambda *more: {r["mode"]: r["basis"] for r in grounding.tasks_of(spark.createDataFrame([row + more], f"{ddl}, {pairs}"), modes).collect()}
    assert basis([(2, "FULL"), (1, "partial")], [(True, 3)]) == {"B4": ["first", "second", "third"], "B4_MATCHED": ["second"]}
    assert basis([(1, "partial")], [(True, 3), (False, 1)])["B4_MATCHED"] == ["third"] and basis(None, None)["B4_MATCHED"] == []
    with pytest.raises(ValueError):
        grounding.tasks_of(spark.createDataFrame([row], ddl), modes)


def test_marks_need_surname_and_year_in_one_key(spark):
    from pyspark.sql import functions as F
    from pathwright.functions.latex import mark_target

    texts = [r"\cite{smith2010,jones2020}", r"\citep {a,Smith2021x}", r"\cite{ own , b}", r"\cite{smith2018}", r"\cite{}"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [x["m"] for x in d.orderBy("i").select(mark_target(F.col("t"), F.array(F.lit("own")), F.lit("Smith"), F.lit(2020)).alias("m")).collect()]
    assert got == [texts[0], "<CITED HERE>", "<CITED HERE>", texts[3], texts[4]]
    one = d.where("i = 1").select(mark_target(F.col("t"), F.array().cast("array<string>"), F.lit("s"), F.lit(2020)).alias("m")).first()["m"]
    assert one == "<CITED HERE>"


def test_json_quoted_however_often(spark):
    import json

    from pathwright.operators.nested import decoded

    text = '{"claims": []}'
    for _ in range(9):
        text = json.dumps(text)
    assert decoded(text) == {"claims": []} and decoded('"x"') == "x"


def test_a_text_with_two_markers_is_not_changed_by_itself(spark):
    from pyspark.sql import functions as F
    from pathwright.operators.citations import marked

    d = spark.createDataFrame([("<CITED HERE> <CITED HERE> as is",), ("as [3] says",)], "t string")
    none = F.lit(None).cast("string")
    assert [x["c"] for x in d.select(marked(F.col("t"), F.lit(""), F.lit(None).cast("int"), F.lit(""), none)["changed"].alias("c")).collect()] == [False, True]


def test_best_paragraphs_against_all_pairs(spark):
    from pathwright.operators.paragraphs import best_paragraphs

    r = random.Random(6)
    word = lambda: f"w{int(r.paretovariate(0.5)) % 60}"
    text = lambda n: " ".join(word() for _ in range(r.randrange(n)))
    c = [("p", i, text(12)) for i in range(60)] + [("q", 900, "w1 w2"), ("p", 901, None)]
    p = [("p", i, text(25)) for i in range(60)] + [("z", 5, "w1 w2")]
    for least in (0.5, 1 / 3, 1.0):
        want = {}
        for k, i, t in c:
            ws = set((t or "").split())
            scored = [(len(ws & set(x.split())) / len(ws), -j) for kk, j, x in p if kk == k and ws]
            if scored and max(scored)[0] >= least:
                want[i] = (-max(scored)[1], round(max(scored)[0], 3))
        got = best_paragraphs(spark.createDataFrame(c, "citing_paper_id string, context_id int, text string"), spark.createDataFrame(p, "citing_paper_id string, p_idx int, paragraph string"), least=least)
        assert {x["context_id"]: (x["p_idx"], x["overlap"]) for x in got.collect()} == want


def test_best_paragraphs_in_blocks(spark, monkeypatch):
    """A paper in many blocks gives what it gives in one; pairs of contexts and paragraphs are not shuffled, only the best of a block."""
    from pathwright.operators import paragraphs as par

    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(12)}" for _ in range(r.randrange(1, 9)))
    c = spark.createDataFrame([("a", i, text()) for i in range(40)] + [("b", 99, "w1 w2")], "citing_paper_id string, context_id int, text string")
    p = spark.createDataFrame([("a", i, text()) for i in range(60)], "citing_paper_id string, p_idx int, paragraph string")
    whole = sorted(par.best_paragraphs(c, p).collect())
    monkeypatch.setattr(par, "BLOCK_WORDS", 50)
    monkeypatch.setattr(par, "BLOCK_TEXTS", 30)
    got = par.best_paragraphs(c, p)
    assert sorted(got.collect()) == whole and len(whole) > 30
    assert "_t#" not in got._jdf.queryExecution().executedPlan().toString()


def test_index_finds_the_best_of_many(spark):
    """Titles of common terms alone are left out where they cannot come among the best, and no others."""
    r = random.Random(6)
    titles = [(f"t{i:04d}", " ".join(["a", "for"][: r.randrange(3)] + [f"w{int(r.paretovariate(0.5)) % 500}" for _ in range(6)]), None) for i in range(3000)]
    found = providers.lexical_index(spark.createDataFrame(titles, "hit_paper_id string, title string, year int"))
    index = found[0].value
    queries = [[*{"a", "for", "unknown", *(f"w{int(r.paretovariate(0.5)) % 500}" for _ in range(r.randrange(7)))}] for _ in range(200)]
    asked, starts, places, weights, totals = index.search(pa.array([*queries, None, [], ["unknown"]]), 20)
    of = [set(t.split()) for _, t, _ in titles]
    df = {t: sum(t in w for w in of) for t in {t for w in of for t in w}}
    x = {t: round(1000 * math.log(1 + 3000 / n)) for t, n in df.items()}
    for i, q in enumerate([*queries, [], [], []]):
        scores = sorted((-sum(x[t] for t in q if t in w), p) for p, w in enumerate(of) if any(t in w for t in q))[:20]
        u = asked[i]
        assert [(-int(w), int(p)) for p, w in zip(places[starts[u] : starts[u + 1]], weights[starts[u] : starts[u + 1]])] == scores and totals[u] == sum(x.get(t, 0) for t in q)
