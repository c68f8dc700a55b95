"""Column functions against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pathwright.functions import bibliographic as bib, ids, jsonx, latex, text
from pathwright.functions.words import words
from pathwright.queries import reference


def one(spark, column, **values):
    """The value of a column over one row of string values."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def many(spark, f, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_paper_ids(spark):
    same = ["2203.99753", "arXiv: 2203.99753", "ARXIV:2203.99753", "arxiv.2203.99753", "2203.99753v4", "2203.99753 ", "https://preprints.example/abs/2203.99753", "http://www.preprints.example/pdf/2203.99753v3.pdf", "10.48550/arXiv.2203.99753"]
    assert set(many(spark, ids.canonical_paper_id, same)) == {"arxiv:2203.99753"}
    hexid = "e873cfb4718958b2731dcc1d836ea3388ef51861"
    assert set(many(spark, ids.canonical_paper_id, [hexid, hexid.upper(), "S2:" + hexid, "https://graph.example/paper/" + hexid])) == {"s2:" + hexid}
    assert set(many(spark, ids.canonical_paper_id, ["10.5555/jag.1", "10.5555/JAG.1", "doi:10.5555/jag.1", "DOI 10.5555/jag.1", "https://doi.example/10.5555/jag.1"])) == {"doi:10.5555/jag.1"}
    assert set(many(spark, ids.canonical_paper_id, ["2019.glot-main.7", "2019.GLOT-MAIN.7", "ACL:2019.glot-main.7", "2019.glot-main.7.pdf", "https://anthology.example/2019.glot-main.7/"])) == {"acl:2019.glot-main.7"}
    assert many(spark, ids.canonical_paper_id, [None, "", " ", "N/A", "null", "unknown", "-"]) == [None] * 7
    assert many(spark, ids.canonical_paper_id, ["17"]) == ["raw:17"]


def test_surnames(spark):
    want = {"Havik Tuvik and Ola Ex": ["tuvik", "ex"], "H. Tuvik and O. Ex and P. Ny": ["tuvik", "ex", "ny"], "Tuvik, H.; Ex, O.": ["tuvik", "ex"], "Havik Tuvik, Ola Ex": ["tuvik", "ex"], "Tuvik, Havik": ["tuvik"], "Tuvik, H.": ["tuvik"], "Tuvik et al.": ["tuvik"], "Tuvik": ["tuvik"], "Wyškeri, O.": ["wyskeri"], "": [], None: []}
    assert many(spark, bib.surnames, list(want)) == list(want.values())


def test_title_key(spark):
    assert many(spark, bib.title_key, ["{Léarning}: A s​urvey!", "  ", None, "漢字"]) == ["learning a survey", None, None, "漢字"]


def test_title_leaked(spark):
    d = spark.createDataFrame([("uses the Parser of X", "Parsers and parse"), ("uses the parser", "A parser"), (None, "Parser"), ("x", None), ("x", "")], "d string, t string")
    assert [r["x"] for r in d.select(text.title_leaked(F.col("d"), F.col("t")).alias("x")).collect()] == [True, True, False, False, False]


def test_snippet(spark):
    long = "word " * 80
    assert one(spark, text.snippet(F.col("t"), F.col("a")), t=" ", a="an  abstract\n here") == "an abstract here"
    cut = one(spark, text.snippet(F.col("t"), F.col("a")), t=long, a="x")
    assert cut == ("word " * 60).rstrip() + "..."
    assert one(spark, text.snippet(F.col("t"), F.col("a"), most=10), t="a" * 30, a="x") == "a" * 10 + "..."
    assert one(spark, text.snippet(F.col("t"), F.col("a"), mode="none"), t="x", a="y") == ""


def test_fallback_queries(spark):
    d = spark.createDataFrame([("a b c", ["x", "", None, "y"]), ("a b c", []), ("a b c", None), (" ".join(map(str, range(30))), ["q"] * 9)], "c string, b array<string>")
    got = [r["x"] for r in d.select(text.fallback_queries(F.col("c"), F.col("b"), 3).alias("x")).collect()]
    assert got[0] == ["x", "a b c"]
    assert got[1] == got[2] == ["a b c", "a b c"]
    assert got[3] == ["q", "q", "q"]


def test_paragraphs_and_words(spark):
    assert one(spark, text.paragraphs(F.col("t")), t="a\r\n\r\n b \n \n\nc\nd\n\n") == ["a", "b", "c\nd"]
    assert one(spark, text.plain_words(F.col("t")), t="A-b c_2 é") == ["a", "b", "c", "2"]
    assert many(spark, text.match_key, ["A <CITED HERE> b [1, 2]  C", None]) == ["a b c", None]


def test_slugs(spark):
    assert many(spark, text.slug, ["a b/c", "--", "é", "a--b"]) == ["a-b-c", "run", "run", "a-b"]
    assert many(spark, text.result_slug, ["predictions_final_capability_s1_org_m1__judge_x", "predictions_final_a.b:c"]) == ["org-m1", "a-b-c"]
    assert [tuple(x) for x in many(spark, text.selector, ["p:3", "p", "a:b:0"])] == [("p", 3), ("p", None), ("a:b", 0)]


def test_types(spark):
    assert many(spark, text.claim_type, ["dataset: x", "no prefix here: x", "", None]) == ["Dataset", "Unknown", "Unknown", "Unknown"]
    d = spark.createDataFrame([("Dataset", ["USES|corpus|x"]), ("Dataset", ["USES|dataset|x"]), ("Dataset", ["USES"]), ("Other", ["USES|tool|x"]), ("Dataset", None)], "k string, c array<string>")
    assert [r["x"] for r in d.select(text.type_coverage(F.col("k"), F.col("c")).alias("x")).collect()] == [0.5, 1.0, 0.0, 0.0, 0.0]
    d = spark.createDataFrame([("benchmark", "Metric"), ("tool", "Tool "), ("tool", "x")], "a string, b string")
    assert [r["x"] for r in d.select(text.type_match(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, 1.0, 0.0]
    assert many(spark, text.cluster_title, ["USES|data_set|x_y", "extends|a|b", "k", None]) == ["Uses data set for x y", "Extends a for b", "k", ""]


def test_aliases(spark):
    assert many(spark, text.title_aliases, ["Big Fast Net: an ABC", "plain"]) == [["Big Fast Net: an ABC", "Big Fast Net", "BFNABC"], ["plain"]]
    assert many(spark, text.loose_pattern, ["a-b c", "--"]) == [r"(?i)\ba[-\s]*b[-\s]*c\b", None]


def test_arxiv_ids(spark):
    assert many(spark, text.arxiv_id_in, ["see arXiv:2101.00001v2 x", "none"]) == ["2101.00001v2", None]
    assert many(spark, text.parsed_arxiv_id, ["https://arxiv.org/abs/2101.00001v3", "https://arxiv.org/pdf/2101.00001.pdf", "2101.00001", "cs/0101001", "x"]) == ["2101.00001", "2101.00001", "2101.00001", "cs/0101001", None]


def test_latex(spark):
    assert one(spark, latex.plain(F.col("t")), t=r"A \cite[p. 1]{x} \textbf{b} $c$ % d") == "A b c"
    assert one(spark, latex.without_comments(F.col("t")), t="50\\% of % gone\n\\begin{comment}\nx\n\\end{comment}z \\\\% kept") == "50\\% of \nz \\\\% kept"
    s = one(spark, latex.sections(F.col("t")), t=r"pre \section{Intro}a \section*{Related Work}b")
    assert [(x["title"], x["body"], x["key"]) for x in s] == [("Intro", "a ", "intro"), ("Related Work", "b", "related work")]
    assert one(spark, latex.best_section(F.col("t"), "related"), t=r"\section{Intro}a\section{Related Work}b") == "b"
    assert one(spark, latex.cited_keys(F.col("t")), t=r"\cite{a, b} \citep[x]{c}") == ["a", "b", "c"]


def test_comments_go_in_every_language(spark, tmp_path):
    langs = ["en", "EN", "en-GB", None, "und", "de", "zh"]
    rows = [(i, f"text {i} 5\\% % note\nend", lang) for i, lang in enumerate(langs)] + [(90, None, "en"), (91, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["text"] for x in reference.comment_strip(spark, str(tmp_path)).collect()}
    assert got == {i: f"text {i} 5\\% \nend" for i in range(len(langs))} | {91: ""}


def test_mark_target(spark):
    d = spark.createDataFrame([(r"x \cite{k1,z} y \citep{smith2019a} w \cite{smith2030}", ["k1"], "Smith", 2020), (r"\cite{a}", [], None, None)], "t string, k array<string>, s string, y int")
    got = [r["x"] for r in d.select(latex.mark_target(F.col("t"), F.col("k"), F.coalesce("s", F.lit("")), F.col("y")).alias("x")).collect()]
    assert got == [r"x <CITED HERE> y <CITED HERE> w \cite{smith2030}", r"\cite{a}"]


def test_bib_entries():
    text_ = '@article{k1, title = {A {nested} title}, author="X and Y", year = 2020}\n@misc{k2,\n title={t}\n'
    got = list(latex.bib_entries(text_))
    assert got[0] == ("article", "k1", {"title": "A {nested} title", "author": "X and Y", "year": "2020"})
    assert got[1][1:] == ("k2", {"title": "t"})
    assert list(latex.bib_entries(None)) == [] and list(latex.bib_entries("@string{x}")) == []


def test_json(spark):
    q = lambda v: jsonx.parsed(v, "struct<queries: array<string>>")["queries"]
    assert many(spark, q, ['```json\n{"queries": ["a"]}\n```', 'So: {"queries": ["b"]} ok?', "broken {", None]) == [["a"], ["b"], None, None]
    items = lambda v: jsonx.parsed_list(v, "scores", "struct<id: string>")
    assert [None if x is None else [y["id"] for y in x] for x in many(spark, items, ['{"scores": [{"id": "1"}]}', '[{"id": "2"}]', 'x [{"id": "3"}] y [', "-"])] == [["1"], ["2"], ["3"], None]
    assert many(spark, jsonx.covered_flag, ['{"covered": true}', '{"Covered": FALSE, broken', "x"]) == [True, False, None]
    assert many(spark, jsonx.score_value, ['{"score": 3}', "Score: 2 because", "x"]) == [3, 2, None]
    assert many(spark, jsonx.clamped_score, ["4", "9", "-2", "4.9", "x", None]) == [4, 5, 0, 4, 0, 0]


@pytest.mark.parametrize("given, want", [(None, []), ("", []), ("Soärsake-2 \\textbf{Bold} [12] \\cite{x}", ["soarsake", "2", "bold"]), ("cita-\ntion", ["citation"]), ("a​b", ["ab"])])
def test_words(given, want):
    assert words(given) == want


def test_prompts_and_schemas(spark):
    from pyspark.sql.types import StructType

    from pathwright import schemas
    from pathwright.functions import prompts

    for ddl in schemas.TABLES.values():
        assert isinstance(StructType.fromDDL(ddl), StructType)
    d = spark.createDataFrame([("e", "B1", [("p1", None, 2020, 1.5, 1, 1, "")], ["a", None], "r")], "e string, m string, c array<struct<paper_id: string, title: string, year: int, deterministic_score: double, best_rank: int, frequency: int, snippet: string>>, l array<string>, r string")
    p = d.select(
        prompts.scores(F.col("e"), prompts.coverage_rule(F.col("m")), F.col("c")).alias("s"), prompts.queries(F.col("e"), 5).alias("q"), prompts.lines(F.col("l")).alias("l"), prompts.repair(F.col("r"), "{}").alias("r"),
        prompts.reference_recall(F.col("r"), F.col("l")).alias("rr"), prompts.choice(F.col("l")).alias("ch"), prompts.refinement(F.col("e"), F.col("c")).alias("re"), prompts.contribution(F.col("e"), F.col("r"), F.col("l")).alias("co"),
        prompts.verification(F.col("e"), F.col("r"), F.lit(2020), F.array(F.struct(F.lit(1).alias("id"), F.lit("t").alias("text")))).alias("v"), prompts.alignment(F.col("e"), F.col("r")).alias("al"), prompts.formatting(F.col("r")).alias("f"), prompts.reasoning(F.struct("e", "m")).alias("rs"),
    ).first()
    assert all(p) and p["l"] == "1. a\n2. " and '"title":""' in p["s"] and "snippet" not in p["s"] and "id 1: t" in p["v"]
