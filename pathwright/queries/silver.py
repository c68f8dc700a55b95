"""Queries of labelling, verification, clustering, matching and text operators over the test tables, with their SQL.

Answers of models are stood in for by rules over the rows, the same in the query and its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathwright.functions import latex, text
from pathwright.operators import candidates as cand, citations as cit, clusters as clu, metrics, paragraphs as par, progress
from pathwright.plans import grounding, judging, steps
from pathwright.queries import reference as ref
from pathwright.sources import exports
from pathwright.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def _marking(s: SparkSession, d: str) -> DataFrame:
    """Documents with a surname and a year out of their first citation key that is a name and a year."""
    t = load(s, d, "documents").where("text is not null").select("doc_id", "text")
    key = r"\\cite[a-zA-Z]*\s*\{(?:[^}]*,)?\s*([a-z]{3,12})[a-z]*(\d{4})[a-z]*"
    return t.withColumns({"surname": F.regexp_extract("text", key, 1), "year": F.nullif(F.regexp_extract("text", key, 2), F.lit("")).cast("int")}).where("year is not null")


def marked_targets(s: SparkSession, d: str) -> DataFrame:
    """How many citation commands of a document are the target's, with its marker set."""
    m = _marking(s, d).withColumn("m", latex.mark_target(F.col("text"), F.array().cast("array<string>"), F.col("surname"), F.col("year"), "\u0001"))
    return m.select("doc_id", "surname", "year", (F.length("m") - F.length(F.replace("m", F.lit("\u0001"), F.lit("")))).alias("n_marked"))


_MARKED_SQL = r"""WITH k AS (
  SELECT doc_id, text, regexp_extract(text, '\\cite[a-zA-Z]*\s*\{(?:[^}]*,)?\s*([a-z]{3,12})[a-z]*(\d{4})[a-z]*', 1) AS surname,
    TRY_CAST(regexp_extract(text, '\\cite[a-zA-Z]*\s*\{(?:[^}]*,)?\s*([a-z]{3,12})[a-z]*(\d{4})[a-z]*', 2) AS INT) AS year FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '\\cite[a-zA-Z]*\s*\{([^}]+)\}', 1)) AS g, surname, year FROM k WHERE year IS NOT NULL
), m AS (
  SELECT doc_id, surname, year, len(list_filter(string_split(g, ','), lambda x: contains(lower(x), surname) AND (contains(x, CAST(year AS VARCHAR)) OR contains(x, CAST(year - 1 AS VARCHAR)) OR contains(x, CAST(year + 1 AS VARCHAR))))) > 0 AS hit FROM g
)
SELECT doc_id, surname, year, count(*) FILTER (hit) AS n_marked FROM m GROUP BY ALL"""


def matched_basis(s: SparkSession, d: str) -> DataFrame:
    """What B4_MATCHED asks with: the predictions that a full edge ties to a gold contribution, in their order."""
    c, e = ref._edges(s, d)
    pairs = e.groupBy("paper_id", "claim_idx").agg(F.collect_list(F.struct("predicted_idx", "match")).alias("matched_pairs"))
    claims = ref._claims(s, d).join(pairs, ["paper_id", "claim_idx"])
    t = grounding.tasks_of(claims, ("B4_MATCHED",)).where(F.size("basis") > 0)
    return t.select("paper_id", "claim_idx", F.size("basis").alias("n"), F.array_join("basis", " / ").alias("basis"))


_MATCHED_SQL = f"""WITH {ref._EDGES_SQL}, hit AS (SELECT DISTINCT paper_id, claim_idx, predicted_idx FROM edges WHERE match = 'full')
SELECT paper_id, claim_idx, count(*) AS n, array_to_string(list(coalesce(predicted_ingredients[predicted_idx].description, chr(0)) ORDER BY predicted_idx) FILTER (predicted_ingredients[predicted_idx].description IS NOT NULL), ' / ') AS basis
FROM hit JOIN judged USING (paper_id, claim_idx) GROUP BY ALL"""


#: The greatest number of pairs is, over all sets of references, the least of those outside the set and the predictions that it reaches.
_JUDGED_SQL = f"""WITH {ref._EDGES_SQL}, near AS (
  SELECT paper_id, claim_idx, reference_idx, bit_or(1::BIGINT << (predicted_idx - 1)) AS reach FROM edges WHERE match = 'full' GROUP BY ALL
), sets AS (
  SELECT paper_id, claim_idx, n_reference, unnest(generate_series(0, (1::BIGINT << n_reference) - 1)) AS s FROM judged WHERE (paper_id, claim_idx) IN (SELECT (paper_id, claim_idx) FROM near)
), reached AS (
  SELECT sets.paper_id, sets.claim_idx, s, max(n_reference) - bit_count(s) + bit_count(coalesce(bit_or(reach), 0)) AS n
  FROM sets LEFT JOIN near ON sets.paper_id = near.paper_id AND sets.claim_idx = near.claim_idx AND (s >> (reference_idx - 1)) & 1 = 1 GROUP BY sets.paper_id, sets.claim_idx, s
), sizes AS (
  SELECT paper_id, claim_idx, min(n) AS m FROM reached GROUP BY ALL
), partial_ AS (
  SELECT paper_id, claim_idx, count(*) AS n FROM edges WHERE match = 'partial' GROUP BY ALL
), rows_ AS (
  SELECT j.paper_id, j.claim_idx, n_reference, n_predicted, coalesce(m, 0) AS n_matched, coalesce(p.n, 0) AS n_partial, coalesce(m, 0) / n_reference AS recall, CASE WHEN n_predicted > 0 THEN coalesce(m, 0) / n_predicted END AS precision
  FROM judged j LEFT JOIN sizes z USING (paper_id, claim_idx) LEFT JOIN partial_ p USING (paper_id, claim_idx)
)
SELECT *, CASE WHEN recall + precision = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 3) END AS f1 FROM rows_"""


def reference_judgments(s: SparkSession, d: str) -> DataFrame:
    """One row per reference: whether a maximum matching covers it; here only how many of each claim are covered."""
    from pathwright.operators import matching

    c, e = ref._edges(s, d)
    m = matching.judged(c.drop("gold_ingredients", "predicted_ingredients"), e)
    r = judging.reference_judgments(c, m.select("paper_id", "claim_idx", "matched"))
    return r.groupBy("paper_id", "claim_idx").agg(F.count("*").alias("n_reference"), F.count_if("covered").alias("n_matched"))


_REFERENCES_SQL = f"SELECT paper_id, claim_idx, n_reference, n_matched FROM ({_JUDGED_SQL})"


def _answers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Contexts that may be uses and answers about them: of three, one USES, one EXTENDS without a cue, one without an answer; asked twice, the last counts."""
    c = ref._labels(s, d).where(F.col("label").isin(*cit.USES)).select("paper_id", "id", "label", "text")
    a = c.where("id % 3 <> 2").select("paper_id", "id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), F.when(F.col("id") % 3 == 0, "USES").otherwise("EXTENDS").alias("label"), F.when(F.col("id") % 3 == 0, F.left("text", F.lit(20))).otherwise("").alias("cue_span"))
    return c, a.withColumn("label", F.when(F.col("ord") == 1, "EXTENDS").otherwise(F.col("label"))).withColumn("rationale", F.concat(F.lit("r"), F.col("ord").cast("string")))


def verified_contexts(s: SparkSession, d: str) -> DataFrame:
    return cit.verified(*_answers(s, d)).select("paper_id", "id", "original_label", "label", "cue_span", "rationale")


def verified_summary(s: SparkSession, d: str) -> DataFrame:
    return cit.verified_summary(cit.verified(*_answers(s, d)))


_VERIFIED_SQL = f"""WITH {ref._LABELS_SQL}, v AS (
  SELECT paper_id, id, label AS original_label, CASE WHEN id % 3 = 0 AND coalesce(text[1:20], '') <> '' THEN 'USES' ELSE 'NOT_CONFIRMED' END AS label, CASE WHEN id % 3 = 0 THEN coalesce(text[1:20], '') ELSE '' END AS cue_span, CASE WHEN id % 3 = 2 THEN '' ELSE 'r2' END AS rationale
  FROM labelled WHERE label IN ('Uses', 'Extends')
)"""


def confidence_margins(s: SparkSession, d: str) -> DataFrame:
    """Softmax over the first six components of each vector as class scores, the greatest and its distance to the next."""
    e = load(s, d, "embeddings").select("vec_id", cit.confidence_margin(cit.softmax(F.slice("embedding", 1, 6))).alias("_c"))
    return e.select("vec_id", F.round("_c.confidence", 6).alias("confidence"), F.round("_c.margin", 6).alias("margin"))


_MARGIN_SQL = """WITH x AS (SELECT vec_id, list_transform(embedding[1:6], lambda v: exp(CAST(v AS DOUBLE))) AS e FROM embeddings), p AS (SELECT vec_id, list_reverse_sort(list_transform(e, lambda v: v / list_sum(e))) AS p FROM x)
SELECT vec_id, round(p[1], 6) AS confidence, round(p[1] - p[2], 6) AS margin FROM p"""


def contribution_defaults(s: SparkSession, d: str) -> DataFrame:
    """Predicted contributions as extractors' answers; every fourth has no evidence span."""
    c = ref._contributions(s, d).withColumn("evidence_span", F.when(F.col("ord") % 4 == 3, "").otherwise("quote")).withColumn("cluster_key", F.when(F.col("ord") % 2 == 0, F.trim("cluster_key")).otherwise(""))
    return clu.contribution_fields(c).select("paper_id", "ord", "label", "paper_claim", "cluster_title", "cluster_key")


_CONTRIBUTION_SQL = f"""WITH {ref._CONTRIB_SQL}, x AS (
  SELECT paper_id, ord, ord % 4 <> 3 AS has, CASE WHEN ord % 4 = 3 THEN 'NOT_CONFIRMED' ELSE label END AS label, CASE WHEN ord % 4 = 3 THEN '' ELSE coalesce(paper_claim, '') END AS paper_claim, CASE WHEN ord % 4 <> 3 AND ord % 2 = 0 THEN k ELSE '' END AS k FROM contributions
)
SELECT paper_id, ord, label, paper_claim, CASE WHEN label = 'USES' THEN paper_claim ELSE '' END AS cluster_title, CASE WHEN label = 'USES' AND k = '' THEN 'USES|contribution|unspecified' ELSE k END AS cluster_key FROM x"""


def refined_clusters(s: SparkSession, d: str) -> DataFrame:
    """Clusters after decisions: the third of each paper dropped, the first two merged, the others never named and so kept."""
    c = clu.exact_key_clusters(ref._contributions(s, d)).withColumn("ord", F.col("cluster_id"))
    kept = c.where("cluster_id <= 2").select("paper_id", F.lit(1).alias("group"), F.col("cluster_id").alias("position"), "cluster_id")
    dropped = c.where("cluster_id = 3").select("paper_id", F.lit(1).alias("position"), "cluster_id", F.lit("").alias("reason"))
    m = clu.merged_clusters(c, clu.normalised_decisions(c, kept, dropped))
    join = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return m.select("paper_id", "cluster_id", "count", join("members").alias("members"), join("source_cluster_ids").alias("source_cluster_ids"))


_REFINED_SQL = f"""WITH base AS ({ref._CLUSTERS_SQL}), g AS (SELECT *, CASE WHEN cluster_id <= 2 THEN 1 ELSE cluster_id END AS grp FROM base WHERE cluster_id <> 3),
x AS (SELECT paper_id, grp, min(cluster_id) AS f, array_to_string(list(cluster_id ORDER BY cluster_id), ',') AS source_cluster_ids, list_sort(list_distinct(flatten(list(list_transform(string_split(members, ','), lambda v: CAST(v AS INT)))))) AS m FROM g GROUP BY ALL)
SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY f) AS cluster_id, len(m) AS count, array_to_string(m, ',') AS members, source_cluster_ids FROM x"""


def without_source(s: SparkSession, d: str) -> DataFrame:
    """Gold targets as hits, without a claim's first target, which is taken for the source itself."""
    c = ref._claims(s, d).where(F.size("target_ids") > 0)
    hits = c.select("paper_id", F.explode("target_ids").alias("hit_paper_id")).distinct()
    return cand.without_source(hits, c.select("paper_id", F.get("target_ids", F.lit(0)).alias("source_id"))).select("paper_id", "hit_paper_id")


_SOURCE_SQL = f"""WITH {ref._CLAIMS_SQL}, h AS (SELECT DISTINCT paper_id, target_ids[1] AS s, unnest(target_ids) AS hit_paper_id FROM claims WHERE len(target_ids) > 0)
SELECT paper_id, hit_paper_id FROM h WHERE s IS NULL OR hit_paper_id IS NULL OR hit_paper_id <> s"""


def shown_references(s: SparkSession, d: str) -> DataFrame:
    """References shown to a generator: contexts as references, with intents as influential; at least three influential ones are enough."""
    p = load(s, d, "paper_packages").groupBy("package_id").agg(F.min_by("citation_contexts", "built_at").alias("_c"))
    r = p.select(F.col("package_id").alias("paper_id"), F.posexplode("_c").alias("ord", "_x")).select("paper_id", "ord", F.coalesce(F.size("_x.intents") > 0, F.lit(False)).alias("is_influential"))
    return progress.shown_references(r, enough=3, most=4).select("paper_id", "ord", "is_influential")


_SHOWN_SQL = """WITH packages AS (SELECT package_id, citation_contexts AS c FROM paper_packages QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY built_at) = 1),
x AS (SELECT package_id AS paper_id, i - 1 AS ord, c[i] IS NOT NULL AND coalesce(len(c[i].intents), 0) > 0 AS is_influential FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM packages)),
n AS (SELECT *, count(*) FILTER (is_influential) OVER (PARTITION BY paper_id) AS k, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS r FROM x)
SELECT paper_id, ord, is_influential FROM n WHERE (k >= 3 AND is_influential) OR (k < 3 AND r <= 4)"""


def reference_contexts(s: SparkSession, d: str) -> DataFrame:
    """The first three non-blank contexts of each package, numbered."""
    p = load(s, d, "paper_packages").groupBy("package_id").agg(F.min_by("citation_contexts", "built_at").alias("_c"))
    one = F.transform("_c", lambda x: F.struct(x["text"].alias("text"), x["section"].alias("section"), x["intents"].alias("intents")))
    r = p.select(F.col("package_id").alias("paper_id"), F.lit(0).alias("ord"), F.lit("r").alias("ref_id"), F.lit("t").alias("title"), one.alias("contexts"))
    return par.reference_contexts(r, most=3).select("paper_id", "position", "text", "section")


_REFCONTEXT_SQL = """WITH packages AS (SELECT package_id, citation_contexts AS c FROM paper_packages QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY built_at) = 1),
x AS (SELECT package_id AS paper_id, i, c[i].text AS text, c[i].section AS section FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM packages))
SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY i) AS position, text, section FROM x WHERE coalesce(text, '') <> '' QUALIFY position <= 3"""


def bounded_search(s: SparkSession, d: str) -> DataFrame:
    """Listed papers of a venue as hits by input_id, up to 2015, five of each, ranked anew."""
    i = load(s, d, "input_ids").groupBy("input_id").agg(F.min_by(F.struct("venue", "year", "title"), "added_at").alias("_i"))
    h = i.select(F.coalesce("_i.venue", F.lit("")).alias("venue"), F.col("input_id").alias("rank"), F.col("input_id").alias("hit_paper_id"), "_i.year", "_i.title", F.array().cast("array<string>").alias("authors"))
    return cand.bounded_search(h, ["venue"], 5, F.lit(2015)).select("venue", "rank", "hit_paper_id", "year")


_BOUNDED_SQL = """WITH i AS (SELECT input_id, venue, year FROM input_ids QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY added_at) = 1)
SELECT coalesce(venue, '') AS venue, row_number() OVER (PARTITION BY coalesce(venue, '') ORDER BY input_id) AS rank, input_id AS hit_paper_id, year FROM i WHERE year IS NULL OR year <= 2015 QUALIFY rank <= 5"""


def slugs(s: SparkSession, d: str) -> DataFrame:
    """Parts of file names and selectors made of titles."""
    m = load(s, d, "paper_metadata")
    return m.select("paperId", "fetched_at", text.slug(F.col("title"), 40).alias("slug"), text.model_slug(F.col("venue")).alias("model_slug"), text.selector(F.concat("paperId", F.lit(":"), F.col("year").cast("string")))["claim_idx"].alias("claim_idx"))


_SLUG_SQL = r"""SELECT paperId, fetched_at, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(title, '[^A-Za-z0-9\-_.]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')[1:40], ''), 'run') AS slug, translate(venue, '/:_.', '----') AS model_slug,
  CASE WHEN length(paperId) > 0 THEN year END AS claim_idx FROM paper_metadata"""


def plain_latex(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").where("text is not null").select("doc_id", latex.plain(F.col("text")).alias("text"))


_PLAIN_SQL = rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '%[^\n]*', ' ', 'g'), '\\cite[a-z|]*\*?(?:\[[^\]]*\])*\{{[^}}]*\}}', ' ', 'g'), '\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{{([^{{}}]*)\}})?', '\1', 'g'), '[{{}}$]', ' ', 'g'), '{ref._SPACES}', ' ', 'g')) AS text
FROM documents WHERE text IS NOT NULL"""


def label_ids(s: SparkSession, d: str) -> DataFrame:
    return exports.label_ids(load(s, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey").withColumnRenamed("o_orderpriority", "label")


def comparison(s: SparkSession, d: str) -> DataFrame:
    """Scores, type matches and coverages of claims by source; an alignment score here is the claim's index, missing where it is above three."""
    c = ref._claims(s, d).join(ref.claim_types(s, d).select("paper_id", "claim_idx", "coverage", "match"), ["paper_id", "claim_idx"])
    return metrics.comparison_summary(c.select("source", F.when(F.col("claim_idx") <= 3, F.col("claim_idx")).alias("c1_score"), F.col("match").alias("c2_type_match"), F.col("coverage").alias("c4_type_coverage")), ["source"])


def model_queries(s: SparkSession, d: str) -> DataFrame:
    """Queries of a stand-in model for each claim and mode: of three claims, one gets a fenced answer with a blank query in it, one an answer that does
    not parse and is repaired in mode B1 only, one a failed call."""
    tasks = grounding.tasks_of(ref._claims(s, d))
    claims = ref._claims(s, d).select("paper_id", "claim_idx", "gold_ingredients", "predicted_ingredients")
    kind = F.pmod("claim_idx", F.lit(3))
    good = F.concat(F.lit('```json\n{"queries": [" about '), F.col("mode"), F.lit('", " ", "more"]}\n```'))
    call = lambda p: p.withColumn("response", F.when(kind == 0, good).when(kind == 1, '{"queries": [').otherwise(None)).withColumn("error", F.when(kind == 2, "timeout").otherwise(None))
    repair = lambda p: p.withColumn("response", F.when(F.col("mode") == "B1", F.lit('{"queries": ["repaired"]}'))).withColumn("error", F.lit(None).cast("string"))
    return steps.generated_queries(tasks.join(claims, ["paper_id", "claim_idx"]), call, 5, repair)


_MODEL_SQL = rf"""WITH {ref._FUSED_SQL.replace("FROM claims, (SELECT unnest(['B1', 'B3', 'B4']) AS mode) WHERE len(target_ids) > 0", "FROM claims, (SELECT unnest(['B1', 'B3', 'B4']) AS mode)")}, kinds AS (
  SELECT paper_id, claim_idx, mode, qs, ((claim_idx % 3) + 3) % 3 AS k FROM queried
), own AS (
  SELECT paper_id, claim_idx, mode, CASE WHEN k = 0 THEN ['about ' || mode, 'more'] WHEN k = 1 AND mode = 'B1' THEN ['repaired'] ELSE qs END AS qs,
    CASE WHEN k = 1 AND mode <> 'B1' THEN 'neither answer nor repair parses' WHEN k = 2 THEN 'timeout' END AS error FROM kinds
)
SELECT paper_id, claim_idx, mode, i AS query_idx, qs[i] AS query, error FROM (SELECT *, unnest(generate_series(1, len(qs))) AS i FROM own)"""


def queries() -> dict[str, Query]:
    every = (
        model_queries,
        marked_targets, matched_basis, reference_judgments, verified_contexts, verified_summary, confidence_margins, contribution_defaults, refined_clusters, without_source, shown_references, reference_contexts, bounded_search,
        slugs, plain_latex, label_ids, comparison,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    types = ref.oracle_sql()["claim_types"]
    rate = "round(count(*) FILTER ({0}) / {1}, 3)"
    return {
        "model_queries": _MODEL_SQL, "marked_targets": _MARKED_SQL, "matched_basis": _MATCHED_SQL, "judged_claims": _JUDGED_SQL, "reference_judgments": _REFERENCES_SQL,
        "verified_contexts": f"{_VERIFIED_SQL} SELECT * FROM v",
        "verified_summary": f"""{_VERIFIED_SQL} SELECT paper_id, count(*) AS candidates_considered, count(*) FILTER (label = 'USES') AS candidates_selected, 0 AS confirmed_extends, count(*) FILTER (label = 'USES') AS confirmed_uses,
  CASE WHEN bool_or(label = 'USES') THEN 'USES' ELSE 'NOT_CONFIRMED' END AS final_label FROM v GROUP BY paper_id""",
        "confidence_margins": _MARGIN_SQL, "contribution_defaults": _CONTRIBUTION_SQL, "refined_clusters": _REFINED_SQL, "without_source": _SOURCE_SQL, "shown_references": _SHOWN_SQL, "reference_contexts": _REFCONTEXT_SQL,
        "bounded_search": _BOUNDED_SQL, "slugs": _SLUG_SQL, "plain_latex": _PLAIN_SQL,
        "label_ids": "SELECT o_orderpriority AS label, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS label_id FROM orders GROUP BY o_orderpriority",
        "comparison": f"""WITH t AS ({types}), {ref._CLAIMS_SQL}, x AS (SELECT source, CASE WHEN claims.claim_idx <= 3 THEN claims.claim_idx END AS c1, match AS c2, coverage AS c4 FROM claims JOIN t ON t.paper_id = claims.paper_id AND t.claim_idx = claims.claim_idx)
SELECT source, count(*) AS n_papers, round(avg(c1), 3) AS c1_mean_score, {rate.format("c1 >= 2", "count(c1)")} AS c1_agreement_rate, {rate.format("c2 = 1", "count(*)")} AS c2_exact_match_rate, {rate.format("c2 >= 0.5", "count(*)")} AS c2_partial_plus_rate,
  round(avg(c4), 3) AS c4_mean_coverage, {rate.format("c4 = 1", "count(*)")} AS c4_exact_match_rate, {rate.format("c4 >= 0.5", "count(*)")} AS c4_partial_plus_rate FROM x GROUP BY source""",
    }
