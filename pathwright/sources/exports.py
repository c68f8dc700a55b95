"""Readers of exports: claim-level and paper-level rows, predictions, annotations, references, resumable outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathwright.functions.text import first_given, stripped
from pathwright.operators.groundings import all_clean

GROUNDING = "ref_id STRING, bib_key STRING, paper_id STRING, external_ids MAP<STRING, STRING>, ref_title STRING, ref_year STRING, ref_authors STRING"
INGREDIENT = (
    f"enabling_contribution_id STRING, ingredient_id STRING, enabling_contribution STRING, ingredient STRING, canonical_ref_id STRING, canonical_grounding STRUCT<{GROUNDING}>, "
    f"additional_ref_ids ARRAY<STRING>, additional_groundings ARRAY<STRUCT<{GROUNDING}>>, canonical_annotation STRUCT<roles: ARRAY<STRING>, role: STRING, contribution: STRING, rationale: STRING, evidence_span: STRING>"
)
CLAIM = "target_contribution STRING, rewritten_capability STRING, rewritten_claim STRING"
#: One schema for the claim-level, blind and paper-level layouts; fields a layout lacks are NULL.
EXPORT = (
    f"idx INT, claim_id STRING, claim_idx INT, conference_year INT, target_paper_id STRING, target_title STRING, {CLAIM}, downstream_usage_evidence STRING, "
    f"enabling_contributions ARRAY<STRUCT<{INGREDIENT}>>, claims ARRAY<STRUCT<{CLAIM}, ingredients: ARRAY<STRUCT<{INGREDIENT}>>>>, _corrupt_record STRING"
)
PREDICTED = "description STRING, role STRING, rationale STRING, ref_title STRING"
PREDICTION = f"paper_id STRING, claim_idx INT, paper_title STRING, claim STRING, source STRING, setting INT, generator_model STRING, n_predicted INT, predicted_ingredients ARRAY<STRUCT<{PREDICTED}>>, error STRING"
CLAIM_FIELDS = ("target_contribution", "rewritten_capability", "rewritten_claim")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The rows of JSON exports, a file being one array or one object per line; rows that do not parse keep their text in _corrupt_record."""
    return spark.read.schema(EXPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def _claim_text(of: str, field: str) -> Column:
    fields = [field, *(f for f in CLAIM_FIELDS if f != field)]
    return first_given(*(F.col(f"{of}{f}") for f in fields))


def claim_tasks(export: DataFrame, field: str = "target_contribution", year: int | None = None) -> DataFrame:
    """(paper_id, claim_idx, claim, paper_title, conference_year, ingredients): one row per claim of either layout.

    The claim's text is the wanted field, else the next that is not empty; rows without a paper id or text are left out. A blind row's id and
    index are its idx, 0 included. An exact year is pushed to the scan."""
    e = export if year is None else export.where(F.col("conference_year") == year)
    own = e.where("claims is null").select(
        first_given(F.col("target_paper_id"), F.col("idx").cast("string")).alias("paper_id"), F.coalesce("claim_idx", "idx", F.lit(0)).alias("claim_idx"), _claim_text("", field).alias("claim"),
        F.coalesce("target_title", F.lit("")).alias("paper_title"), "conference_year", F.col("enabling_contributions").alias("ingredients"),
    )
    p = e.where("claims is not null").select("target_paper_id", "target_title", "conference_year", F.posexplode("claims").alias("_i", "_c"))
    nested = p.select(
        F.coalesce("target_paper_id", F.lit("")).alias("paper_id"), F.col("_i").alias("claim_idx"), _claim_text("_c.", field).alias("claim"),
        F.coalesce("target_title", F.lit("")).alias("paper_title"), "conference_year", F.col("_c.ingredients").alias("ingredients"),
    )
    return own.unionByName(nested).where("paper_id <> '' and claim <> ''")


def normalised_ingredients(ingredients: Column) -> Column:
    """Ingredients of any generation of names as structs (text, role, rationale, canonical_ref_id, canonical_grounding, additional_groundings)."""
    return F.transform(
        ingredients,
        lambda i: F.struct(
            first_given(i["ingredient"], i["enabling_contribution"]).alias("text"),
            F.coalesce(F.array_join(i["canonical_annotation"]["roles"], ", "), i["canonical_annotation"]["role"], F.lit("")).alias("role"),
            F.coalesce(i["canonical_annotation"]["rationale"], F.lit("")).alias("rationale"),
            i["canonical_ref_id"].alias("canonical_ref_id"),
            i["canonical_grounding"].alias("canonical_grounding"),
            i["additional_groundings"].alias("additional_groundings"),
        ),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows of files `{summary, predictions or papers}`."""
    f = spark.read.schema(f"predictions ARRAY<STRUCT<{PREDICTION}>>, papers ARRAY<STRUCT<{PREDICTION}>>").option("multiLine", True).json(path)
    return f.select(F.explode(F.coalesce("papers", "predictions")).alias("_p")).select("_p.*").withColumn("claim_idx", F.coalesce("claim_idx", F.lit(0)))


def finished_predictions(predictions: DataFrame) -> DataFrame:
    """Rows that need no second run: no error, and ingredients that all say something."""
    return predictions.where((F.coalesce("error", F.lit("")) == "") & all_clean(F.col("predicted_ingredients")))


def finished_judgments(judged: DataFrame) -> DataFrame:
    """Judged rows without an error."""
    return judged.where(F.coalesce("error", F.lit("")) == "")


def active_claim(claims: Column, active_id: Column) -> Column:
    """The claim with the active id, C1 if there is none; NULL without it."""
    wanted = first_given(active_id, F.lit("C1"))
    return F.get(F.filter(claims, lambda c: c["claim_id"] == wanted), F.lit(0))


def claim_at(claims: Column, position: Column, active_id: Column) -> Column:
    """The claim at a position from 0, the active one beyond the end."""
    return F.coalesce(F.get(claims, position), active_claim(claims, active_id))


def reference_fields(references: Column) -> Column:
    """References (citedPaper, contextsWithIntent, isInfluential) with a title, as structs (title, contexts, is_influential)."""
    titled = F.filter(references, lambda r: F.coalesce(stripped(r["citedPaper"]["title"]), F.lit("")) != "")
    texts = lambda r: F.coalesce(F.transform(F.filter(r["contextsWithIntent"], lambda c: F.coalesce(c["context"], F.lit("")) != ""), lambda c: stripped(c["context"])), F.array().cast("array<string>"))
    return F.transform(titled, lambda r: F.struct(stripped(r["citedPaper"]["title"]).alias("title"), texts(r).alias("contexts"), F.coalesce(r["isInfluential"], F.lit(False)).alias("is_influential")))


def reference_id(ref: Column, source: Column) -> Column:
    """The first id there is: the reference's own, its key, the paper's ids, then the ACL, ArXiv and DOI ids."""
    ext = lambda k: F.try_element_at(source["external_ids"], F.lit(k))
    return F.nullif(first_given(ref["ref_id"], ref["bib_key"], source["ref_id"], source["bib_key"], source["paper_id"], ext("ACL"), ext("ArXiv"), ext("DOI")), F.lit(""))


def with_reference_ids(rows: DataFrame, ref: str, source: str) -> DataFrame:
    """rows with ref_key, the first id of a reference struct and its paper's struct, whichever spelling the fields have and whichever there are:
    the reference's own, its key, the paper's, then the ACL, ArXiv and DOI ids."""

    def given(column: str, *fields: str) -> list[Column]:
        have = {f.name for f in rows.schema[column].dataType.fields}
        return [F.col(f"{column}.{f}").cast("string") for f in fields if f in have]

    have = {f.name for f in rows.schema[source].dataType.fields}
    maps = [F.col(f"{source}.{f}") for f in ("external_ids", "externalIds") if f in have]
    outer = [F.coalesce(*(F.try_element_at(m, F.lit(k)) for m in maps)) for k in ("ACL", "ArXiv", "DOI")] if maps else []
    every = [*given(ref, "ref_id", "bib_key"), *given(source, "ref_id", "bib_key", "paperId", "paper_id"), *outer]
    return rows.withColumn("ref_key", F.nullif(first_given(*every), F.lit("")))


def silver_tasks(annotations: DataFrame, papers: int = 0) -> DataFrame:
    """(paper_id, claim_idx, claim_id, claim): the claims of annotated papers by place, of the first papers by id; all if papers is 0."""
    a = annotations if papers <= 0 else annotations.join(annotations.select("paper_id").distinct().orderBy("paper_id").limit(papers), "paper_id", "left_semi")
    c = a.select("paper_id", F.posexplode("claims").alias("claim_idx", "_c"))
    return c.select("paper_id", "claim_idx", F.col("_c.claim_id").alias("claim_id"), first_given(F.col("_c.rewritten_claim"), F.col("_c.text")).alias("claim"))


def read_training_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated training rows with a header; absent values are a space."""
    return spark.read.csv(path, sep="\t", header=True).fillna(" ")


def label_ids(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, label_id) by first appearance. Only one row per label is sorted."""
    from pyspark.sql import Window

    firsts = rows.groupBy(label).agg(F.min(order).alias("_at"))
    return firsts.select(label, (F.row_number().over(Window.orderBy("_at")) - 1).alias("label_id"))


def class_definitions(definitions: Column) -> Column:
    """A map of class definitions with its keys in lower case."""
    return F.transform_keys(definitions, lambda k, _: F.lower(k))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, id_type) of an input list: ids as strings, or objects with id and type."""
    f = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", "array<string>")
    v = f.select(F.posexplode(plain).alias("ord", "_v"))
    obj = F.from_json("_v", "struct<id: string, paper_id: string, id_type: string, type: string>")
    is_obj = F.startswith(F.ltrim("_v"), F.lit("{"))
    return v.select("ord", F.when(is_obj, first_given(obj["id"], obj["paper_id"])).otherwise(F.col("_v")).alias("id"), F.when(is_obj, first_given(obj["id_type"], obj["type"])).otherwise(F.lit("")).alias("id_type"))


def start_from(ids: DataFrame, first: str | None) -> DataFrame:
    """The ids from a given one on; all without one."""
    if not first:
        return ids
    at = ids.where(F.col("id") == first).agg(F.min("ord").alias("_at"))
    return ids.join(F.broadcast(at), F.col("ord") >= F.col("_at"), "left_semi")
