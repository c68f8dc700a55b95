"""The pN_ queries of the operators for training data over the test tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathwright.llm import crosssplit, encode, leaks, linkage, neardup, residue, splits
from pathwright.tables import load


def _packages(spark: SparkSession, d: str) -> DataFrame:
    return neardup.package_texts(load(spark, d, "paper_packages"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.claims(load(spark, d, "claim_tasks"), load(spark, d, "reasoning_claims"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> (session, folder of tables) -> result."""
    return {
        "p1_found": lambda s, d: linkage.links(load(s, d, "input_ids"), load(s, d, "claim_tasks")).select("input_id", "target_paper_id"),
        "p1_confidence": lambda s, d: linkage.links(load(s, d, "input_ids"), load(s, d, "claim_tasks")),
        "p2_found": lambda s, d: neardup.near_duplicates(_packages(s, d), "package_a", "package_b").select("package_a", "package_b"),
        "p2_classes": lambda s, d: neardup.duplicate_classes(_packages(s, d)).withColumnRenamed("id", "package_id"),
        "p3_found": lambda s, d: splits.related_tasks(load(s, d, "claim_tasks"), load(s, d, "paper_metadata")),
        "p3_splits": lambda s, d: splits.split_tasks(load(s, d, "claim_tasks"), load(s, d, "paper_metadata")),
        "p3_report": lambda s, d: splits.split_report(splits.split_tasks(load(s, d, "claim_tasks"), load(s, d, "paper_metadata")), load(s, d, "claim_tasks")),
        "p4_found": lambda s, d: crosssplit.overlaps(_claims(s, d)).select("eval_id", "train_id"),
        "p4_report": lambda s, d: crosssplit.overlap_report(_claims(s, d)),
        "p6_ids": lambda s, d: encode.encode(load(s, d, "documents")),
        "p7_found": lambda s, d: leaks.leaked(load(s, d, "documents"), load(s, d, "eval_items")).select("doc_id", "item_id"),
        "p7_items": lambda s, d: leaks.leak_report(load(s, d, "documents"), load(s, d, "eval_items")),
        "p8_found": lambda s, d: residue.residue_documents(load(s, d, "documents")),
        "p8_report": lambda s, d: residue.residue_report(load(s, d, "documents")),
    }


def _canonical(x: str) -> str:
    s = rf"lower(regexp_replace({x}, '^\s+|\s+$', '', 'g'))"
    stand_ins = ", ".join(f"'{v}'" for v in ("", "-", "--", "?", ".", "n/a", "na", "nan", "none", "null", "nil", "unknown", "undefined", "missing", "tbd", "todo"))
    bare = rf"regexp_replace(regexp_replace({s}, '^https?://[^/]+/', ''), '^(abs|pdf|paper|html|e-print)/', '')"
    bare = rf"regexp_replace(regexp_replace({bare}, '(\.pdf|/)+$', ''), '^((arxiv|doi|acl|s2|corpus)(\s*[:.]\s*|\s+))+', '')"
    bare = rf"regexp_replace({bare}, '^10\.48550/arxiv\.', '')"
    return rf"""(CASE WHEN {x} IS NULL OR {s} IN ({stand_ins}) THEN NULL
      WHEN regexp_matches({bare}, '^\d{{4}}\.\d{{4,5}}(v\d+)?$') THEN 'arxiv:' || regexp_extract({bare}, '^(\d{{4}}\.\d{{4,5}})', 1)
      WHEN regexp_matches({bare}, '^[0-9a-f]{{40}}$') THEN 's2:' || {bare}
      WHEN regexp_matches({bare}, '^10\.\d{{3,}}/.+') THEN 'doi:' || {bare}
      WHEN regexp_matches({bare}, '^\d{{4}}\.[a-z0-9]+-[a-z0-9]+\.\d+$') THEN 'acl:' || {bare}
      WHEN {bare} <> '' THEN 'raw:' || {bare} END)"""


def oracle_sql() -> dict[str, str]:
    """The SQL of the queries that SQL can express."""
    related = rf"""
WITH RECURSIVE named AS (
  SELECT row_number() OVER () AS r, paperId AS p, externalIds['ArXiv'] AS a, externalIds['ACL'] AS c, externalIds['DOI'] AS d FROM paper_metadata
), ids AS (
  SELECT r, {_canonical("x")} AS e FROM (SELECT r, unnest([p, a, c, d]) AS x FROM named)
), edges AS (
  SELECT DISTINCT i.e AS e1, j.e AS e2 FROM ids i JOIN ids j ON i.r = j.r WHERE i.e IS NOT NULL AND j.e IS NOT NULL
), reach AS (
  SELECT e1 AS e, e1 AS label FROM edges
  UNION
  SELECT edges.e2, reach.label FROM reach JOIN edges ON edges.e1 = reach.e
), comp AS (
  SELECT e, min(label) AS label FROM reach GROUP BY e
), tasks AS (
  SELECT task_id, min(paper_id) AS paper_id, min(source) AS source FROM claim_tasks GROUP BY task_id
), keyed AS (
  SELECT task_id, paper_id, CASE WHEN source = 'blind' AND regexp_matches(paper_id, '^\s*\d{{1,9}}\s*$') THEN NULL ELSE {_canonical("paper_id")} END AS k FROM tasks
), labelled AS (
  SELECT task_id, paper_id, coalesce(comp.label, k, 'task:' || task_id) AS label FROM keyed LEFT JOIN comp ON comp.e = keyed.k
)
SELECT task_id, group_key FROM labelled JOIN (SELECT label, min(paper_id) AS group_key FROM labelled GROUP BY label HAVING count(*) > 1) USING (label)
"""
    return {"p3_found": related}
