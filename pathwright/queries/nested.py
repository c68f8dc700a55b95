"""Queries of nested-record shredding over reasoning_outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathwright.operators import nested
from pathwright.tables import load


def _shared(spark: SparkSession, d: str) -> DataFrame:
    """Per level: occurrences of elements and distinct objects they are stored as."""
    o = nested.occurrences(nested.shred(load(spark, d, "reasoning_outputs"), "output_id", "payload"), "output_id")
    return o.groupBy("level").agg(F.count("*").alias("n_occurrences"), F.countDistinct("node_id").alias("n_objects"))


def _table(level: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Every occurrence of the level with its place, its parent and its fields."""
        t = nested.shred(load(spark, d, "reasoning_outputs"), "output_id", "payload")
        o = nested.occurrences(t, "output_id").where(F.col("level") == level)
        o = o.join(nested.flat_table(t, level), "node_id")
        return o.select("output_id", "claim_pos", "ingredient_pos", "child_pos", F.hex("parent_id").alias("parent_id"), F.hex("node_id").alias("node_id"), *nested.FIELDS[level])

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p5_found": lambda s, d: nested.elements(load(s, d, "reasoning_outputs")),
        "p5_shared": _shared,
        "p5_claims": _table("claim"),
        "p5_ingredients": _table("ingredient"),
        "p5_candidates": _table("candidate"),
        "p5_groundings": _table("grounding"),
    }


def oracle_sql() -> dict[str, str]:
    return {}
