"""What is left to do and what belongs to it: pending rows, selections, few-shot examples, grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def pending(tasks: DataFrame, finished: DataFrame, key: Sequence[str]) -> DataFrame:
    """Tasks without a finished row; NULL keys are never finished."""
    return tasks.join(finished.select(*key).distinct(), list(key), "left_anti")


def restricted(rows: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is wanted."""
    return rows.join(wanted.select(*key).distinct(), list(key), "left_semi")


def first_entities(rows: DataFrame, entity: str, order: str, n: int) -> DataFrame:
    """All rows of the first n distinct entities by their first place; all rows if n is not positive. Entities are ranked among themselves, one row
    each, not the rows."""
    if n <= 0:
        return rows
    firsts = rows.groupBy(entity).agg(F.min(order).alias("_at")).orderBy("_at", entity).limit(n)
    return rows.join(firsts.select(F.col(entity).alias("_e")), F.col(entity).eqNullSafe(F.col("_e")), "left_semi")


def first_rows(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def few_shots(tasks: DataFrame, examples: DataFrame, n: int, key: Sequence[str] = ("paper_id", "claim_idx")) -> DataFrame:
    """(key, shot from 1, ord): the first n examples by ord for each task, its own left out. At most n + 1 examples can serve, so only those are
    joined, broadcast as that bound allows."""
    few = examples.orderBy("ord").limit(n + 1).select("ord", *(F.col(k).alias(f"_{k}") for k in key))
    own = F.lit(True)
    for k in key:
        own = own & F.col(k).eqNullSafe(F.col(f"_{k}"))
    j = tasks.select(*key).crossJoin(F.broadcast(few)) if n > 0 else tasks.select(*key).crossJoin(F.broadcast(few.limit(0)))
    w = Window.partitionBy(*key).orderBy("ord")
    return j.where(~own).withColumn("shot", F.row_number().over(w)).where(F.col("shot") <= n).select(*key, "shot", "ord")


def grid(claims: DataFrame, **dims: Sequence) -> DataFrame:
    """claims times the given values: modes, rankers, budgets. The values are exploded literals, not a join."""
    for name, values in dims.items():
        claims = claims.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return claims


def shown_references(references: DataFrame, key: Sequence[str] = ("paper_id",), enough: int = 5, most: int = 30) -> DataFrame:
    """References shown to a generator: the influential ones if there are enough, else the first `most` of all. references: (key, ord, is_influential)."""
    inf = F.count_if(F.coalesce("is_influential", F.lit(False))).over(Window.partitionBy(*key))
    r = references.withColumn("_i", inf).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("ord")))
    return r.where(((F.col("_i") >= enough) & F.coalesce("is_influential", F.lit(False))) | ((F.col("_i") < enough) & (F.col("_r") <= most))).drop("_i", "_r")
