"""Maximum matching of references and predictions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

PAIRS = T.ArrayType(T.StructType([T.StructField("reference_idx", T.IntegerType()), T.StructField("predicted_idx", T.IntegerType())]))


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges that hold: labelled full or partial, with both indices within 1 and n_reference or n_predicted. Repeated ones stay."""
    return edges.where(F.col("match").isin("full", "partial") & F.col("reference_idx").between(1, F.col("n_reference")) & F.col("predicted_idx").between(1, F.col("n_predicted")))


def maximum_matching(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A maximum one-to-one matching of (reference, predicted) edges, sorted.

    References are tried in ascending order, each first with its least free prediction; a taken one is freed by moving its reference along
    an alternating path. Breadth-first, so that long paths need no recursion."""
    out: dict[int, list[int]] = {}
    for r, p in sorted(set(edges)):
        out.setdefault(r, []).append(p)
    owner: dict[int, int] = {}
    for root in sorted(out):
        came: dict[int, int] = {}  # prediction -> the reference it was reached from
        queue, end = [root], None
        for r in queue:
            for p in out[r]:
                if p in came:
                    continue
                came[p] = r
                if p not in owner:
                    end = p
                    break
                queue.append(owner[p])
            if end is not None:
                break
        while end is not None:
            r = came[end]
            before = next((p for p, o in owner.items() if o == r), None)
            owner[end] = r
            end = before if r != root else None
    return sorted((r, p) for p, r in owner.items())


def match_claims(edges: DataFrame, key: Sequence[str] = ("paper_id", "claim_idx")) -> DataFrame:
    """(key, matched): the maximum matching over the full edges of each claim, as an array of pairs; its size is unique, and the pairs are
    those of ascending order. A claim's edges number at most references times predictions, so that an array holds them."""

    @F.pandas_udf(PAIRS)
    def matched(es: pd.Series) -> pd.Series:
        return pd.Series([[{"reference_idx": r, "predicted_idx": p} for r, p in maximum_matching([(e["reference_idx"], e["predicted_idx"]) for e in x])] for x in es])

    full = valid_edges(edges).where("match = 'full'")
    return full.groupBy(*key).agg(F.collect_set(F.struct("reference_idx", "predicted_idx")).alias("_e")).select(*key, matched("_e").alias("matched"))


def judged(claims: DataFrame, edges: DataFrame, key: Sequence[str] = ("paper_id", "claim_idx")) -> DataFrame:
    """claims (key, n_reference, n_predicted) with matched, n_matched and the number of partial edges; claims without edges match none."""
    e = edges.join(claims.select(*key, "n_reference", "n_predicted"), list(key))
    partial = valid_edges(e).where("match = 'partial'").groupBy(*key).agg(F.count("*").alias("n_partial"))
    out = claims.join(match_claims(e, key), list(key), "left").join(partial, list(key), "left")
    return out.withColumn("n_matched", F.coalesce(F.size("matched"), F.lit(0))).withColumn("n_matched", F.greatest("n_matched", F.lit(0))).fillna(0, ["n_partial"])
