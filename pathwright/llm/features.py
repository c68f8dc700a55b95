"""Weighted features of records: document frequencies over the whole table, joined back to the records."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from pathwright.session import written

#: Shared features up to which frequencies are sent to all tasks, checked before every run: 12 bytes each, 12 MB in all. Beyond it they are joined.
BROADCAST_FEATURES = 1_000_000


def frequencies(records: DataFrame, features: str) -> DataFrame:
    """(_f, _df): in how many records each feature of the array<struct<feature, times>> stands, partial-aggregated on both sides of one shuffle."""
    return records.select(F.explode(F.transform(features, lambda x: x["feature"])).alias("_f")).groupBy("_f").agg(F.count("*").alias("_df"))


def weighted(records: DataFrame, key: str, features: str, cap: float = 20.0, shared_only: bool = False, total: int | None = None) -> DataFrame:
    """(key, feature array<bigint>, weight array<float>) of each record, from its array of distinct (feature, times).

    weight is times * idf, idf = min(ln(1 + records / records with the feature), cap): always above 0, so that a feature counts however common it is,
    in a table of two records as in one of all. With shared_only, features of one record alone, which no other record can share, are left out, and
    records of nothing else give no row; else they count too. A record without features gives no row. The join back is on the feature, where
    adaptive execution splits hot ones; no group holds more than one record's features. total is the number of records where the caller knows it."""
    n = float(records.select(key).count() if total is None else total)
    rows = records.select(F.col(key).alias("_k"), F.explode(features).alias("_f")).select("_k", F.col("_f.feature").alias("_f"), F.col("_f.times").alias("_n"))
    shared = frequencies(records, features).where("_df > 1")
    idf = F.least(F.log(1 + F.lit(n) / F.coalesce("_df", F.lit(1))), F.lit(cap))
    joined = rows.join(shared, "_f", "inner" if shared_only else "left").select("_k", F.struct("_f", (idf * F.col("_n")).cast("float").alias("_w")).alias("_x"))
    lists = joined.groupBy("_k").agg(F.collect_list("_x").alias("_x"))
    return lists.select(F.col("_k").alias(key), F.col("_x._f").alias("feature"), F.col("_x._w").alias("weight"))


def broadcast_weights(records: DataFrame, features: str, cap: float) -> Broadcast | None:
    """The idf of the features of more than one record as weighted() has it, as (sorted features, their idf) sent to all tasks; None if there are more
    than BROADCAST_FEATURES."""
    n = float(records.count())
    df = written(frequencies(records, features).where("_df > 1"))
    if df.count() > BROADCAST_FEATURES:
        return None
    table = df.orderBy("_f").toPandas()
    idf = np.minimum(np.log(1 + n / table["_df"].to_numpy(dtype=np.float64)), cap).astype(np.float32)
    return records.sparkSession.sparkContext.broadcast((table["_f"].to_numpy(dtype=np.int64), idf))
