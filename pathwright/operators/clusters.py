"""Clusters of contributions: exact keys, support, refinement decisions and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathwright.functions.text import cluster_title, first_given

CONFIRMED = ("USES", "EXTENDS")


def key_parts(key: Column) -> Column:
    """struct(relation in upper case, artifact, purpose) of a cluster key; empty parts if it has fewer than three."""
    p = F.split(F.coalesce(key, F.lit("")), r"\|")
    part = lambda i: F.when(F.size(p) >= 3, F.trim(F.get(p, F.lit(i)))).otherwise("")
    return F.struct(F.upper(part(0)).alias("relation"), part(1).alias("artifact"), part(2).alias("purpose"))


def contribution_fields(rows: DataFrame) -> DataFrame:
    """Contributions (label, paper_claim, cluster_title, cluster_key, evidence_span) as they count: without an evidence span nothing is confirmed;
    a confirmed one's title defaults to its claim and its key to `LABEL|contribution|unspecified`."""
    has = F.coalesce("evidence_span", F.lit("")) != ""
    label = F.when(has, F.coalesce("label", F.lit("NOT_CONFIRMED"))).otherwise("NOT_CONFIRMED")
    blank = lambda c: F.when(has, F.coalesce(c, F.lit(""))).otherwise("")
    r = rows.withColumns({"label": label, "paper_claim": blank("paper_claim"), "cluster_title": blank("cluster_title"), "cluster_key": blank("cluster_key")})
    sure = F.col("label").isin(*CONFIRMED)
    return r.withColumns(
        {
            "cluster_title": F.when(sure, first_given(F.col("cluster_title"), F.col("paper_claim"))).otherwise(F.col("cluster_title")),
            "cluster_key": F.when(sure, first_given(F.col("cluster_key"), F.concat("label", F.lit("|contribution|unspecified")))).otherwise(F.col("cluster_key")),
        }
    )


def exact_key_clusters(rows: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """(key, cluster_id from 1, cluster_key, cluster_title, count, members): confirmed contributions with a claim by their exact trimmed key, in
    order of first appearance; the title is the first member's, else made of the key. rows: (key, ord, label, paper_claim, cluster_key,
    cluster_title). Members are the ords, stable whatever was filtered."""
    r = rows.where(F.col("label").isin(*CONFIRMED) & (F.coalesce("paper_claim", F.lit("")) != ""))
    r = r.withColumn("_k", first_given(F.trim("cluster_key"), F.concat("label", F.lit("|contribution|unspecified"))))
    g = r.groupBy(*key, "_k").agg(F.min("ord").alias("_first"), F.count("*").alias("count"), F.min_by(F.trim("cluster_title"), "ord").alias("_t"), F.array_sort(F.collect_list("ord")).alias("members"))
    w = Window.partitionBy(*key).orderBy("_first")
    return g.select(*key, F.row_number().over(w).alias("cluster_id"), F.col("_k").alias("cluster_key"), first_given(F.col("_t"), cluster_title(F.col("_k"))).alias("cluster_title"), "count", "members")


def support(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per cluster: the first three claims, the first two rationales, and the numbers of uses, extensions and members, by ord.
    rows: (key, ord, label, paper_claim, rationale). Only the earliest of each are gathered."""
    w = lambda c: Window.partitionBy(*key, F.coalesce(c, F.lit("")) != "").orderBy("ord")
    r = rows.withColumns({"_c": F.row_number().over(w("paper_claim")), "_r": F.row_number().over(w("rationale"))})
    pick = lambda c, n, most: F.transform(F.array_sort(F.collect_list(F.when((F.coalesce(c, F.lit("")) != "") & (F.col(n) <= most), F.struct("ord", F.trim(c).alias("v"))))), lambda x: x["v"])
    return r.groupBy(*key).agg(
        pick("paper_claim", "_c", 3).alias("examples"), pick("rationale", "_r", 2).alias("rationales"), F.count_if(F.upper("label") == "USES").alias("uses_count"),
        F.count_if(F.upper("label") == "EXTENDS").alias("extends_count"), F.count("*").alias("member_count"),
    )


def dominant_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, dominant_key): the commonest relation, artifact and purpose of the cluster keys of each group, each by itself, the first seen of equals;
    USES, contribution and unspecified where there is none. rows: (key, ord, cluster_key)."""
    p = rows.select(*key, "ord", key_parts(F.col("cluster_key")).alias("_p"))
    p = p.select(*key, "ord", F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.col(f"_p.{n}").alias("v")) for n in ("relation", "artifact", "purpose")))).alias("_x"))
    n = p.where("_x.v <> ''").groupBy(*key, F.col("_x.part").alias("_part"), F.col("_x.v").alias("_v")).agg(F.count("*").alias("_n"), F.min("ord").alias("_first"))
    best = n.groupBy(*key, "_part").agg(F.max_by("_v", F.struct("_n", -F.col("_first"))).alias("_v"))
    one = best.groupBy(*key).agg(*(F.max(F.when(F.col("_part") == x, F.col("_v"))).alias(f"_{x}") for x in ("relation", "artifact", "purpose")))
    whole = F.concat_ws("|", F.coalesce("_relation", F.lit("USES")), F.coalesce("_artifact", F.lit("contribution")), F.coalesce("_purpose", F.lit("unspecified")))
    every = rows.select(*key).distinct().join(one, list(key), "left")
    return every.select(*key, whole.alias("dominant_key"))


def auto_dropped(clusters: DataFrame) -> Column:
    """Whether a cluster falls away without a question: no confirmed member, or a key of another relation."""
    return (F.col("uses_count") + F.col("extends_count") == 0) | ~key_parts(F.col("cluster_key"))["relation"].isin(*CONFIRMED)


def normalised_decisions(clusters: DataFrame, kept: DataFrame, dropped: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """(key, cluster_id, group, reason): each valid cluster once. Drops come first, then groups in their order; a cluster counts where it is named
    first; clusters never named are groups of their own (group NULL means dropped; groups of their own are numbered after the named ones).

    clusters: (key, cluster_id, ord); kept: (key, group, position, cluster_id); dropped: (key, position, cluster_id, reason)."""
    d = dropped.select(*key, "cluster_id", F.lit(0).alias("_kind"), F.lit(0).alias("_g"), F.col("position").alias("_p"), F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("Dropped by the filter.")).alias("reason"))
    k = kept.select(*key, "cluster_id", F.lit(1).alias("_kind"), F.col("group").alias("_g"), F.col("position").alias("_p"), F.lit(None).cast("string").alias("reason"))
    first = d.unionByName(k).groupBy(*key, "cluster_id").agg(F.min_by(F.struct("_kind", "_g", "reason"), F.struct("_kind", "_g", "_p")).alias("_d"))
    j = clusters.select(*key, "cluster_id", "ord").join(first, [*key, "cluster_id"], "left")
    own = F.lit(1_000_000) + F.col("ord")
    return j.select(*key, "cluster_id", "ord", F.when(F.col("_d").isNull(), own).when(F.col("_d._kind") == 1, F.col("_d._g")).alias("group"), F.when(F.col("_d").isNull(), F.lit("Not named; kept alone.")).otherwise(F.col("_d.reason")).alias("reason"))


def merged_clusters(clusters: DataFrame, decisions: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """(key, cluster_id from 1, cluster_key, cluster_title, count, members, source_cluster_ids): the groups that were kept, in the order of their
    first cluster, with the union of members, the dominant key and the first title."""
    j = decisions.where(F.col("group").isNotNull()).select(*key, "cluster_id", "ord", "group").join(clusters.select(*key, "cluster_id", "cluster_key", "cluster_title", "members"), [*key, "cluster_id"])
    g = j.groupBy(*key, "group").agg(
        F.min("ord").alias("_first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"), F.min_by("cluster_title", "ord").alias("cluster_title"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "cluster_id"))), lambda x: x["cluster_id"]).alias("source_cluster_ids"),
    )
    g = g.join(dominant_keys(j, [*key, "group"]), [*key, "group"])
    w = Window.partitionBy(*key).orderBy("_first")
    return g.select(*key, F.row_number().over(w).alias("cluster_id"), F.col("dominant_key").alias("cluster_key"), "cluster_title", F.size("members").alias("count"), "members", "source_cluster_ids")
