"""Splits that keep related records together.

Method: iterative minimum-label propagation over the bipartite graph of records
and entities, then stratified assignment of whole groups to splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathwright.functions.ids import canonical_paper_id
from pathwright.session import written

#: Groups of at least this share of all rows are placed one by one (so at most 1 / share of them);
#: the others travel in this many hash buckets. Both bound what the driver gets.
LARGE_SHARE, BUCKETS, STRATA = 1 / 2_000, 4_096, 64


def components(links: DataFrame, record: str, entity: str) -> DataFrame:
    """The connected components of a bipartite record-entity graph: (entity, label), label being the
    least entity of the component in byte order.

    links has one row per record and entity it names; NULL in either links nothing, repeated rows
    count once, other columns are ignored. Entities that no record ties to another one may be absent.
    Each round takes the least label over every record's entities and then follows labels of labels,
    so a chain of length n needs about log n rounds. Labels are written to the shared folder
    every round; only the number of changed labels reaches the driver. An empty graph gives no rows."""
    links = links.select(F.col(record).alias("_r"), F.col(entity).alias("_e")).where("_r is not null and _e is not null").distinct()
    # a record with one entity ties nothing
    ties = written(links.join(links.groupBy("_r").agg(F.count("*").alias("_n"), F.min("_e").alias("_least")).where("_n > 1"), "_r").select("_r", "_e", "_least"))
    labels = written(ties.groupBy("_e").agg(F.min("_least").alias("_l")))
    ties = ties.select("_r", "_e")
    while True:
        least = ties.join(labels, "_e").groupBy("_r").agg(F.min("_l").alias("_l"))
        spread = ties.join(least, "_r").groupBy("_e").agg(F.min("_l").alias("_l"))
        onward = labels.select(F.col("_e").alias("_l"), F.col("_l").alias("_ll"))
        new = (
            labels.withColumnRenamed("_l", "_old")
            .join(spread, "_e")
            .join(onward, "_l", "left")
            .select("_e", F.least("_l", F.coalesce("_ll", "_l")).alias("_l"), "_old")
        )
        new = written(new)
        changed = new.where("_l <> _old").limit(1).count()
        labels = new.select("_e", "_l")
        if not changed:
            return labels.select(F.col("_e").alias("entity"), F.col("_l").alias("label"))


def paper_links(metadata: DataFrame) -> DataFrame:
    """(record, entity) of paper metadata: every record names its paperId and its ArXiv, ACL and DOI
    ids, in canonical spelling; missing ids and stand-ins name nothing."""
    m = metadata.select(
        F.array_distinct(
            F.filter(
                F.array(
                    canonical_paper_id(F.col("paperId")),
                    *(canonical_paper_id(F.try_element_at(F.col("externalIds"), F.lit(k))) for k in ("ArXiv", "ACL", "DOI")),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("_ids")
    ).where(F.size("_ids") > 1)
    m = m.select(F.array_sort("_ids").alias("_ids")).distinct()
    return m.select(F.array_join("_ids", "\x1f").alias("record"), F.explode("_ids").alias("entity"))


def task_groups(tasks: DataFrame, metadata: DataFrame) -> DataFrame:
    """(task_id, paper_id, source, label) of each distinct task: label names the paper the task is of.

    A missing paper_id, or a stand-in for missing, gives a label of the task's own; so does the bare
    row index of a blind row. Repeated rows (same task_id) count once; a NULL task_id gives no row."""
    t = (
        tasks.select("task_id", "paper_id", "source", "claim_idx", "loaded_at")
        .where("task_id is not null")
        .groupBy("task_id")
        .agg(F.min_by(F.struct("paper_id", "source"), F.struct("loaded_at", "paper_id")).alias("_t"))
        .select("task_id", "_t.paper_id", "_t.source")
    )
    index = (F.col("source") == "blind") & F.col("paper_id").rlike(r"^\s*\d{1,9}\s*$")
    t = t.withColumn("_key", F.when(~F.coalesce(index, F.lit(False)), canonical_paper_id(F.col("paper_id"))))
    c = components(paper_links(metadata), "record", "entity")
    t = t.join(c, F.col("_key") == F.col("entity"), "left")
    return t.select("task_id", "paper_id", "source", F.coalesce("label", "_key", F.concat(F.lit("task:"), F.col("task_id").cast("string"))).alias("label"))


def related_tasks(tasks: DataFrame, metadata: DataFrame) -> DataFrame:
    """(task_id, group_key) of each task whose paper has another task; group_key is the least
    paper_id, in byte order and as written, among the tasks of the paper."""
    t = written(task_groups(tasks, metadata))
    g = t.groupBy("label").agg(F.count("*").alias("_n"), F.min("paper_id").alias("group_key")).where("_n > 1")
    return t.join(g, "label").select("task_id", "group_key")


def assign_groups(rows: DataFrame, group: str, stratum: str | Column, shares: dict[str, float]) -> DataFrame:
    """(group, split): every group whole in one split, the shares of rows near `shares` in all and within
    each stratum.

    Groups of LARGE_SHARE of the rows or more are placed singly, the rest in BUCKETS hash buckets, each
    piece, largest first, where the weighted squared deviation of row counts per stratum and split from
    their targets grows least. Only these pieces' counts (at most 1 / LARGE_SHARE + BUCKETS of them, over
    STRATA hashed strata) are sent to the driver. A NULL stratum is a stratum of its own; NULL groups give
    no row; ties go to the split named first; an empty table gives no rows."""
    stratum = F.col(stratum) if isinstance(stratum, str) else stratum
    r = rows.select(F.col(group).alias("_g"), F.pmod(F.xxhash64(F.coalesce(stratum.cast("string"), F.lit("\0"))), F.lit(STRATA)).cast("int").alias("_s")).where("_g is not null")
    cells = written(r.groupBy("_g", "_s").agg(F.count("*").alias("_n")))
    total = cells.agg(F.sum("_n")).first()[0] or 0
    least = max(1, total * LARGE_SHARE)
    sizes = cells.groupBy("_g").agg(F.sum("_n").alias("_size"))
    piece = F.when(F.col("_size") >= least, F.concat(F.lit("g:"), F.col("_g").cast("string"))).otherwise(F.concat(F.lit("b:"), F.pmod(F.xxhash64("_g"), F.lit(BUCKETS)).cast("string")))
    pieces = sizes.select("_g", piece.alias("_piece"))
    counts = cells.join(pieces, "_g").groupBy("_piece", "_s").agg(F.sum("_n").alias("_n")).collect()
    where = _place([(x["_piece"], x["_s"], x["_n"]) for x in counts], shares)
    spark = rows.sparkSession
    plan = F.broadcast(spark.createDataFrame(sorted(where.items()), "_piece string, split string"))
    return pieces.join(plan, "_piece").select(F.col("_g").alias(group), "split")


def _place(counts: Sequence[tuple[str, int, int]], shares: dict[str, float]) -> dict[str, str]:
    """The split of each piece, from its row counts per stratum."""
    names, whole = list(shares), sum(shares.values())
    by_piece: dict[str, dict[int, int]] = {}
    of_stratum: dict[int, int] = {}
    for piece, s, n in counts:
        by_piece.setdefault(piece, {})[s] = n
        of_stratum[s] = of_stratum.get(s, 0) + n
    total = sum(of_stratum.values())
    has = {k: dict.fromkeys(of_stratum, 0) for k in names}
    rows = dict.fromkeys(names, 0)
    where = {}
    for piece, cells in sorted(by_piece.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        size = sum(cells.values())

        def cost(k: str) -> float:
            share = shares[k] / whole
            out = ((rows[k] + size - share * total) ** 2 - (rows[k] - share * total) ** 2) / max(share * total, 1)
            for s, n in cells.items():
                goal = share * of_stratum[s]
                out += ((has[k][s] + n - goal) ** 2 - (has[k][s] - goal) ** 2) / max(goal, 1)
            return out

        best = min(names, key=cost)
        where[piece] = best
        rows[best] += size
        for s, n in cells.items():
            has[best][s] += n
    return where


def split_tasks(tasks: DataFrame, metadata: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(task_id, group_label, split) of each distinct task, about 80, 10 and 10 percent train, validation
    and test, every paper whole in one split, strata being the tasks' sources."""
    t = written(task_groups(tasks, metadata))
    a = assign_groups(t, "label", "source", shares or {"train": 0.8, "validation": 0.1, "test": 0.1})
    return t.join(a, "label").select("task_id", F.col("label").alias("group_label"), "split")


def split_report(assigned: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows and their share per source and split."""
    t = tasks.select("task_id", "source").where("task_id is not null").groupBy("task_id").agg(F.min("source").alias("source"))
    n = assigned.select("task_id", "split").join(t, "task_id").groupBy("source", "split").agg(F.count("*").alias("n_tasks"))
    return n.select("source", "split", "n_tasks", F.round(F.col("n_tasks") / F.sum("n_tasks").over(Window.partitionBy("source")), 4).alias("share"))
