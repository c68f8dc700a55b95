"""Writers: result tables, checkpoints of finished rows, run metadata, Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_finished(rows: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Adds finished rows to a Parquet table; what is there stays, so that a broken run goes on where it ended."""
    w = rows.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def read_finished(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The finished rows so far; none if nothing was written yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_paper_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One table per kind of file, each partitioned by paper_id where it has one; replaces what is there."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("paper_id") if "paper_id" in df.columns and len(df.columns) > 1 else w).parquet(f"{path}/{name}")


def write_results(metrics: DataFrame, results: DataFrame, path: str) -> None:
    """Metric rows as JSON and as CSV with a header, result rows as JSON."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    metrics.select(*(F.col(c).cast("string") if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in metrics.dtypes)).write.mode("overwrite").option("header", True).csv(f"{path}/metrics_csv")
    results.write.mode("overwrite").json(f"{path}/results")


def run_record(spark: SparkSession, run_id: str, settings: dict[str, str]) -> DataFrame:
    """(run_id, started_at as ISO text in UTC, settings) of a run, one row."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pairs = [x for kv in sorted(settings.items()) for x in map(F.lit, kv)]
    empty = F.create_map().cast("map<string,string>")
    return spark.range(1).select(F.lit(run_id).alias("run_id"), now.alias("started_at"), (F.create_map(*pairs) if pairs else empty).alias("settings"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of a report of at most so many rows; a longer one is an error, as rows must not be left out unseen."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the report has more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows])


def payload_summary(payloads: DataFrame) -> DataFrame:
    """(target_paper_id, n_claims, n_ingredients, decisions map) of annotation payloads."""
    c = payloads.select("target_paper_id", F.explode_outer("claims").alias("_c"))
    d = c.groupBy("target_paper_id", F.coalesce("_c.decision", F.lit("")).alias("_d")).agg(F.count("_c").alias("_n"), F.sum(F.greatest(F.coalesce(F.size("_c.ingredients"), F.lit(0)), F.lit(0))).alias("_i"))
    return d.groupBy("target_paper_id").agg(F.sum("_n").alias("n_claims"), F.sum("_i").alias("n_ingredients"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.struct("_d", "_n"))))).alias("decisions"))
