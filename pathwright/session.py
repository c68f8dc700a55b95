"""Session helpers and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows a broadcast hint may cover at most; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_own_dirs: list[str] = []


def build(app: str = "pathwright", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the session in."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master
    gets a temporary folder of its own when that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="pathwright-"))
        atexit.register(shutil.rmtree, _own_dirs[0], True)
    return f"file://{_own_dirs[0]}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    The files survive the loss of executors, are columnar, and let later plans know their size. What was shuffled for them is dropped at once, not
    when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pathwright/{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    _remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether Spark drops the shuffle files of a query when it has ended.
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(DROPPED, None)
    spark.conf.set(DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROPPED) if before is None else spark.conf.set(DROPPED, before)


_scratch: dict[str, list[str]] = {}


def _remove_at_end(spark: SparkSession, path: str) -> None:
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = []
        atexit.register(_clean, spark, app)
    _scratch[app].append(path)


def _clean(spark: SparkSession, app: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scratch.pop(app, []):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session is gone, and its folder with it
        pass


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all shuffle partitions by the columns, however few bytes it has: for what costs more time than its size tells. Later groupings by
    these columns and more need no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def rows_at_most(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows, counted here, are within the bound; else df as it is."""
    return F.broadcast(df) if rows_at_most(df, most) else df
