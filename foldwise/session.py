"""Session settings and the few helpers that need a session."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import ContractViolation

SMALL_ROWS = 10_000


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foldwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


@contextmanager
def kept(df: DataFrame):
    """Hold a derived table for the few passes of one fit; a table already held stays as it is.

    Lost blocks are recomputed from the plan. Select the needed columns before holding them.
    """
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield df
        return
    held = df.persist()
    try:
        yield held
    finally:
        held.unpersist()


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, which every executor can reach.

    A local master without that setting gets a fresh folder of its own; a cluster without it is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ContractViolation("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; blocks kept on executors would be lost with them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: lineage is cut, and columns take less room than rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects the plans behind them, which a large heap may put off for long."""
    spark.sparkContext._jvm.System.gc()


def collect_small(df: DataFrame, max_rows: int = SMALL_ROWS, what: str = "table") -> list:
    """Rows of a table that must stay small; one row too many is an error, never a cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ContractViolation(f"{what} has more than {max_rows} rows and cannot be read on the driver")
    return rows
