"""Sessions, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(**settings: str) -> SparkSession:
    """The running session, or a new one; calling it again changes nothing but the settings given."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def is_running() -> bool:
    return SparkSession.getActiveSession() is not None


@contextmanager
def scoped(**settings: str) -> Iterator[SparkSession]:
    """A session that stops at the end, unless it ran before."""
    own = not is_running()
    spark = session(**settings)
    try:
        yield spark
    finally:
        if own:
            spark.stop()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only on a local master where none is named."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="reachspan-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder as compressed Parquet and cuts its lineage there."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task that explicit partitions aim at.
TASK_ROWS = 1 << 20


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: as the session has them, fewer for small tables, more where a task would get over TASK_ROWS."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, -(-rows // (TASK_ROWS >> 2))), -(-rows // TASK_ROWS))
