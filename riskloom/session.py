"""Session settings and durable cuts of a plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "riskloom", **conf: str) -> SparkSession:
    """A session with the settings every job here relies on; anything in `conf` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Scanning costs far more time per byte than reading, so small exchanges stay spread out.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Archive contents travel in Arrow batches; a batch is limited by its bytes.
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a scratch one on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    current = getattr(spark.sparkContext, "_riskloom_scratch", None)
    if current is None:
        current = tempfile.mkdtemp(prefix="riskloom-")
        spark.sparkContext._riskloom_scratch = current
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where a result feeds several jobs, or where a partition number becomes data and
    must not change when a lost executor's work is repeated.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]):
    """Settings of the session for the jobs that start inside, put back afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: For folders of many small files: some 2,000 of them make a task, not 32.
MANY_FILES = {"spark.sql.files.openCostInBytes": str(64 << 10)}


def worked_out(df: DataFrame, columns: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`columns` of the rows of `df`, worked out once by as many tasks as an exchange has, and written.

    Used where a row costs far more than its exchange: a table in a few large files gives few tasks, and each would grow
    with the table. Written, so that no filter on the result is worked out before the rows are dealt, and none twice.
    """
    if df.isStreaming:
        return columns(df)
    return settle(columns(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
