"""Reports that come after their day was closed: kept in a side table instead of being lost.

The rule is that of a watermark: a report is late when the window it belongs to ended at or before the greatest time of all
earlier batches less an allowance. A batch is written once, parted into what is on time and what is late, and leaves one row,
the greatest time so far, so the cost of a batch does not depend on what came before. A batch that is repeated after a
failure replaces itself; `store` and the checkpoint of the stream belong together.

Cases: a report without a time is on time; equal rows stay as they are; an empty batch changes nothing; in the first batch
nothing is late. Columns named `late` or `batch` are refused.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

DAY = timedelta(days=1)
_OWN = ("late", "batch")


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _mark(spark: SparkSession, store: str, batch: int) -> int | None:
    """The greatest time, in microseconds, of all batches up to this one; a batch that is not there is an error."""
    return spark.read.schema("mark long").parquet(f"{store}/marks/batch={batch}").first()[0] if batch >= 0 else None


def parted(store: str, late: timedelta, time: str = "created_at", window: timedelta = DAY) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` step that stores a batch, late rows apart from the others."""
    def step(rows: DataFrame, batch: int) -> None:
        if clash := [c for c in rows.columns if c.lower() in _OWN]:
            raise ValueError(f"columns of this name are the store's own: {clash}")
        spark, before = rows.sparkSession, _mark(rows.sparkSession, store, batch - 1)
        micros = F.unix_micros(F.col(time).cast("timestamp"))
        end = (F.floor(micros / F.lit(_micros(window))) + 1) * _micros(window)
        is_late = F.lit(False) if before is None else F.coalesce(end <= before - _micros(late), F.lit(False))
        place = f"{store}/arrivals/batch={batch}"
        rows.withColumn("late", is_late).write.mode("overwrite").partitionBy("late").parquet(place)
        own = spark.read.schema(StructType([rows.schema[time]])).parquet(place).agg(F.max(micros)).first()[0]
        mark = max((m for m in (before, own) if m is not None), default=None)
        spark.createDataFrame([(mark,)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{store}/marks/batch={batch}")

    return step


def start(reports: DataFrame, store: str, checkpoint: str, late: timedelta, time: str = "created_at", window: timedelta = DAY, **trigger) -> StreamingQuery:
    """Parts a stream of reports; read the result with `arrived`."""
    return (
        reports.writeStream.foreachBatch(parted(store, late, time, window)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def arrived(spark: SparkSession, store: str, schema: StructType, late: bool) -> DataFrame:
    """All reports that were late, or all that were not, with the `batch` they came in."""
    held = StructType([*schema, StructField("batch", LongType()), StructField("late", BooleanType())])
    return spark.read.schema(held).parquet(f"{store}/arrivals").filter(F.col("late") == late).drop("late")
