"""A seeded shuffle of a table of any size in two passes, written as shards.

First pass: records are scattered uniformly over buckets that fit into a task's memory. Second pass: each bucket is
put in order and shuffled by Fisher and Yates, and written. The buckets one after the other are then a
random order of all records; shard s of n takes the records from floor(s * N / n) up to the next, so shards
differ by one record at most and each is a run of neighbouring buckets.

A record's bucket follows from a seeded hash of its number in a written copy of the table, not from its contents, so
repeated rows, however many, spread like all others, and a repeated task deals each record to the
same bucket again. The same written copy and seed give the same order.

Cases: null and empty texts, repeated rows and null ids are records like any other; columns keep their names, one
named `shard` or `slot` is kept as `_shard` or `_slot`; fewer records than shards leave some shards
empty; an empty table writes nothing and reads back empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.numbering import total_before
from ..session import scratch_path, settle

SHARDS = 8
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 1 << 16


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of n records."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = list(range(n))
    draws = rng.integers(0, np.arange(1, n + 1)).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(seed: int, schema: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        # Records arrive in the order of the exchange; their numbers put them in one order first.
        sorted_ = np.argsort(group.column("_row").to_numpy(), kind="stable")
        group = group.take(sorted_[fisher_yates(len(group), seed, group.column("_bucket")[0].as_py())])
        place = np.arange(len(group)) + group.column("_before").to_numpy()
        return pa.Table.from_arrays([group.column("rec"), pa.array(place, pa.int64())], schema=schema)

    return run


def _estimated_bytes(docs: DataFrame) -> Column:
    """Bytes of a record: its texts and something for the rest."""
    long = [f"`{f.name}`" for f in docs.schema if f.dataType.simpleString() in ("string", "binary")]
    return sum((F.coalesce(F.octet_length(f"rec.{c}"), F.lit(0)).cast("long") for c in long), F.lit(8 * len(docs.columns)).cast("long"))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 0, path: str | None = None,
             bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Write `docs` in a random order as `shards` folders below `path`, and read them back.

    Adds `shard` (from 0) and `slot`, the record's place in its shard (from 0, without gaps).
    """
    if shards < 1:
        raise ValueError("there is one shard at least")
    spark = docs.sparkSession
    docs = docs.withColumnsRenamed({c: f"_{c}" for c in ("shard", "slot") if c in docs.columns})
    numbered = settle(docs.select(F.struct("*").alias("rec"), F.monotonically_increasing_id().alias("_row")))
    total, size = numbered.agg(F.count("*"), F.sum(_estimated_bytes(docs))).first()
    buckets = max(math.ceil((size or 0) / bucket_bytes), math.ceil(total / bucket_rows), 1)
    dealt = numbered.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(buckets)))
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    before = total_before(sizes, ["_all"], ["_bucket"], "_n", "_before").select("_bucket", "_before")
    # The join deals by bucket, as the grouping does, so records are exchanged once.
    rows = dealt.join(before, "_bucket")
    schema = StructType([rows.schema["rec"], StructField("_place", LongType())])
    mixed = rows.groupBy("_bucket").applyInArrow(_shuffled(seed, to_arrow_schema(schema)), schema)
    mixed = mixed.withColumn("shard", F.expr(f"int(_place * {shards} div {max(total, 1)})"))
    mixed = mixed.withColumn("slot", F.expr(f"_place - (shard * {total}L + {shards - 1}) div {shards}"))
    path = path or scratch_path(spark, "shards")
    out = mixed.select("rec.*", "slot", "shard").sortWithinPartitions("shard", "slot")
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
