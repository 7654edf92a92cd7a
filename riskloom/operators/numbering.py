"""Ordered numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import settle


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """`row_number() over (partition by group order by order)`, with no task holding a whole group."""
    counted = total_before(df.withColumn("_one", F.lit(1)), group, order, "_one", name)
    return counted.withColumn(name, F.col(name) + 1).drop("_one")


def total_before(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, name: str) -> DataFrame:
    """Sum of `weight` over the earlier rows of the group, with no task holding a whole group.

    A plain window puts a group into one task, and one group may be a third of the table. Here the
    rows are range-partitioned by (group, order), so a large group spans many slices. The slice
    number is written down with the rows (it must not change if work is repeated), each slice is
    summed on its own, and the total of the group's earlier slices is added. The offset window
    sees one row per group and slice, never more per group than there are slices. A null in the group is a group.
    """
    keys = [*group, *order]
    sliced = settle(df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_slice", F.spark_partition_id()))
    part = [*group, "_slice"]
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*part).agg(F.sum(weight).alias("_total"))
        .select(*part, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return (
        _matched(sliced.withColumn("_own", own), offsets, part)
        .withColumn(name, (F.col("_own") + F.col("_offset")).cast("long"))
        .drop("_own", "_offset", "_slice")
    )


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence, k: int, name: str) -> DataFrame:
    """The first k rows of each group, numbered from 1. Spark cuts to k before the exchange."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def with_previous(df: DataFrame, group: Sequence[str], time: str, tie: str, value: str, name: str) -> DataFrame:
    """The value of the group's previous row in time order, without one task per group.

    Rows are range-partitioned by (group, time, tie), so a large group spans slices; the first row of a slice takes
    the last value of the group's slice before it. Rows without a time have no place in the order: they
    stay, with null. A null in the group is a group of its own.
    """
    timed = df.filter(F.col(time).isNotNull())
    keys = [*group, time, tie]
    sliced = settle(timed.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_slice", F.spark_partition_id()))
    last = (
        sliced.groupBy(*group, "_slice").agg(F.max(F.struct(F.col(time), F.col(tie), F.col(value).alias("v"))).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(W.partitionBy(*group).orderBy("_slice")))
        .select(*group, "_slice", F.col("_carry.v").alias("_carry"))
    )
    inside = W.partitionBy(*group, "_slice").orderBy(time, tie)
    ranked = sliced.withColumn("_rank", F.row_number().over(inside)).withColumn("_lag", F.lag(value).over(inside))
    out = (
        _matched(ranked, last, [*group, "_slice"])
        .withColumn(name, F.when(F.col("_rank") == 1, F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_slice", "_rank", "_lag", "_carry")
    )
    none = F.lit(None).cast(df.schema[value].dataType)
    return out.unionByName(df.filter(F.col(time).isNull()).withColumn(name, none))


def _matched(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal columns; null equals null."""
    named = other.withColumnsRenamed({c: f"_on_{c}" for c in on})
    match = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return df.join(named, match).drop(*(f"_on_{c}" for c in on))
