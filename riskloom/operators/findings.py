"""Findings as a table: union, first-wins repeats, ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.rules import category_key
from ..session import settle
from .numbering import total_before
from .scan import POSITION

REPEAT_KEY = ("category", "path", "line_no", "title")


def merge(*parts: DataFrame) -> DataFrame:
    """Rule outputs one after another; `stage` keeps their order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_wins(findings: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """One finding per (category, path, line, title): the first in finding order.

    The minimum is combined on the map side, so many copies of one finding cost no exchange.
    """
    group = [*keys, *REPEAT_KEY]
    rest = [c for c in findings.columns if c not in group and c not in POSITION]
    lead = [c for c in POSITION if c not in group and c in findings.columns]
    best = findings.groupBy(*group).agg(F.min(F.struct(*lead, *rest)).alias("_best"))
    return best.select(*group, "_best.*").select(*findings.columns)


def with_ids(findings: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Adds `id` = <category key>_<number in finding order>, at least three digits.

    Findings are numbered inside their file and rule stage, which is small; what comes before a file is summed on
    a table of one row per file, stage and category. So only counts are range-sorted, and findings are exchanged once.
    """
    parts = [*keys, "category_key", "stage", "path"]
    keyed = findings.withColumn("category_key", category_key(F.col("category")))
    keyed = settle(keyed.withColumn("_file", F.to_json(F.struct(*parts))))
    counts = keyed.groupBy("_file").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in parts))
    before = total_before(counts, [*keys, "category_key"], ["stage", "path", "_file"], "_n", "_before").select("_file", "_before")
    own = F.row_number().over(W.partitionBy("_file").orderBy("line_no", "sub_ord", "title"))
    numbered = keyed.withColumn("_own", own).join(before, "_file")
    return numbered.withColumn("id", F.format_string("%s_%03d", "category_key", F.col("_before") + F.col("_own"))).drop("_before", "_own", "_file")
