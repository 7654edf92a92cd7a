"""Missing approval and audit controls for tool findings that live in a table of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import rules as R
from ..functions.text import any_of
from .lines import far_from, in_files


def _tools(findings: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    return in_files(findings.filter(F.col("category") == "Tool Permission Risk"), files, keys)


def _found(lines: DataFrame, words: list[str]) -> DataFrame:
    return lines.filter(F.col("line").rlike("(?iu)" + any_of(words)))


def missing_approval(findings: DataFrame, lines: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Tool findings with no approval word within 10 lines; severity is inherited."""
    left = _tools(findings, lines, keys)
    out = far_from(left, _found(lines, fv.APPROVAL_WORDS), keys, fv.APPROVAL_LINES)
    return out.select(
        *keys, "path", "line_no", (F.col("stage") + 2).alias("stage"), F.lit(0).alias("sub_ord"),
        F.lit("approval").alias("rule"), F.format_string(fv.TITLES["approval"], F.col("title")).alias("title"),
        "severity", F.lit("Human Approval Risk").alias("category"),
    )


def missing_audit(findings: DataFrame, lines: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Tool findings with no audit word within 15 lines; severity goes one step down."""
    left = _tools(findings, lines, keys)
    out = far_from(left, _found(lines, fv.AUDIT_WORDS), keys, fv.AUDIT_LINES)
    return out.select(
        *keys, "path", "line_no", (F.col("stage") + 4).alias("stage"), F.lit(0).alias("sub_ord"),
        F.lit("audit").alias("rule"), F.format_string(fv.TITLES["audit"], F.col("title")).alias("title"),
        R.audit_severity(F.col("severity")).alias("severity"), F.lit("Auditability Risk").alias("category"),
    )
