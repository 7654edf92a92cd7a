"""The k lines around a line. Array form: one row per file, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def window(per_line: str, line_no: Column, k: int) -> Column:
    """Items line_no - k to line_no + k (1-based, cut at the file's ends) of a one-item-per-line array."""
    start = F.greatest(line_no - k, F.lit(1))
    return F.slice(per_line, start, line_no + k - start + 1)
