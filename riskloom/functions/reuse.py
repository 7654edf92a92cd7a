"""Columns that are built from fixed names come out the same every time."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def built_once(fn: Callable) -> Callable:
    """Keeps what a column builder returns, per JVM and arguments.

    A rule column takes hundreds of calls into the JVM to put together, which is more time than a
    small query needs to run. A column is only a description, so it can be used in many plans.
    """
    kept: dict = {}

    @wraps(fn)
    def build(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = fn(*args)
        return kept[key]

    return build
