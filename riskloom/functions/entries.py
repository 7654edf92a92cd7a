"""Archive entries: which are kept, which give the archive away."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import extension


@dataclass(frozen=True)
class Limits:
    """Sizes beyond which an archive or an entry is not read; None: no limit."""

    archive_bytes: int | None = None
    entries: int | None = None
    depth: int | None = None
    file_bytes: int | None = None
    kept_bytes: int | None = None


NONE = Limits()
PUBLISHED = Limits(fv.MAX_ARCHIVE_BYTES, fv.MAX_ENTRIES, fv.MAX_DEPTH, fv.MAX_FILE_BYTES, fv.MAX_KEPT_BYTES)


def _over(value: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else value > limit


def leaves_target(name: Column) -> Column:
    """Does an entry name resolve outside (or onto) the folder it is unpacked into?"""
    step = lambda p: F.when(p.isin("", "."), 0).when(p == "..", -1).otherwise(1)
    walk = F.aggregate(
        F.split(name, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, p: F.struct((acc["d"] + step(p)).alias("d"), F.least(acc["low"], acc["d"] + step(p)).alias("low")),
    )
    # Only a name with '..' in it has to be walked part by part.
    return (
        F.when(name.startswith("/"), True)
        .when(name.contains(".."), (walk["low"] < 0) | (walk["d"] == 0))
        .otherwise(name.rlike("^[./]*$"))
    )


def depth(name: Column) -> Column:
    """Number of path parts; trailing slashes do not count."""
    trimmed = F.rtrim(name, F.lit("/"))
    return F.length(trimmed) - F.length(F.replace(trimmed, F.lit("/"), F.lit(""))) + 1


def skip_reason(name: Column, file_size: Column, external_attr: Column, limits: Limits = NONE) -> Column:
    """Why an entry is not read, null when it is kept. The first rule that applies is the reason."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    last = F.element_at(parts, -1)
    blocked = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in fv.BLOCKED_DIRS]))
    symlink = F.shiftright(external_attr, 28).bitwiseAND(F.lit(15)) == 10
    return (
        F.when(blocked, "blocked_dir")
        .when(last.isin(fv.LOCK_FILES), "lock_file")
        .when(name.endswith("/"), "directory")
        .when(symlink, "symlink")
        .when(_over(file_size, limits.file_bytes), "too_large")
        .when(~extension(last).isin(fv.SCANNED_EXTENSIONS), "extension")
    )


def verdict(
    size: Column, entries: Column, deepest: Column, escapes: Column, kept_bytes: Column, limits: Limits = NONE
) -> Column:
    """Why a whole archive is rejected, null when it is admitted."""
    return (
        F.when(_over(size, limits.archive_bytes), "archive_too_large")
        .when(_over(entries, limits.entries), "too_many_entries")
        .when(_over(deepest, limits.depth), "too_deep")
        .when(escapes, "path_traversal")
        .when(_over(kept_bytes, limits.kept_bytes), "too_many_bytes")
    )
