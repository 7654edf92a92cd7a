"""ZIP archives as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions.entries import NONE, Limits, depth, leaves_target, skip_reason, verdict
from .trees import below, decoded

_ENTRY = "struct<ord:int,name:string,file_size:bigint,external_attr:bigint,content:binary>"
_EXPANDED = f"archive_id string, archive_bytes bigint, readable boolean, n_entries int, entries array<{_ENTRY}>"


def read_archives(spark: SparkSession, root: str, limits: Limits = NONE) -> DataFrame:
    """archives(archive_id, archive_bytes, content) of all .zip files below a folder.

    An archive is named by its path below the folder. The source only opens files whose length passes;
    archives over a limit are listed with a null content and their bytes are never read.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root)
    )
    shown = [below(F.col("path"), root).alias("archive_id"), F.col("length").alias("archive_bytes")]
    if limits.archive_bytes is None:
        return found.select(*shown, "content")
    small = found.filter(F.col("length") <= limits.archive_bytes).select(*shown, "content")
    large = found.filter(F.col("length") > limits.archive_bytes).select(*shown, F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def expand(archives: DataFrame, limits: Limits = NONE) -> DataFrame:
    """One row per archive with its entries as an array.

    The size limit is applied first, so an oversized archive is never sent to Python. All entries are listed; contents
    are read only of those that would be kept, and of none when the archive has too many, so damage in an
    entry that nobody reads harms nothing. Results leave Python as soon as 32 MB of contents are held.
    """
    flush_bytes, flush_rows = 32 * 1024 * 1024, 1000
    blocked, locks, extensions = set(fv.BLOCKED_DIRS), set(fv.LOCK_FILES), set(fv.SCANNED_EXTENSIONS)
    max_entries, max_bytes = limits.entries, limits.file_bytes

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import os
        import zipfile
        import zlib

        unreadable = (
            zipfile.BadZipFile, OSError, KeyError, ValueError, RuntimeError, NotImplementedError, zlib.error)

        def wanted(info):
            # What `skip_reason` keeps, known before the bytes are read.
            parts = info.filename.replace("\\", "/").split("/")
            ending = os.path.splitext(parts[-1])[1].lower()
            return not (
                blocked & set(parts) or parts[-1] in locks or info.filename.endswith("/") or info.external_attr >> 28 & 15 == 10
                or (max_bytes is not None and info.file_size > max_bytes) or ending not in extensions)

        def entries_of(content):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = z.infolist()
                readable = max_entries is None or len(infos) <= max_entries
                return len(infos), [
                    {"ord": i, "name": info.filename, "file_size": info.file_size, "external_attr": info.external_attr,
                     "content": z.read(info) if readable and wanted(info) else None}
                    for i, info in enumerate(infos)]

        entry = pa.struct([("ord", pa.int32()), ("name", pa.string()), ("file_size", pa.int64()), ("external_attr", pa.int64()), ("content", pa.binary())])
        kinds = {"archive_id": pa.string(), "archive_bytes": pa.int64(), "readable": pa.bool_(), "n_entries": pa.int32(), "entries": pa.list_(entry)}

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

        done, held = [], 0
        for batch in batches:
            # One row at a time: the batch itself stays in Arrow's memory, without a second copy as Python objects.
            for at in range(batch.num_rows):
                archive_id, size, content = (batch.column(c)[at].as_py() for c in ("archive_id", "archive_bytes", "content"))
                readable, count, entries = True, 0, []
                if content is not None:
                    try:
                        count, entries = entries_of(content)
                    except unreadable:
                        readable = False
                done.append((archive_id, size, readable, count, entries))
                held += sum(len(e["content"] or b"") for e in entries)
                if held > flush_bytes or len(done) >= flush_rows:
                    yield table(done)
                    done, held = [], 0
        if done:
            yield table(done)

    small = F.col("content")
    if limits.archive_bytes is not None:
        small = F.when(F.col("archive_bytes") <= limits.archive_bytes, small)
    return archives.select("archive_id", "archive_bytes", small.alias("content")).mapInArrow(unpack, _EXPANDED)


def _skipped(entry: Column, limits: Limits) -> Column:
    return skip_reason(entry["name"], entry["file_size"], entry["external_attr"], limits)


def judged(expanded: DataFrame, limits: Limits = NONE) -> DataFrame:
    """Adds `rejected` (a reason or null), worked out inside each archive's own row."""
    kept = F.filter("entries", lambda e: _skipped(e, limits).isNull())
    kept_bytes = F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, e: acc + e["file_size"])
    deepest = F.coalesce(F.array_max(F.transform("entries", lambda e: depth(e["name"]))), F.lit(0))
    escapes = F.exists("entries", lambda e: leaves_target(e["name"]))
    reason = verdict(F.col("archive_bytes"), F.col("n_entries"), deepest, escapes, kept_bytes, limits)
    return expanded.withColumn("rejected", F.when(~F.col("readable"), "not_a_zip").otherwise(reason))


def files_of(judged_archives: DataFrame, limits: Limits = NONE) -> DataFrame:
    """files(project_id, path, text) of admitted archives; nothing is exchanged between tasks."""
    entry: Column = F.col("e")
    rows = judged_archives.filter(F.col("rejected").isNull()).select(
        F.col("archive_id").alias("project_id"), F.explode("entries").alias("e")
    )
    return rows.filter(_skipped(entry, limits).isNull()).select(
        "project_id", entry["name"].alias("path"), decoded(entry["content"]).alias("text"))


def left_out(judged_archives: DataFrame, limits: Limits = NONE) -> DataFrame:
    """What gave no file and why: archive_id, name (null for a whole archive), reason."""
    whole = judged_archives.filter(F.col("rejected").isNotNull()).select(
        "archive_id", F.lit(None).cast("string").alias("name"), F.col("rejected").alias("reason"))
    rows = judged_archives.filter(F.col("rejected").isNull()).select("archive_id", F.explode("entries").alias("e"))
    each = rows.select("archive_id", F.col("e.name").alias("name"), _skipped(F.col("e"), limits).alias("reason"))
    return whole.unionByName(each.filter(F.col("reason").isNotNull()))


def admit(entries: DataFrame, by: str = "archive_id", limits: Limits = NONE) -> DataFrame:
    """Verdict per archive when entries are rows of a table: one aggregation.

    entries: archive id, archive_bytes, name, file_size, external_attr; a row without a name is no entry.
    """
    kept = F.col("name").isNotNull() & skip_reason(F.col("name"), F.col("file_size"), F.col("external_attr"), limits).isNull()
    per = entries.groupBy(by).agg(
        F.max("archive_bytes").alias("archive_bytes"), F.count("name").alias("n_entries"),
        F.coalesce(F.max(depth(F.col("name"))), F.lit(0)).alias("deepest"),
        F.coalesce(F.bool_or(leaves_target(F.col("name"))), F.lit(False)).alias("escapes"),
        F.coalesce(F.sum(F.when(kept, F.col("file_size"))), F.lit(0)).alias("kept_bytes"),
        F.count_if(kept).alias("kept_entries"),
    )
    reason = verdict(*[F.col(c) for c in ("archive_bytes", "n_entries", "deepest", "escapes", "kept_bytes")], limits)
    return per.withColumn("rejected", reason)
