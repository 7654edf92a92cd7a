"""Source files of any length, read as lines.

A file is read in splits, by as many tasks as it has splits, and is never one row. A row of the reader is what
stands between two line feeds; it becomes a line, or several where the text has other line breaks. Each split
counts its own rows, and the sum over the earlier splits of the file is added, so numbering exchanges one row per
split. Whether a file is UTF-8, where it ends and whether it began with a byte order mark follow from what its
splits report: invalid rows, and bytes that are missing to the file's length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import fixed_values as fv
from ..functions.text import LINE_BREAK, extension
from ..operators.numbering import total_before
from ..session import configured, settle
from .listing import OUT_BYTES, address, listed, opened, tasks
from .trees import below

# Line breaks other than the line feed that parts the rows.
_BREAK = LINE_BREAK.replace(r"\r\n|[\n\r", r"[\r")
# With small splits, at most so many tasks for each core; a task reads as many splits as that takes.
TASKS_PER_CORE = 32
OUT_ROWS = 1 << 13
_ROWS = "_path string, _start long, _size long, _value binary, _row long"


def _splits_of(spark: SparkSession, size: int | None) -> dict[str, str]:
    if size is None:
        return {}
    # A split stays as small as asked for. Splits share a task, or there would be a task for each few kB.
    return {
        "spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0",
        "spark.sql.files.maxPartitionNum": str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)}


def _split_rows(batches):
    open_ = opened()

    def rows_of(file, start, end):
        """What stands between line feeds, of the rows that begin from `start` to before `end`."""
        place = max(start - 1, 0)
        file.seek(place)
        # Before its first line feed a split has the end of a row that began earlier.
        skipped, at, held = start > 0, place, []
        while piece := file.read(min(max(end - place, 1 << 12), 1 << 20)):
            place += len(piece)
            first, *more = piece.split(b"\n")
            held.append(first)
            for following in more:
                row = b"".join(held)
                if not skipped:
                    yield row
                skipped, at, held = False, at + len(row) + 1, [following]
                if at >= end:
                    return
        row = b"".join(held)
        if row and not skipped:
            yield row

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _ROWS.split(", ")])

    done, held = [], 0
    for batch in batches:
        for path, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start", "end"))):
            with open_(path) as file:
                for number, row in enumerate(rows_of(file, start, end)):
                    done.append((path, start, size, row, number))
                    held += len(row)
                    if held > OUT_BYTES or len(done) >= OUT_ROWS:
                        yield table(done)
                        done, held = [], 0
    if done:
        yield table(done)


def _split_size(spark: SparkSession, size: int, wanted: int | None) -> int:
    """As Spark parts files of `size` bytes in all."""
    if wanted is not None:
        return wanted
    conf = spark._jsparkSession.sessionState().conf()
    return min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), size // spark.sparkContext.defaultParallelism))


def _rows(spark: SparkSession, root: str, split_bytes: int | None) -> DataFrame:
    """What stands between line feeds, as bytes, with the split it was read in and its order there; written once."""
    place = address(spark, root)
    if place is None:
        return _rows_by_spark(spark, root, split_bytes)
    files = listed(spark, place).filter(extension(F.col("path")).isin(fv.SCANNED_EXTENSIONS))
    total = files.agg(F.sum("size")).first()[0] or 0
    step = F.lit(_split_size(spark, total, split_bytes)).cast("long")
    splits = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + step, F.col("size")))
    return settle(splits.repartition(tasks(spark, splits.count(), total)).mapInArrow(_split_rows, _ROWS))


def _rows_by_spark(spark: SparkSession, root: str, split_bytes: int | None) -> DataFrame:
    """As `_rows`, of a place that only Spark can read; the driver holds its files."""
    # The listed path is an encoded address, in which a plus sign stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    found = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(root)
    found = found.filter(extension(path).isin(fv.SCANNED_EXTENSIONS)).select(
        path.alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_size").alias("_size"),
        F.col("value").cast("binary").alias("_value"), F.monotonically_increasing_id().alias("_row"))
    with configured(spark, _splits_of(spark, split_bytes)):
        return settle(found)


def _body(text: Column) -> Column:
    """A row without the carriage return that belongs to its line feed."""
    return F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def _pieces(text: Column) -> Column:
    return F.split(_body(text), _BREAK, -1)


def _breaks(text: Column) -> Column:
    return F.regexp_count(_body(text), F.lit(_BREAK))


def read_lines(spark: SparkSession, root: str, split_bytes: int | None = None) -> DataFrame:
    """lines(project_id, path, line_no, line) of all files to scan below root/<project_id>/...

    Lines, their numbers and their text are those that `trees.read_trees` and `lines.explode_lines` give.
    `split_bytes` is the size of a split where the session's own is not wanted. Files of no bytes have no line.
    """
    rows = _rows(spark, root, split_bytes)
    raw, latin = F.col("_value").cast("string"), F.decode("_value", "ISO-8859-1")
    plain = F.is_valid_utf8(raw) & (F.length(raw) == F.octet_length("_value"))
    extra = F.struct(_breaks(raw).alias("utf8"), F.when(plain, _breaks(raw)).otherwise(_breaks(latin)).alias("latin"))
    splits = settle(rows.withColumn("_extra", extra).groupBy("_path", "_start").agg(
        F.min("_row").alias("_first"), F.max("_row").alias("_last"), F.count("*").alias("_n"), F.first("_size").alias("_size"),
        F.sum(F.octet_length("_value") + 1).alias("_bytes"), F.bool_and(F.is_valid_utf8(raw)).alias("_valid"),
        F.sum("_extra.utf8").alias("_utf8"), F.sum("_extra.latin").alias("_latin")))
    files = splits.groupBy("_path").agg(
        (F.first("_size") - F.sum("_bytes")).alias("_missing"), F.bool_and("_valid").alias("_text"), F.max("_start").alias("_end"))
    splits = splits.join(files, "_path").withColumn("_extra", F.when(F.col("_text"), F.col("_utf8")).otherwise(F.col("_latin")))
    splits = splits.withColumn("_lines", F.col("_n") + F.col("_extra"))
    # Three bytes of the mark were left out by the reader, and one was counted too many if the last row has no line feed.
    splits = splits.withColumns({"_marked": F.col("_missing") >= 2, "_open": F.col("_missing").isin(-1, 2) & (F.col("_start") == F.col("_end"))})
    splits = total_before(splits, ["_path"], ["_start"], "_lines", "_before").select(
        "_path", "_start", "_first", "_last", "_extra", "_text", "_marked", "_open", "_before")
    mark = F.col("_marked") & (F.col("_start") == 0) & (F.col("_row") == F.col("_first"))
    text = F.when(F.col("_text"), F.concat(F.when(mark, "﻿").otherwise(""), raw)).otherwise(F.concat(F.when(mark, "ï»¿").otherwise(""), latin))
    rows = rows.join(splits, ["_path", "_start"]).withColumn("_line", text)
    plain = rows.filter("_extra = 0").select(
        "_path", (F.col("_row") - F.col("_first") + F.col("_before")).alias("_before"), F.array(_body(F.col("_line"))).alias("_pieces"))
    # Only in a split with other line breaks does a row's number depend on the rows before it; a split is bounded.
    parted = rows.filter("_extra > 0").withColumn("_pieces", _pieces(F.col("_line")))
    ends = F.col("_open") & (F.col("_row") == F.col("_last")) & (F.element_at("_pieces", -1) == "")
    earlier = W.partitionBy("_path", "_start").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.size("_pieces")).over(earlier), F.lit(0))
    # A break at the very end of a text closes its last line and opens none; a carriage return there is cut off above.
    shut = F.when(ends & ~F.col("_line").endswith("\r"), F.slice("_pieces", 1, F.size("_pieces") - 1)).otherwise(F.col("_pieces"))
    parted = parted.select("_path", (own + F.col("_before")).alias("_before"), shut.alias("_pieces"))
    below_root = below(F.col("_path"), root)
    lines = plain.unionByName(parted).select(below_root.alias("_below"), "_before", F.posexplode("_pieces").alias("_pos", "line"))
    lines = lines.select(F.substring_index("_below", "/", 1).alias("project_id"), "_below", (F.col("_before") + F.col("_pos") + 1).cast("int").alias("line_no"), "line")
    return lines.select("project_id", F.expr("substring(_below, length(project_id) + 2)").alias("path"), "line_no", "line")
