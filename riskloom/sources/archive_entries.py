"""Entries of ZIP archives as rows, each read for itself.

A first pass opens every archive and reads its central directory only: one row for each entry, without contents.
What is kept, and which archives are admitted, is decided on those rows. A second pass deals the kept entries over tasks by
place, so a large archive is read by many, and unpacks one entry at a time from its offset. A task holds one entry and 1 MB of others, however many an
archive has and however well it is packed: unpacking stops at the size that the directory states, and an
entry that has more is damaged.

Files are opened through the file systems Arrow knows (local, HDFS, object stores). For contents that only Spark can
read there is `archives.expand`.

Cases: no archive, an empty archive, several entries of one name, entries without bytes; an archive that cannot be read, or of which a
kept entry is damaged or encrypted, is rejected whole as not_a_zip; an entry over `ROW_BYTES` is left out as too_large, with or
without limits.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.entries import NONE, Limits, skip_reason
from ..session import MANY_FILES, configured, settle
from .archives import admit
from .listing import address, listed, opened
from .trees import below, decoded

#: A row holds no more; larger entries are left out.
ROW_BYTES = 1 << 30
TASK_BYTES = 16 << 20
#: Unpacked entries leave a task's Python when they have so many bytes or rows.
OUT_BYTES, OUT_ROWS = 1 << 20, 256
_ENTRY = "ord int, name string, file_size long, external_attr long, packed long, offset long, method int, flags int, crc long"
_MANIFEST = f"archive_id string, file string, archive_bytes long, readable boolean, {_ENTRY}"
_READ = "archive_id string, ord int, name string, content binary"


def list_archives(spark: SparkSession, root: str) -> DataFrame:
    """archive_id, file, archive_bytes of all .zip files below a folder; nothing is opened."""
    place = address(spark, root)
    if place is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root).withColumnRenamed("length", "size")
    else:
        found = listed(spark, place).filter(F.col("path").endswith(".zip"))
    return found.select(below(F.col("path"), root).alias("archive_id"), F.col("path").alias("file"), F.col("size").alias("archive_bytes"))


def _directories(batches):
    import zipfile

    unreadable = (zipfile.BadZipFile, OSError, KeyError, ValueError, RuntimeError, NotImplementedError)
    open_ = opened()
    names = [f.split()[0] for f in _MANIFEST.split(", ")]

    def rows_of(archive, path, size):
        none = [archive, path, size]
        try:
            with open_(path) as file, zipfile.ZipFile(file) as z:
                infos = z.infolist()
        except unreadable:
            return [(*none, False, *[None] * 9)]
        return [(*none, True, i, x.filename, x.file_size, x.external_attr, x.compress_size, x.header_offset, x.compress_type, x.flag_bits, x.CRC)
                for i, x in enumerate(infos)] or [(*none, True, *[None] * 9)]

    kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64()]
    for batch in batches:
        for archive, path, size in zip(*(batch.column(c).to_pylist() for c in ("archive_id", "file", "archive_bytes"))):
            rows = rows_of(archive, path, size)
            for at in range(0, len(rows), 4096):
                columns = zip(*rows[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def manifest(archives: DataFrame, limits: Limits = NONE) -> DataFrame:
    """A row for each entry of each archive; one without a name for an archive that is empty, unreadable or over the limit."""
    small = archives if limits.archive_bytes is None else archives.filter(F.col("archive_bytes") <= limits.archive_bytes)
    # A number of its own, or an exchange of short paths would be put together to a few tasks that open all archives.
    rows = small.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "archive_id").mapInArrow(_directories, _MANIFEST)
    if limits.archive_bytes is None:
        return rows
    large = archives.filter(F.col("archive_bytes") > limits.archive_bytes).withColumn("readable", F.lit(True))
    return rows.unionByName(large, allowMissingColumns=True)


def _reason(limits: Limits) -> Column:
    reason = skip_reason(F.col("name"), F.col("file_size"), F.col("external_attr"), limits)
    return F.when(reason.isNull() & (F.col("file_size") > ROW_BYTES), "too_large").otherwise(reason)


def _unpack(batches):
    import struct
    import zipfile
    import zlib

    unreadable = (zipfile.BadZipFile, OSError, KeyError, ValueError, RuntimeError, NotImplementedError, zlib.error, struct.error, EOFError)
    open_ = opened()

    def plain(file, row):
        """Bytes of a stored or deflated entry, read piece by piece up to the stated size."""
        file.seek(row["offset"])
        head = file.read(30)
        if head[:4] != b"PK\x03\x04" or row["flags"] & 1:
            raise zipfile.BadZipFile
        file.seek(row["offset"] + 30 + sum(struct.unpack("<HH", head[26:30])))
        if row["method"] == 0:
            return file.read(min(row["packed"], row["file_size"] + 1))
        out, left, inflate = bytearray(), row["packed"], zlib.decompressobj(-15)
        while left and not inflate.eof and len(out) <= row["file_size"]:
            piece = file.read(min(left, 1 << 20))
            if not piece:
                break
            left -= len(piece)
            while piece and len(out) <= row["file_size"]:
                out += inflate.decompress(piece, row["file_size"] + 1 - len(out))
                piece = inflate.unconsumed_tail
        return bytes(out)

    def content(file, row):
        if row["method"] in (0, 8):
            data = plain(file, row)
        else:
            file.seek(0)
            with zipfile.ZipFile(file) as z, z.open(z.infolist()[row["ord"]]) as entry:
                data = entry.read(row["file_size"] + 1)
        return data if len(data) == row["file_size"] and zlib.crc32(data) == row["crc"] else None

    kinds = [pa.string(), pa.int32(), pa.string(), pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _READ.split(", ")])

    held, of, done, size = None, None, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["file"] != of:
                if held is not None:
                    held.close()
                held, of = open_(row["file"]), row["file"]
            try:
                data = content(held, row)
            except unreadable:
                data = None
            # Small entries leave together; a large one leaves at once.
            done.append((row["archive_id"], row["ord"], row["name"], data))
            size += len(data or b"")
            if size > OUT_BYTES or len(done) >= OUT_ROWS:
                yield table(done)
                done, size = [], 0
    if done:
        yield table(done)
    if held is not None:
        held.close()


def read(spark: SparkSession, root: str, limits: Limits = NONE) -> tuple[DataFrame, DataFrame]:
    """files(project_id, path, text) of all admitted archives below a folder, and what gave no file: archive_id, name, reason."""
    with configured(spark, MANY_FILES):
        entries = settle(manifest(list_archives(spark, root), limits).withColumn("reason", _reason(limits)))
    named = entries.filter("name is not null")
    judged = admit(entries, limits=limits).join(
        entries.groupBy("archive_id").agg(F.bool_and("readable").alias("_readable")), "archive_id")
    verdicts = settle(judged.select("archive_id", F.when(~F.col("_readable"), "not_a_zip").otherwise(F.col("rejected")).alias("rejected")))
    admitted = verdicts.filter("rejected is null").select("archive_id")
    kept = named.filter("reason is null").join(admitted, "archive_id", "left_semi")
    size = kept.agg(F.sum(F.greatest("packed", F.col("file_size")))).first()[0] or 0
    # Entries of an archive stay in the order of their places, and a large archive spans tasks.
    dealt = kept.select("archive_id", "file", *(f.split()[0] for f in _ENTRY.split(", "))).repartitionByRange(
        max(math.ceil(size / TASK_BYTES), 1), "file", "offset", "ord").sortWithinPartitions("file", "offset", "ord")
    contents = settle(dealt.mapInArrow(_unpack, _READ))
    damaged = contents.filter("content is null").select("archive_id").distinct()
    files = contents.join(damaged, "archive_id", "left_anti").select(
        F.col("archive_id").alias("project_id"), F.col("name").alias("path"), decoded(F.col("content")).alias("text"))
    none = F.lit(None).cast("string")
    out = verdicts.filter("rejected is not null").select("archive_id", none.alias("name"), F.col("rejected").alias("reason"))
    out = out.unionByName(damaged.select("archive_id", none.alias("name"), F.lit("not_a_zip").alias("reason")))
    skipped = named.filter("reason is not null").join(admitted, "archive_id", "left_semi").join(damaged, "archive_id", "left_anti")
    return files, out.unionByName(skipped.select("archive_id", "name", "reason"))
