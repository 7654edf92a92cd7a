"""Files below a folder as rows: listed, opened and read by tasks.

Spark's own file sources keep every file that they list in the driver's memory. Here a folder is a row that a task lists; the
folders found there are the rows of the next level, and what was found stays in a table, so the driver holds a few numbers,
however many files there are. A task that lists a local folder holds one batch of its names.

This is for the file systems Arrow knows. For a place that only Spark can list, or that it has to look up (a pattern, a single
file), `address` gives none, and the caller uses Spark's source.

Cases: listed is what Spark's sources list: no hidden names, no files of no bytes, links followed, broken ones left out, times in
milliseconds. A folder that goes away meanwhile has no files. A missing root has no address.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: A task opens no more files, and is dealt no more bytes, unless one file has more.
TASK_FILES, TASK_BYTES = 20_000, 32 << 20
#: Contents leave a task's Python when they have so many bytes.
OUT_BYTES = 1 << 20
_BATCH = 4096
_FOUND = "path string, folder boolean, size long, milliseconds long"


def stores():
    """A function that gives the file system of a listed path, and the path in it; file systems are made once for each place."""
    from urllib.parse import quote, urlparse

    from pyarrow import fs

    local, known = fs.LocalFileSystem(), {}

    def of(path):
        place = urlparse(path)
        if place.scheme in ("", "file"):
            return local, path.split(":", 1)[1] if place.scheme else path
        key = (place.scheme, place.netloc)
        if key not in known:
            known[key] = fs.FileSystem.from_uri(f"{place.scheme}://{place.netloc}/")[0]
        return known[key], fs.FileSystem.from_uri(quote(path, safe=":/"))[1]

    return of


def opened():
    """A function that opens a listed path."""
    of = stores()

    class File:
        """An Arrow file with the error that others raise for a place before its start."""

        def __init__(self, file):
            self.file, self.read, self.tell, self.close, self.seekable = file, file.read, file.tell, file.close, file.seekable

        def seek(self, at, whence=0):
            try:
                return self.file.seek(at, whence)
            except ValueError as e:
                raise OSError(str(e)) from e

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.close()

    def open_(path):
        store, inner = of(path)
        return File(store.open_input_file(inner))

    return open_


def address(spark: SparkSession, root: str) -> str | None:
    """The whole address of a folder as Spark's sources show it, or none where only they can list it."""
    from pyarrow import fs

    if re.search(r"[{}\[\]*?\\]", root):
        return None
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
        store, inner = stores()(full)
        return full if store.get_file_info(inner).type == fs.FileType.Directory else None
    except (Py4JError, pa.ArrowException, OSError, ValueError):
        return None


def _hidden(name: str, folder: bool) -> bool:
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _inside(batches):
    import os
    import stat

    from pyarrow import fs

    of = stores()

    def found(folder):
        """Name, whether it is a folder, bytes and time of what stands in a folder."""
        store, inner = of(folder)
        if not isinstance(store, fs.LocalFileSystem):
            for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                yield x.base_name, x.type == fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1_000_000
            return
        try:
            names = os.scandir(inner)
        except (FileNotFoundError, NotADirectoryError):
            return
        with names:
            for x in names:
                try:
                    own = x.stat()
                except OSError:
                    continue
                name = x.name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                yield name, stat.S_ISDIR(own.st_mode), own.st_size, own.st_mtime_ns // 1_000_000

    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])

    done = []
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            for name, is_folder, size, time in found(folder):
                if _hidden(name, is_folder) or not (is_folder or size):
                    continue
                done.append((f"{folder.rstrip('/')}/{name}", is_folder, size, time))
                if len(done) >= _BATCH:
                    yield table(done)
                    done = []
    if done:
        yield table(done)


def listed(spark: SparkSession, place: str) -> DataFrame:
    """path, size, time of all files below the folder of an address, at any depth; written once."""
    out, number = scratch_path(spark, "listed"), 0
    folders = spark.createDataFrame([(place,)], "path string")
    while folders is not None:
        level = f"{out}/level={number}"
        folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_inside, _FOUND).write.parquet(level)
        deeper = spark.read.schema(_FOUND).parquet(level).filter("folder").select("path")
        folders, number = None if deeper.isEmpty() else deeper, number + 1
    return spark.read.schema(_FOUND).parquet(out).filter("not folder").select("path", "size", F.timestamp_millis("milliseconds").alias("time"))


def tasks(spark: SparkSession, rows: int | None, size: int | None) -> int:
    """How many tasks read so many files, or parts of files, of so many bytes."""
    rows, size = rows or 0, size or 0
    return max(1, min(rows, spark.sparkContext.defaultParallelism), math.ceil(rows / TASK_FILES), math.ceil(size / TASK_BYTES))


def _read(batches):
    open_ = opened()
    for batch in batches:
        rows, held, size = [], [], 0
        for at, path in enumerate(batch.column(0).to_pylist()):
            try:
                with open_(path) as file:
                    held.append(file.read())
            except FileNotFoundError:
                continue
            rows.append(at)
            size += len(held[-1])
            if size > OUT_BYTES:
                yield batch.take(pa.array(rows)).append_column("content", pa.array(held, pa.binary()))
                rows, held, size = [], [], 0
        if rows:
            yield batch.take(pa.array(rows)).append_column("content", pa.array(held, pa.binary()))


def contents(files: DataFrame) -> DataFrame:
    """path, size, time of listed files with their bytes as `content`; a file that went away gives no row."""
    count, size = files.agg(F.count("*"), F.sum("size")).first()
    dealt = files.select("path", "size", "time").repartition(tasks(files.sparkSession, count, size))
    return dealt.mapInArrow(_read, "path string, size long, time timestamp, content binary")
