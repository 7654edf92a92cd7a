"""Source files from directories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions.text import extension


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 when they are valid UTF-8, else Latin-1; '' for no bytes."""
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))
    return F.coalesce(text, F.lit(""))


_PLACE = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def below(path: Column, root: str) -> Column:
    """A listed path without the root it was listed under, whatever the root's scheme and host.

    An absolute root is cut off once, by its length, so its name may come again further down. A relative
    one was completed by the reader; there the first place where it stands counts.
    """
    base = re.sub(_PLACE, "", root).rstrip("/")
    plain = F.regexp_replace(path, _PLACE, "")
    if base.startswith("/") or not base:
        return F.when(plain.startswith(base + "/"), F.substring(plain, len(base) + 2, 1 << 30)).otherwise(plain)
    at = F.locate(f"/{base}/", plain)
    return F.when(at > 0, F.substring(plain, at + F.lit(len(base) + 2), F.length(plain))).otherwise(plain)


def _found(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    )


def read_trees(spark: SparkSession, root: str) -> DataFrame:
    """files(project_id, path, text) below root/<project_id>/...

    Unreadable and vanished files do not stop the job; `lost_files` lists them. Files of no bytes are not
    listed by the source; they can hold no finding. The extension test runs on the listed path and
    the content column is the only one that is read.
    """
    return from_binary(_found(spark, root), root)


def lost_files(spark: SparkSession, root: str) -> DataFrame:
    """project_id, path of the files to scan that were listed but gave no content."""
    listed = _found(spark, root).select("path", F.lit(None).cast("binary").alias("content"))
    read = _found(spark, root).filter(F.col("content").isNotNull()).select("path")
    return from_binary(listed.join(read, "path", "left_anti"), root).drop("text")


def from_binary(found: DataFrame, root: str, keep: Sequence[str] = ()) -> DataFrame:
    """Project, relative path and text of rows of the binaryFile source (batch or stream), and the columns `keep`."""
    path = F.col("path")
    return (
        found.filter(extension(path).isin(fv.SCANNED_EXTENSIONS))
        .select(below(path, root).alias("_below"), decoded(F.col("content")).alias("text"), *keep)
        .select(F.substring_index("_below", "/", 1).alias("project_id"), "_below", "text", *keep)
        .select("project_id", F.expr("substring(_below, length(project_id) + 2)").alias("path"), "text", *keep)
    )


def write_files(files: DataFrame, root: str) -> int:
    """Rows (name, content) as files below `root`, a null content removes the file; returns the number of rows.

    A file appears under its name when it is complete, so a task that is repeated or runs twice leaves whole files.
    """
    def put(batches):
        import uuid
        from urllib.parse import urlparse

        from pyarrow import fs

        place = urlparse(root)
        made = set()
        store, base = fs.FileSystem.from_uri(root) if place.scheme not in ("", "file") else (fs.LocalFileSystem(), place.path)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                target = f"{base}/{name}"
                if content is None:
                    if store.get_file_info(target).type != fs.FileType.NotFound:
                        store.delete_file(target)
                    continue
                folder, own = target.rsplit("/", 1)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, target)
            yield batch[["name"]]

    return files.select("name", "content").mapInPandas(put, "name string").count()
