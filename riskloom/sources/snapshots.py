"""What changed in a folder of source trees since it was last looked at.

A file source reads a path once; it sees neither edits in place nor deletions. Here the folder is listed, the
list is held against the last one, and the difference is written as a feed of changes that a stream reads.

A store is a folder with three tables: `snapshots` (path, size, time and digest of every file, one folder for each look),
`changes` (what a look found, with the text of added and changed files), and `looks`, a row for each look that is
complete. A look that fails before its row is written is done again under the same number and replaces itself.

Listing reads no contents. Only files whose size or time differ are read, and only those whose digest differs too count
as changed, so a file that was merely touched gives no row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions.text import extension
from ..session import MANY_FILES, configured, settle
from .listing import address, contents, listed
from .trees import from_binary

SNAPSHOT = "path string, size long, time timestamp, digest string"
CHANGES = "project_id string, path string, change string, removed boolean, version long, text string"


def _files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, time and content of a place that only Spark can list."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    return _to_scan(found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("time"), "content"))


def _to_scan(found: DataFrame) -> DataFrame:
    return found.filter(extension(F.col("path")).isin(fv.SCANNED_EXTENSIONS))


def last_look(spark: SparkSession, store: str) -> int:
    """Number of the last complete look; 0 if there was none."""
    try:
        return spark.read.schema("number int").parquet(f"{store}/looks").agg(F.max("number")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def look(spark: SparkSession, root: str, store: str) -> DataFrame:
    """Compare the files below root/<project_id>/... with the last look; the changes found, which are also kept.

    Columns: project_id, path, change (added, changed, removed), removed, version (number of the look), text (null when removed).
    """
    number = last_look(spark, store)
    if number:
        before = spark.read.schema(SNAPSHOT).parquet(f"{store}/snapshots/number={number}")
    else:
        before = spark.createDataFrame([], SNAPSHOT)
    place = address(spark, root)
    with configured(spark, MANY_FILES):
        now = settle(_files(spark, root).drop("content") if place is None else _to_scan(listed(spark, place)))
    same = now.join(before, ["path", "size", "time"], "left_semi")
    suspects = now.join(before, ["path", "size", "time"], "left_anti")
    if place is not None:
        found = contents(suspects)
    else:
        found = _files(spark, root)
        if number:
            # The source opens no file older than this; the join takes out the rest.
            least = suspects.agg(F.min("time")).first()[0]
            found = found.filter(F.col("time") >= F.lit(least)).join(suspects.select("path"), "path", "left_semi")
    facts = [F.col("path").alias("_path"), "size", "time", F.sha2("content", 256).alias("digest")]
    with configured(spark, MANY_FILES):
        read = settle(from_binary(found.select("path", "content", F.struct(*facts).alias("_fact")), root, ["_fact"]))
    known = before.select(F.col("path").alias("_known"), F.col("digest").alias("_digest"))
    held = read.join(known, F.col("_fact._path") == F.col("_known"), "left")
    change = F.when(F.col("_known").isNull(), "added").when(F.col("_digest") != F.col("_fact.digest"), "changed")
    kept = held.select("project_id", "path", change.alias("change"), F.lit(False).alias("removed"), "text").filter("change is not null")
    gone = before.join(now, "path", "left_anti").select("path", F.lit(b"").alias("content"))
    gone = from_binary(gone, root).select("project_id", "path", F.lit("removed").alias("change"), F.lit(True).alias("removed"), F.lit(None).cast("string").alias("text"))
    version = F.lit(number + 1).cast("long").alias("version")
    out = kept.unionByName(gone).select("project_id", "path", "change", "removed", version, "text")
    out.write.mode("overwrite").parquet(f"{store}/changes/number={number + 1}")
    seen = read.select(F.col("_fact._path").alias("path"), "_fact.size", "_fact.time", "_fact.digest")
    # A file that went away between listing and reading stays as it was known; the next look finds out.
    lost = before.join(suspects, "path", "left_semi").join(seen, "path", "left_anti")
    still = before.join(same, "path", "left_semi").join(seen, "path", "left_anti")
    still.unionByName(lost).unionByName(seen).write.mode("overwrite").parquet(f"{store}/snapshots/number={number + 1}")
    spark.createDataFrame([(number + 1,)], "number int").write.mode("append").parquet(f"{store}/looks")
    return spark.read.schema(CHANGES).parquet(f"{store}/changes/number={number + 1}")


def feed(spark: SparkSession, store: str, files_per_trigger: int = 1000) -> DataFrame:
    """The changes of all looks as a stream."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(f"{store}/changes")
