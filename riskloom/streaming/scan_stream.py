"""Scan projects as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import gate, score
from ..operators.scan import ALL_RULES, FILE, scan
from ..sources import reports as store_of
from ..sources.trees import from_binary

DELTAS = "project_id string, category string, severity string, n long"


def stream_trees(spark: SparkSession, root: str, files_per_trigger: int = 10_000) -> DataFrame:
    """files(project_id, path, text, version) of new files below a folder; `version` is the time of the file."""
    found = (
        spark.readStream.format("binaryFile").schema(
            "path string, modificationTime timestamp, length bigint, content binary"
        ).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_trigger)).load(root)
    )
    return from_binary(found.withColumn("version", F.unix_micros("modificationTime")), root, ["version"])


def scan_stream(files: DataFrame, keys: Sequence[str] = ("project_id",), rules: Sequence[str] = ALL_RULES) -> DataFrame:
    """Findings of a stream of files. Stateless: every file is judged in its own row."""
    return scan(files, keys, rules)


def write_findings(findings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Findings appended to a Parquet table, each file's exactly once; `checkpoint` must outlive the stream."""
    return (
        findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def _replaced(key, frames, state):
    """Of one file: what its latest version adds to the findings, less what the version before it had."""
    import collections
    import json

    import pandas as pd

    rows = pd.concat(list(frames))
    version = int(rows["version"].max())
    known, before = state.get if state.exists else (None, "[]")
    if known is not None and version < known:
        return
    rows = rows[(rows["version"] == version) & ~rows["removed"] & rows["category"].notna()]
    now = collections.Counter(zip(rows["category"], rows["severity"]))
    change = collections.Counter(now)
    change.subtract({(c, s): n for c, s, n in json.loads(before)})
    state.update((version, json.dumps([[c, s, n] for (c, s), n in sorted(now.items())])))
    # A row without category tells that the project was touched, whatever was found.
    out = [(key[0], None, None, 0), *((key[0], c, s, n) for (c, s), n in sorted(change.items()) if n)]
    yield pd.DataFrame(out, columns=["project_id", "category", "severity", "n"])


def changed_counts(files: DataFrame) -> DataFrame:
    """Of a stream of files: rows (project_id, category, severity, n) by which the findings of projects change.

    `files` has project_id, path and text, and may have `version` (the greatest of a file counts, an earlier one that comes later
    does not; without it the last to arrive) and `removed`. The state holds one short row for each file: the
    counts of its latest version, which the next version takes back.
    """
    if "version" not in files.columns:
        files = files.withColumn("version", F.lit(0).cast("long"))
    if "removed" not in files.columns:
        files = files.withColumn("removed", F.lit(False))
    files = files.withColumn("text", F.coalesce("text", F.lit("")))
    found = scan(files, ["project_id", "version", "removed"], [*ALL_RULES, FILE], brief=True)
    rows = found.select("project_id", "path", F.col("version").cast("long").alias("version"), "removed", "category", "severity")
    return rows.groupBy("project_id", "path").applyInPandasWithState(_replaced, DELTAS, "version long, counts string", "append", "NoTimeout")


def report_batches(
    store: str, policy: dict | None = None, user: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` step: a report for every project whose facts arrive.

    Reports are stored under the batch number: a batch that is repeated after a failure replaces itself.
    """
    def step(facts: DataFrame, batch: int) -> None:
        judged = gate.judge(gate.under_policies(score.scored(facts), {"default": policy or {}}))
        rows = store_of.build(judged).withColumn("project_name", F.col("project_id"))
        rows = user(rows) if user else rows.withColumn("user_id", F.lit("stream"))
        named = rows.withColumn("_batch", F.lit(batch))
        store_of.append(store_of.stamped(named, ["project_id", "_batch"]).drop("_batch"), store, f"stream-{batch}")

    return step


def start_reports(files: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Reports of the projects that arriving files touch, from all their files so far.

    Two streams, one behind the other. The first scans the files and writes by how much the counts of projects
    change (`changed_counts`); the second adds that to a running sum for each project and reports those that moved. Both keep
    their state by key, so a batch costs what its files hold, whatever came before. Returned is the second;
    with `availableNow` the first has ended by then.
    """
    trigger, deltas = trigger or {"availableNow": True}, f"{store}/deltas"
    first = (
        changed_counts(files).writeStream.format("parquet").option("path", deltas).option("checkpointLocation", f"{checkpoint}/files")
        .outputMode("append").trigger(**trigger).start()
    )
    if trigger.get("availableNow") or trigger.get("once"):
        first.awaitTermination()
    moved = score.running(files.sparkSession.readStream.schema(DELTAS).parquet(deltas))
    return (
        moved.writeStream.outputMode("update").foreachBatch(report_batches(store)).option("checkpointLocation", f"{checkpoint}/projects")
        .trigger(**trigger).start()
    )
