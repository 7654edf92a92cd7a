"""Saved reports: append, read, delete, compact, export.

A store is a folder with three Parquet tables: `reports`, partitioned by batch and a hash bucket of the user
(one folder per user would not scale), `schemas`, the columns that its batches have, and `deleted`, a list of (user, report) pairs that is made with the store,
so a list that cannot be read is an error and never brings deleted reports back. Deleting
appends to the list and rewrites nothing; reading takes the listed rows out; `compact` writes
a clean store elsewhere now and then.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .. import fixed_values as fv
from ..functions.rules import status_of
from ..operators import gate, score
from ..operators.guidance import next_steps
from .trees import write_files

BUCKETS = 64
DELETED = "user_id string, id string"
SOURCE_FIELDS = ("project_name", "scan_type", "repo_url", "owner", "repo_name", "branch")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")


def build(judged: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Report rows from judged units: scores, summary and gate as nested values.

    Where the code came from (project, repository, branch) is carried over if `judged` has it, else null.
    """
    return judged.select(
        *keys, "safety_score", status_of(F.col("safety_score")).alias("status"),
        F.struct(*[F.col(f"n_{s}").cast("int").alias(s) for s in score.SEVERITIES]).alias("summary"),
        F.struct(*[F.col(f"score_{k}").alias(k) for k in score.KEYS]).alias("category_scores"),
        gate.gate_document().alias("deployment_gate"), gate.policy_json().alias("policy_json"),
        F.lit(None).cast("int").alias("score_delta"),
        *(F.col(c) if c in judged.columns else F.lit(None).cast("string").alias(c) for c in SOURCE_FIELDS if c not in keys),
    )


def _listed(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The at most eight rows of each unit as an array in rank order."""
    rest = [c for c in rows.columns if c not in keys and c != "ord"]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", *rest))).alias(name))


def assemble(
    judged: DataFrame, scenarios: DataFrame, fixes: DataFrame, checklists: DataFrame, plans: DataFrame,
    keys: Sequence[str] = ("project_id",),
) -> DataFrame:
    """The whole report of a unit as one nested row.

    The lists are to be cut to what a report shows before. Findings, nodes and edges have no limit and stay
    tables of their own under the same key.
    """
    base = build(judged.withColumn("_steps", next_steps(fv.ACTIONS_SHOWN)), [*keys, "_steps"]).withColumnRenamed("_steps", "next_steps")
    return (
        base.join(_listed(scenarios, keys, "scenarios"), list(keys), "left")
        .join(_listed(fixes, keys, "fixes"), list(keys), "left")
        .join(checklists, list(keys), "left").join(plans, list(keys), "left")
    )


def stamped(reports: DataFrame, id_from: Sequence[str] | None = None) -> DataFrame:
    """Adds id, created_at and timestamp. With `id_from` the id is a hash, so a repeated write repeats it."""
    ident = F.sha2(F.concat_ws("\x1f", *id_from), 256) if id_from else F.uuid()
    out = reports.withColumn("id", ident)
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.current_timestamp())
    return out.withColumn("timestamp", F.col("created_at"))


def _schemas(spark: SparkSession, store: str) -> list[str]:
    """The different columns that batches of a store have had; none for a store from before they were kept."""
    try:
        return sorted(r[0] for r in spark.read.schema("schema string").parquet(f"{store}/schemas").distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _keep_columns(reports: DataFrame, store: str) -> None:
    own = StructType([StructField(f.name, f.dataType) for f in reports.schema if f.name not in ("batch", "bucket")]).json()
    if own not in _schemas(reports.sparkSession, store):
        reports.sparkSession.createDataFrame([(own,)], "schema string").write.mode("append").parquet(f"{store}/schemas")


def _stored(spark: SparkSession, store: str) -> DataFrame:
    """All rows ever appended. The columns are the store's own, so it is read alike whether it has rows or not."""
    known = _schemas(spark, store)
    if not known:
        return spark.read.parquet(f"{store}/reports")
    fields = {}
    for schema in known:
        fields |= {f.name: f for f in StructType.fromJson(json.loads(schema)) if f.name not in fields}
    return spark.read.schema(StructType([*fields.values(), StructField("batch", StringType()), StructField("bucket", IntegerType())])).parquet(f"{store}/reports")


def append(reports: DataFrame, store: str, batch: str | None = None) -> None:
    """Adds reports. A named batch that is written again replaces itself whole, so a retry adds nothing twice."""
    _keep_columns(reports, store)
    # Rows of a bucket meet before writing, so a batch leaves few files; hot buckets are split again.
    (
        reports.withColumn("bucket", _bucket()).hint("rebalance", "bucket")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/reports/batch={batch or uuid.uuid4().hex}")
    )
    reports.sparkSession.createDataFrame([], DELETED).write.mode("append").parquet(f"{store}/deleted")


def delete(requests: DataFrame, store: str) -> None:
    """Marks reports as deleted. A request only reaches a report of the same user."""
    requests.select("user_id", "id").write.mode("append").parquet(f"{store}/deleted")


def load(spark: SparkSession, store: str, users: Sequence[str] | None = None) -> DataFrame:
    """All reports, or those of some users: then only the folders of their buckets are read."""
    reports = _stored(spark, store)
    deleted = spark.read.schema(DELETED).parquet(f"{store}/deleted")
    if users is not None:
        buckets = [F.pmod(F.xxhash64(F.lit(u)), F.lit(BUCKETS)).cast("int") for u in users]
        reports = reports.filter(F.col("bucket").isin(*buckets) & F.col("user_id").isin(*users))
        deleted = deleted.filter(F.col("user_id").isin(*users))
    return reports.drop("batch", "bucket").join(deleted, ["user_id", "id"], "left_anti")


def one(spark: SparkSession, store: str, user_id: str, report_id: str) -> DataFrame:
    """A report of a user by its id; no row for somebody else's."""
    return load(spark, store, [user_id]).filter(F.col("id") == report_id)


def compact(spark: SparkSession, store: str, target: str) -> None:
    append(load(spark, store), target)


def export_json(reports: DataFrame, path: str) -> None:
    """Whole reports, one JSON document per line."""
    reports.write.mode("errorifexists").json(path)


def pretty(report_columns: Sequence[str]) -> Column:
    """A report as an indented JSON document."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in report_columns)), {"pretty": "true"})


def export_documents(reports: DataFrame, path: str) -> int:
    """Each report as an indented JSON file <user_id>/<id>.json, its names encoded as in addresses; returns their number."""
    encoded = lambda c: F.replace(F.url_encode(F.coalesce(F.col(c).cast("string"), F.lit("none"))), F.lit("+"), F.lit("%20"))
    name = F.concat(encoded("user_id"), F.lit("/"), encoded("id"), F.lit(".json"))
    return write_files(reports.select(name.alias("name"), F.encode(pretty(reports.columns), "UTF-8").alias("content")), path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, whole_files: bool = True) -> DataFrame:
    """Saved documents, one per file or (`whole_files=False`) line; broken ones keep their text in `_corrupt_record`."""
    fields = schema if isinstance(schema, StructType) else _parsed(spark, schema)
    return (
        spark.read.schema(StructType([*fields, StructField("_corrupt_record", StringType())])).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", str(whole_files).lower()).json(path)
    )


def _parsed(spark: SparkSession, schema: str) -> StructType:
    return spark.createDataFrame([], schema).schema
