"""Report history: cards, order, key figures, series, groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .numbering import number_rows, with_previous

CARD = ("id", "project_name", "scan_type", "repo_url", "upload_name", "safety_score", "status", "summary")


def cards(reports: DataFrame) -> DataFrame:
    """The nine columns a list of reports shows."""
    held = [F.col(c) if c in reports.columns else F.lit(None).cast("string").alias(c) for c in CARD]
    return reports.select(*held, F.coalesce("created_at", "timestamp").alias("created_at"))


def newest_first(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.desc_nulls_last("created_at"), "id")


def numbered_newest_first(reports: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """`ord` inside each owner's list: newest first, reports without a time last."""
    late = reports.withColumn("_late", -F.unix_micros("created_at")).withColumn("_none", F.col("created_at").isNull())
    return number_rows(late, by, ["_none", "_late", "id"], "ord").drop("_late", "_none")


def moment(text: Column) -> Column:
    """The time that an ISO 8601 text of a saved report names; null when it names none."""
    return F.try_to_timestamp(text)


def key_figures(reports: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Number of reports, latest score, number of blocked reports."""
    latest = F.max(F.struct("created_at", "id", "safety_score"))
    return reports.groupBy(*by).agg(
        F.count("*").alias("reports"), latest.alias("_l"), F.count_if(F.col("decision") == "BLOCK").alias("blocked")
    ).select(*by, "reports", F.col("_l.safety_score").alias("latest_score"), "blocked")


def score_series(reports: DataFrame, by: Sequence[str] = ("project_name",)) -> DataFrame:
    """One point per project and minute; the last report of a minute wins."""
    slot = F.date_trunc("minute", "created_at")
    last = F.max(F.struct("created_at", "id", "safety_score"))
    return reports.groupBy(*by, slot.alias("minute")).agg(last.alias("_l")).select(
        *by, "minute", F.col("_l.safety_score").alias("safety_score")
    )


def score_changes(reports: DataFrame, by: Sequence[str] = ("user_id", "project_name")) -> DataFrame:
    """Each report with its change against the project's previous one; null for the first and for one without a time."""
    out = with_previous(reports, by, "created_at", "id", "safety_score", "_before")
    return out.withColumn("score_delta", F.col("safety_score") - F.col("_before")).drop("_before")


def in_groups(reports: DataFrame, members: DataFrame) -> DataFrame:
    """Reports once per group they belong to."""
    return reports.join(members.select("group_id", F.col("report_id").alias("id")).distinct(), "id")


def ungrouped(reports: DataFrame, members: DataFrame) -> DataFrame:
    return reports.join(members.select(F.col("report_id").alias("id")), "id", "left_anti")


def daily_scores(reports: DataFrame, late: str | None = None) -> DataFrame:
    """Mean, lowest and highest score per project and day; works on a stream too.

    Every report counts, however late. A stream that names `late` keeps less state and leaves out reports later than that.
    """
    kept = reports if late is None else reports.withWatermark("created_at", late)
    return (
        kept.groupBy(F.window("created_at", "1 day").alias("_w"), "project_name")
        .agg(F.count("*").alias("reports"), F.avg("safety_score").alias("mean_score"),
             F.min("safety_score").alias("lowest"), F.max("safety_score").alias("highest"))
        .select(F.col("_w.start").alias("day"), "project_name", "reports", "mean_score", "lowest", "highest")
    )
