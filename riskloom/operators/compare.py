"""Two reports side by side: fixed and new findings, movement, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from .score import KEYS


def identity(stable: bool = False) -> Column:
    """Key of a finding across reports.

    Ids are numbered per scan, so a shifted number makes an unchanged finding look both fixed and
    new; `stable=True` leaves the id out.
    """
    parts = ["category", "title", "path", F.nullif(F.col("line_no"), F.lit(0)).cast("string")]
    parts = parts if stable else ["id", *parts]
    present = [F.nullif(F.col(p), F.lit("")) if isinstance(p, str) else p for p in parts]
    return F.coalesce(F.nullif(F.concat_ws("::", *present), F.lit("")), F.col("title"))


def _sided(findings: DataFrame, pairs: DataFrame, stable: bool) -> DataFrame:
    """Findings once for each pair and side their report stands on: `_before` is the side."""
    side = lambda column, before: F.struct(F.col(column).alias("report_id"), F.lit(before).alias("_before"))
    sides = pairs.select("pair_id", F.inline(F.array(side("before_id", True), side("after_id", False))))
    return findings.withColumn("finding_key", identity(stable)).join(sides, "report_id")


def changed(findings: DataFrame, pairs: DataFrame, stable: bool = False) -> DataFrame:
    """Findings only in the before report ('fixed') or only in the after report ('new'); repeats kept.

    pairs: pair_id, before_id, after_id. Findings meet the pairs once; which keys stand on one side only comes
    out of one grouping that is combined before its exchange.
    """
    rows, key = _sided(findings, pairs, stable), ["pair_id", "finding_key"]
    lone = rows.groupBy(*key).agg(F.min("_before").alias("a"), F.max("_before").alias("b")).filter("a = b").select(*key)
    change = F.when(F.col("_before"), "fixed").otherwise("new")
    return rows.join(lone, key, "left_semi").withColumn("change", change).drop("_before")


def movement(unit_facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Risk before, after and reduction per pair and category; a missing report counts as 0."""
    scores = [f"score_{k}" for k in KEYS]
    side = lambda name: unit_facts.select(
        F.col("report_id").alias(f"{name}_id"), *[F.col(s).alias(f"{name}_{s}") for s in scores]
    )
    wide = pairs.join(side("before"), "before_id", "left").join(side("after"), "after_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("category_ord"), F.lit(k).alias("category_key"),
            zero(f"before_score_{k}").alias("before_risk"), zero(f"after_score_{k}").alias("after_risk"),
            (zero(f"before_score_{k}") - zero(f"after_score_{k}")).alias("risk_reduction"),
        ) for i, k in enumerate(KEYS)
    ])
    return wide.select("pair_id", F.inline(rows))


def largest_reduction(moves: DataFrame) -> DataFrame:
    """Per pair the category with the largest reduction; `shown` only when risk really fell."""
    best = F.max(F.struct("risk_reduction", (-F.col("category_ord")).alias("o"), "category_key"))
    return moves.groupBy("pair_id").agg(best.alias("b")).select(
        "pair_id", "b.category_key", "b.risk_reduction", (F.col("b.risk_reduction") > 0).alias("shown")
    )


def metrics(findings: DataFrame, scored: DataFrame, pairs: DataFrame, stable: bool = False) -> DataFrame:
    """Score change, verdict and counts of fixed and new findings per pair.

    Counts need no anti join: findings are first counted per (pair, key) on both sides at once.
    """
    both = _sided(findings, pairs, stable).select("pair_id", "finding_key", F.lower("severity").alias("s"), F.col("_before").alias("b"))
    b, s = F.col("b"), F.col("s")
    per_key = both.groupBy("pair_id", "finding_key").agg(
        F.count_if(b).alias("nb"), F.count_if(~b).alias("na"),
        F.count_if(b & (s == "critical")).alias("cb"), F.count_if(~b & (s == "critical")).alias("ca"),
        F.count_if(b & (s == "high")).alias("hb"), F.count_if(~b & (s == "high")).alias("ha"),
    )
    only_before, only_after = F.col("na") == 0, F.col("nb") == 0
    total = lambda cond, c, name: F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(name)
    counts = per_key.groupBy("pair_id").agg(
        total(only_before, "nb", "fixed"), total(only_after, "na", "added"),
        total(only_before, "cb", "critical_fixed"), total(only_before, "hb", "high_fixed"),
        total(only_after, "ca", "critical_added"), total(only_after, "ha", "high_added"),
    )
    score = lambda name: scored.select(F.col("report_id").alias(f"{name}_id"), F.col("safety_score").alias(f"{name}_score"))
    out = (
        pairs.join(score("before"), "before_id", "left").join(score("after"), "after_id", "left")
        .join(counts, "pair_id", "left")
        .fillna(0, ["before_score", "after_score", "fixed", "added", "critical_fixed", "high_fixed", "critical_added", "high_added"])
        .withColumn("score_delta", F.col("after_score") - F.col("before_score"))
    )
    verdict = (
        F.when(F.col("score_delta") > 0, fv.VERDICTS["better"])
        .when(F.col("score_delta") < 0, fv.VERDICTS["worse"]).otherwise(fv.VERDICTS["same"])
    )
    return out.withColumn("verdict", verdict)
