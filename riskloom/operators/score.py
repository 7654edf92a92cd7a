"""Scores and counts per project or report: one aggregation, combined on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import rules as R
from ..functions.reuse import built_once
from .numbering import first_rows
from .scan import POSITION

KEYS = list(fv.CATEGORY_WEIGHTS)
SEVERITIES = list(fv.SEVERITY_RANKS)


def _per_finding() -> list[Column]:
    category, severity = F.col("category"), F.col("severity")
    return [
        R.normal_category(category).alias("_normal"), F.lower(category).alias("_category"), category.alias("_exact"),
        F.lower(severity).alias("_severity"), R.severity_rank(severity).alias("_rank"),
        R.severity_weight(severity).alias("_weight"),
    ]


def _aggregates(count, total, prompt_rank: Column) -> list[Column]:
    """What is known about a unit, given how findings are counted and their weights summed."""
    aggs: list[Column] = [count(F.col("_severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    for name, key in fv.CATEGORY_KEYS.items():
        weight = F.coalesce(total(F.col("_normal") == name), F.lit(0))
        aggs.append(F.least(weight, F.lit(100)).cast("int").alias(f"score_{key}"))
        aggs.append(count(F.col("_exact") == name).alias(f"n_{key}"))
    # Severities and categories in any spelling, for the gate and the next steps.
    aggs += [count(F.col("_rank") == rank).alias(f"gate_{s}") for s, rank in fv.SEVERITY_RANKS.items()]
    aggs += [count(F.col("_category").contains(word)).alias(f"says_{key}") for key, word in fv.CATEGORY_WORDS.items()]
    mentions, high = F.col("_category").contains, F.col("_rank") >= 3
    aggs += [
        count(mentions("secret exposure")).alias("blocking_secrets"),
        count(mentions("human approval") & high).alias("blocking_approvals"),
        count(mentions("tool permission") & high).alias("blocking_tools"),
        prompt_rank.alias("prompt_rank"),
    ]
    return aggs


_PROMPT = "Prompt Injection Risk"


@built_once
def _columns() -> tuple[list[Column], list[Column]]:
    prompt = F.coalesce(F.max(F.when(F.col("_exact") == _PROMPT, F.col("_rank"))), F.lit(0))
    return _per_finding(), _aggregates(F.count_if, lambda of: F.sum(F.when(of, F.col("_weight"))), prompt)


@built_once
def _running_columns() -> tuple[list[Column], list[Column]]:
    count = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).cast("long")
    prompt = F.lit(0)
    for rank in sorted(fv.SEVERITY_RANKS.values()):
        prompt = F.when(count((F.col("_exact") == _PROMPT) & (F.col("_rank") == rank)) > 0, rank).otherwise(prompt)
    return _per_finding(), _aggregates(count, lambda of: F.sum(F.when(of, F.col("_weight") * F.col("n"))), prompt)


def facts(findings: DataFrame, units: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Everything later steps need to know about a unit, in one exchange.

    `units` lists the units, repeats allowed; it only makes sure that a unit without findings
    gets its row. Output: counts per severity, `score_<category>` (capped at 100), `n_<category>`,
    the blocker counts and the strongest prompt finding.
    """
    per_finding, aggs = _columns()
    rows = findings.select(*keys, *per_finding).unionByName(units.select(*keys), allowMissingColumns=True)
    return rows.groupBy(*keys).agg(*aggs)


def running(deltas: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """As `facts`, of rows (keys, category, severity, n) that add n findings or, with n below 0, take them back.

    All sums, so on a stream the state of a unit is one row and an update costs what has changed. A row
    without category only names its unit.
    """
    per_finding, aggs = _running_columns()
    return deltas.select(*keys, "n", *per_finding).groupBy(*keys).agg(*aggs)


def overall_risk(prefix: str = "score_") -> Column:
    """Weighted risk as a double, summed in category order."""
    total = F.lit(0.0)
    for key, weight in fv.CATEGORY_WEIGHTS.items():
        total = total + F.col(prefix + key) * F.lit(weight)
    return total


def safety(risk: Column) -> Column:
    """100 - risk, rounded half to even, kept within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(F.lit(100.0) - risk).cast("int")))


@built_once
def _score_columns() -> tuple[Column, Column]:
    return safety(overall_risk()), R.status_of(F.col("safety_score"))


def scored(unit_facts: DataFrame) -> DataFrame:
    """Adds safety_score and status."""
    safety_score, status = _score_columns()
    return unit_facts.withColumn("safety_score", safety_score).withColumn("status", status)


def category_rows(unit_facts: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Long form: one row per unit and category, always six."""
    each = F.array(*[
        F.struct(F.lit(i).alias("category_ord"), F.lit(key).alias("category_key"), F.col(f"score_{key}").alias("score"))
        for i, key in enumerate(KEYS)
    ])
    return unit_facts.select(*keys, F.inline(each))


@built_once
def top_categories(n: int) -> Column:
    """Labels of the n highest category scores; category order decides ties."""
    ranked = F.array_sort(F.array(*[
        F.struct((-F.col(f"score_{key}")).alias("s"), F.lit(i).alias("o"), F.lit(key.replace("_", " ")).alias("label"))
        for i, key in enumerate(KEYS)
    ]))
    return F.transform(F.slice(ranked, 1, n), lambda c: c["label"])


def common_categories(findings: DataFrame, n: int, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Without scores: the n categories with most findings, the one seen first on ties."""
    counted = findings.groupBy(*keys, "category").agg(F.count("*").alias("findings"), F.min(F.struct(*POSITION)).alias("_seen"))
    top = first_rows(counted, keys, [F.desc("findings"), F.asc("_seen")], n, "ord")
    return top.select(*keys, "ord", "category", "findings")
