"""What to do about findings: scenarios, fixes, checklist, plan, first fix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import guidance as G
from ..functions.reuse import built_once
from ..functions.rules import severity_rank
from ..functions.text import filled, language
from .numbering import first_rows, number_rows
from .scan import POSITION


def _texts(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def _by_kind(kind: Column, table: dict, default=None) -> Column:
    """A struct of template texts chosen by kind; a few rows of constants, so a CASE and no join."""
    def row(texts):
        return F.struct(*[
            (_texts(t) if isinstance(t, list) else F.lit(t)).alias(f"t{i}") for i, t in enumerate(texts)
        ])
    out = None
    for name, texts in table.items():
        out = F.when(kind == name, row(texts)) if out is None else out.when(kind == name, row(texts))
    return out.otherwise(row(default)) if default else out


def remediation(findings: DataFrame) -> DataFrame:
    """Adds the category's standing advice, or the default advice for unknown categories."""
    t = _by_kind(F.col("category"), fv.REMEDIATION_TEXTS, fv.REMEDIATION_DEFAULT)
    return findings.withColumn("_t", t).select(
        *findings.columns, F.col("_t.t0").alias("category_why"), F.col("_t.t1").alias("category_fix"),
        F.col("_t.t2").alias("example_fix"),
    )


@built_once
def _scenario_columns() -> tuple[Column, Column, Column, dict[str, Column]]:
    kind, title, evidence = F.col("simulation_type"), F.col("title"), F.col("evidence")
    about_tool = kind.isin("tool_abuse", "approval_bypass", "audit_gap")
    return (
        severity_rank(F.col("severity")) >= 2, G.scenario_type(F.col("category")),
        F.when(about_tool, G.scenario_tool(title, evidence)),
        {
            "capability": F.when(kind == "tool_abuse", G.capability(F.col("tool"))),
            "priority_score": G.scenario_priority(F.col("severity"), F.col("category")),
            "_t": _by_kind(kind, fv.SCENARIO_TEXTS),
            "scenario_title": G.scenario_title(kind, F.col("tool"), G.scenario_secret(title, evidence)),
        },
    )


def scenarios(
    findings: DataFrame, keys: Sequence[str] = ("project_id",), limit: int | None = None, evidence_chars: int | None = None
) -> DataFrame:
    """Risk triage: findings of Medium or above, ranked by priority; with `limit`, of the first so many.

    Needs ids, evidence and texts. `ord` is the rank inside the unit: priority first, finding
    order on ties.
    """
    serious, kind, tool, rest = _scenario_columns()
    usable = findings.filter(serious).withColumn("simulation_type", kind).filter(F.col("simulation_type").isNotNull())
    first = _ranked(usable, keys, [*POSITION, "title"], limit, "_seq")
    out = first.withColumn("tool", tool).withColumns(rest).withColumn("_least", -F.col("priority_score"))
    ranked = _ranked(out, keys, ["_least", "_seq"], limit, "ord")
    seen = F.col("evidence") if evidence_chars is None else F.substring("evidence", 1, evidence_chars)
    return ranked.select(
        *keys, "ord", F.col("id").alias("finding_id"), "scenario_title", "simulation_type",
        F.lower("severity").alias("risk_level"), "priority_score", "path", "line_no",
        F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("location"),
        seen.alias("evidence"), "tool", "capability",
        filled(F.col("suggested_fix"), fv.SCENARIO_FIX_DEFAULT).alias("required_fix"),
        F.col("_t.t0").alias("guardrail"), F.col("_t.t1").alias("precondition"), F.col("_t.t2").alias("detection_signal"),
    )


@built_once
def _fix_columns() -> tuple[Column, dict[str, Column], list]:
    title, evidence, kind = F.col("title"), F.col("evidence"), F.col("patch_type")
    described = {
        "confidence": G.fix_confidence(kind, F.col("path")), "_t": _by_kind(kind, fv.FIX_TEXTS, fv.FIX_TEXT_DEFAULT),
    }
    shown = [
        "ord", F.col("id").alias("finding_id"),
        G.fix_title(kind, G.fix_tool(title, evidence), G.fix_secret(title, evidence)).alias("fix_title"),
        "patch_type", "path", "line_no", language(F.col("path")).alias("language"),
        G.fix_file(F.col("id"), kind).alias("patch_filename"), "confidence",
        G.fix_effort(kind, F.col("confidence")).alias("estimated_effort"),
        F.col("_t.t0").alias("affected_controls"), F.col("_t.t1").alias("risk_reduction"),
        F.concat(F.col("_t.t2"), _texts(fv.FIX_COMMON_STEPS)).alias("validation_steps"),
    ]
    return G.fix_type(F.col("category"), title), described, shown


def _ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None, name: str) -> DataFrame:
    """Rows numbered inside their unit; with `limit` the first so many."""
    if limit is None:
        return number_rows(rows, keys, order, name).withColumn(name, F.col(name).cast("int"))
    return first_rows(rows, keys, order, limit, name)


def fixes(findings: DataFrame, keys: Sequence[str] = ("project_id",), limit: int | None = None) -> DataFrame:
    """Findings that call for a known kind of fix, with all that describes the fix; with `limit` the first so many."""
    kind, described, shown = _fix_columns()
    usable = findings.withColumn("patch_type", kind).filter(F.col("patch_type").isNotNull())
    first = _ranked(usable, keys, [*POSITION, "title"], limit, "ord")
    return first.withColumns(described).select(*keys, *shown)


def _first_per(findings: DataFrame, keys: Sequence[str], item: Column, lead: Sequence[Column] = ()) -> DataFrame:
    """Distinct items of a unit with the place each was first seen; combined on the map side."""
    return findings.withColumn("_item", item).groupBy(*keys, "_item").agg(
        F.min(F.struct(*lead, *POSITION)).alias("_seen")
    )


def _listed(items: DataFrame, keys: Sequence[str], k: int | None) -> DataFrame:
    """The items of each unit as an array, in order; with k only the first k, and no more rows of a unit meet."""
    top = _ranked(items, keys, ["_seen"], k, "_n")
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "_item"))), lambda s: s["_item"]).alias("_items")
    )


def _cut(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def checklist(
    findings: DataFrame, unit_facts: DataFrame, keys: Sequence[str] = ("project_id",), limit: int | None = None
) -> DataFrame:
    """Fixes of Critical and High findings in first-seen order, then standing items; with `limit` at most so many."""
    urgent = _first_per(findings.filter(F.col("severity").isin("Critical", "High")), keys, F.col("suggested_fix"))
    listed = _listed(urgent, keys, limit)
    none = _texts([])
    standing = F.concat(*[
        F.when(F.col(f"n_{key}") > 0, _texts([text])).otherwise(none) for key, text in fv.CHECKLIST_CONDITIONAL
    ])
    every = F.array_distinct(F.concat(F.coalesce("_items", none), standing))
    return (
        unit_facts.join(listed, list(keys), "left")
        .select(*keys, F.when(F.size(every) > 0, _cut(every, limit))
                .otherwise(_texts(fv.CHECKLIST_DEFAULT)).alias("checklist"))
    )


def plan(
    findings: DataFrame, checklists: DataFrame, keys: Sequence[str] = ("project_id",), limit: int | None = None
) -> DataFrame:
    """Short phrases for critical, then high, then medium findings; the checklist when there are none."""
    rank = severity_rank(F.col("severity"))
    phrases = _first_per(
        findings.filter(rank >= 2), keys, G.fix_phrase(F.col("category"), F.col("title")), [(-rank).alias("r")]
    )
    listed = _listed(phrases, keys, limit)
    closed = F.transform("checklist", lambda t: F.when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit("."))))
    return checklists.join(listed, list(keys), "left").select(
        *keys, F.coalesce("_items", _cut(closed, limit)).alias("plan")
    )


def next_steps(limit: int | None = None) -> Column:
    """Steps by category present, in any spelling, in fixed order, ended by the retest; with `limit` at most so many."""
    steps = F.array_compact(F.array(
        *[F.when(F.col(f"says_{key}") > 0, text) for key, text in fv.NEXT_STEPS], F.lit(fv.NEXT_STEP_LAST)
    ))
    return _cut(steps, limit)


def first_fix(findings: DataFrame, judged: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """The one finding to fix first under each policy; nulls for a unit without findings.

    Severity order decides; a finding that a blocker speaks of goes before all others. The best
    candidate per kind of blocker is a minimum over the findings, so the choice under any
    number of policies is made afterwards, among five candidates per unit.
    """
    rank = severity_rank(F.col("severity"))
    sort_rank = F.when(rank > 0, 4 - rank).otherwise(9)
    shown = F.struct(sort_rank.alias("r"), *POSITION, "title", "severity", "category")
    category = F.lower("category")
    best = findings.groupBy(*keys).agg(
        F.min(F.when(category.contains("secret"), shown)).alias("_secret"),
        F.min(F.when(category.contains("approval"), shown)).alias("_approval"),
        F.min(F.when(category.contains("tool"), shown)).alias("_tool"),
        F.min(F.when(rank == 4, shown)).alias("_critical"),
        F.min(shown).alias("_any"),
    )
    speaks = lambda word: F.exists("blockers", lambda b: F.lower(b).contains(word))
    matched = F.least(
        F.when(speaks("secret"), F.col("_secret")), F.when(speaks("approval"), F.col("_approval")),
        F.when(speaks("tool"), F.col("_tool")), F.when(speaks("critical"), F.col("_critical")),
    )
    return (
        judged.join(best, list(keys), "left").withColumn("_first", F.coalesce(matched, F.col("_any")))
        .select(*keys, "policy_id", "decision", *[F.col(f"_first.{c}") for c in ("path", "line_no", "title", "severity", "category")])
    )


def linked(findings: DataFrame, artifacts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Findings with the first artifact that points at them, nulls where there is none."""
    first = first_rows(artifacts, [*keys, "finding_id"], ["ord"], 1, "_n").select(
        *keys, F.col("finding_id").alias("id"), *columns
    )
    return findings.join(first, [*keys, "id"], "left")


def unidentified(findings: DataFrame) -> DataFrame:
    """Findings without an id, which no artifact can point at; must be empty."""
    return findings.filter(F.coalesce(F.trim("id"), F.lit("")) == "")


def by_severity(findings: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Findings with `ord`: the most severe first, finding order on ties."""
    ranked = findings.withColumn("_least", -severity_rank(F.col("severity")))
    return number_rows(ranked, keys, ["_least", *POSITION, "title"], "ord").drop("_least")


def dangling(artifacts: DataFrame, findings: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Artifacts that point at no finding of their unit; must be empty."""
    ids = findings.select(*keys, F.col("id").alias("finding_id"))
    return artifacts.join(ids, [*keys, "finding_id"], "left_anti")
