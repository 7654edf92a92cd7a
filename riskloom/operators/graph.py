"""Permission graph of a project as two tables: nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from .scan import POSITION


def controls_at_tools(findings: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Tool findings with two flags: is the approval, the audit trail missing on this very line?"""
    spot = [*keys, "path", "line_no"]
    missing = (
        findings.filter(F.col("category").isin("Human Approval Risk", "Auditability Risk"))
        .groupBy(*spot).agg(
            F.bool_or(F.col("category") == "Human Approval Risk").alias("no_approval"),
            F.bool_or(F.col("category") == "Auditability Risk").alias("no_audit"),
        )
    )
    return (
        findings.filter(F.col("category") == "Tool Permission Risk").join(missing, spot, "left")
        .fillna(False, ["no_approval", "no_audit"])
    )


def node_name(title: Column) -> Column:
    """The function a tool finding names, else its whole title as an identifier."""
    named = F.regexp_extract(title, r"Risky function '([^']+)' detected", 1)
    return F.when(named != "", named).otherwise(F.lower(F.replace(title, F.lit(" "), F.lit("_"))))


def prompt_edge_risk(rank: Column) -> Column:
    """Risk of the user-to-agent edge: the strongest prompt finding, low when there is none."""
    return F.when(rank == 4, "critical").when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")


def edges(findings: DataFrame, unit_facts: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """All edges, repeats kept: one per tool finding and connection."""
    edge = lambda a, b, risk: F.struct(a.alias("source"), b.alias("target"), risk.alias("risk"))
    tool, risk = node_name(F.col("title")), F.lower(F.col("severity"))
    gate = F.concat(F.lit("approval_"), tool)
    agent, low = F.lit("agent"), F.lit("low")
    gated = ~F.col("no_approval")
    of_tools = controls_at_tools(findings, keys).select(*keys, F.inline(F.array(
        F.when(gated, edge(agent, gate, low)).otherwise(edge(agent, tool, risk)),
        F.when(gated, edge(gate, tool, risk)),
        F.when(~F.col("no_audit"), edge(tool, F.lit("audit_log"), low)),
    ))).filter(F.col("source").isNotNull())
    user = unit_facts.select(
        *keys, F.lit("user").alias("source"), agent.alias("target"), prompt_edge_risk(F.col("prompt_rank")).alias("risk")
    )
    return user.unionByName(of_tools)


def nodes(findings: DataFrame, unit_facts: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Distinct nodes; where an id occurs twice, the label seen first stays."""
    at = [F.col(c) for c in POSITION]
    node = lambda i, ident, label: F.struct(ident.alias("id"), F.struct(*at, F.lit(i).alias("i"), label.alias("label")).alias("seen"))
    tool = node_name(F.col("title"))
    of_tools = controls_at_tools(findings, keys).select(*keys, F.inline(F.array(
        node(0, tool, F.concat(tool, F.lit("()"))),
        F.when(~F.col("no_approval"), node(1, F.concat(F.lit("approval_"), tool), F.concat(F.lit("Approval Gate: "), tool))),
        F.when(~F.col("no_audit"), node(2, F.lit("audit_log"), F.lit("Audit Log"))),
    ))).filter(F.col("id").isNotNull())
    before_all = F.struct(
        F.lit(-1).alias("stage"), F.lit("").alias("path"), F.lit(0).alias("line_no"), F.lit(0).alias("sub_ord"),
        F.lit(0).alias("i"), F.col("label"),
    )
    fixed = unit_facts.select(*keys, F.inline(F.array(
        F.struct(F.lit("user").alias("id"), F.lit("User Prompt").alias("label")),
        F.struct(F.lit("agent").alias("id"), F.lit("LLM Agent").alias("label")),
    ))).select(*keys, "id", before_all.alias("seen"))
    first = fixed.unionByName(of_tools).groupBy(*keys, "id").agg(F.min("seen").alias("seen"))
    return first.select(*keys, "id", "seen.label")


def case_coverage(unit_facts: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """The reference cases, each with the number of findings its category has in the unit."""
    cases = F.array(*[
        F.struct(
            F.lit(name).alias("attack_type"), F.lit(severity).alias("severity"), F.lit(category).alias("category"),
            F.col(f"n_{fv.CATEGORY_KEYS[category]}").alias("findings"),
        ) for name, severity, category in fv.ATTACK_CASES
    ])
    return unit_facts.select(*keys, F.inline(cases))
