"""The deployment gate: BLOCK, REVIEW or ALLOW for a report under a policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.reuse import built_once
from .score import SEVERITIES

POLICY_TYPES = {name: "int" if name == "minimum_safety_score" else "boolean" for name in fv.DEFAULT_POLICY}


def _with_defaults(value) -> list[Column]:
    return [
        F.coalesce(value(name).cast(kind), F.lit(fv.DEFAULT_POLICY[name]).cast(kind)).alias(name)
        for name, kind in POLICY_TYPES.items()
    ]


def under_policies(reports: DataFrame, policies: dict[str, dict]) -> DataFrame:
    """Each report once per named policy. The policies are literals, so nothing is joined."""
    structs = [
        F.struct(F.lit(policy_id).alias("policy_id"), *_with_defaults(lambda n, p=policy: F.lit(p.get(n))))
        for policy_id, policy in policies.items()
    ]
    return reports.select("*", F.inline(F.array(*structs)))


def under_requests(reports: DataFrame, requests: DataFrame, on: Sequence[str] = ("report_id",)) -> DataFrame:
    """Reports joined with requests to judge them; unset policy columns fall back to the defaults."""
    set_by_request = lambda n: F.col(n) if n in requests.columns else F.lit(None)
    others = [c for c in requests.columns if c not in POLICY_TYPES]
    return reports.join(requests.select(*others, *_with_defaults(set_by_request)), list(on))


@built_once
def _verdict_columns() -> list[dict[str, Column]]:
    score, minimum = F.col("safety_score"), F.col("minimum_safety_score")
    critical = F.col("gate_critical") > 0
    checks = F.array(
        F.when(score < minimum, F.format_string(fv.BLOCKER_SCORE, minimum.cast("string"))),
        F.when(F.col("block_on_critical") & critical,
               F.format_string(fv.BLOCKER_CRITICAL, F.col("gate_critical").cast("string"))),
        F.when(F.col("block_on_secrets") & (F.col("blocking_secrets") > 0), fv.BLOCKER_SECRETS),
        F.when(F.col("block_on_missing_approval") & (F.col("blocking_approvals") > 0), fv.BLOCKER_APPROVAL),
        F.when(F.col("block_on_unsafe_tools") & (F.col("blocking_tools") > 0), fv.BLOCKER_TOOLS),
    )
    blockers, n = F.col("blockers"), F.size("blockers")
    decided = F.col("decision")
    decision = (
        F.when(n > 0, "BLOCK").when((F.col("gate_high") > 0) | (F.col("gate_medium") > 0), "REVIEW").otherwise("ALLOW")
    )
    penalty = F.least(n * fv.BLOCKER_PENALTY, F.lit(fv.BLOCKER_PENALTY_CAP)) + F.when(critical, fv.CRITICAL_PENALTY).otherwise(0)

    def by_decision(texts: dict[str, str]) -> Column:
        return F.when(decided == "BLOCK", texts["BLOCK"]).when(decided == "REVIEW", texts["REVIEW"]).otherwise(texts["ALLOW"])

    def words(*items: str) -> Column:
        return F.array(*[F.lit(i) for i in items])

    def when_blocked(word: str, action: str) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.exists(blockers, lambda b: F.lower(b).contains(word)), words(action)).otherwise(none)

    counted = F.format_string(fv.GATE_SUMMARIES["BLOCK"], score.cast("string"), minimum.cast("string"), n.cast("string"))
    block_actions = F.concat(
        when_blocked("secret", fv.BLOCK_ACTION_SECRET), words(*fv.BLOCK_ACTIONS),
        when_blocked("approval", fv.BLOCK_ACTION_APPROVAL), when_blocked("tool", fv.BLOCK_ACTION_TOOL),
    )
    actions = (
        F.when(decided == "BLOCK", block_actions)
        .when(decided == "REVIEW", words(*fv.REVIEW_ACTIONS)).otherwise(words(*fv.ALLOW_ACTIONS))
    )
    return [
        {"blockers": F.array_compact(checks)},
        {"decision": decision, "gate_score": F.greatest(F.lit(0), F.least(F.lit(100), score - penalty))},
        {"gate_summary": F.when(decided == "BLOCK", counted).otherwise(by_decision(fv.GATE_SUMMARIES)),
         "decision_badge": by_decision(fv.DECISION_BADGES), "required_action": by_decision(fv.REQUIRED_ACTIONS),
         "next_actions": actions},
        {"decision_reason": F.coalesce(F.try_element_at(blockers, F.lit(1)), F.col("gate_summary"))},
    ]


def judge(reports: DataFrame) -> DataFrame:
    """Adds blockers, decision, gate score, reasons and next actions.

    Needs the columns of `score.scored` and of a policy.
    """
    for columns in _verdict_columns():
        reports = reports.withColumns(columns)
    return reports


@built_once
def gate_document() -> Column:
    """The gate result as one nested value, for saved reports."""
    return F.struct(
        "decision", "decision_badge", "minimum_safety_score", "safety_score", "gate_score", "blockers",
        F.struct(*POLICY_TYPES).alias("recommended_policy"), F.col("gate_summary").alias("summary"),
        "decision_reason", "required_action", "next_actions",
        F.create_map(
            F.lit("secret_exposure"), "blocking_secrets", F.lit("human_approval"), "blocking_approvals",
            F.lit("tool_permission"), "blocking_tools",
        ).alias("category_blocker_counts"),
        F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.col(f"gate_{s}"))]).alias("severity_counts"),
    )


def policy_json() -> Column:
    """Policy and verdict as pretty-printed JSON, to be handed to a release job."""
    return F.to_json(
        F.struct(
            F.struct(*POLICY_TYPES).alias("policy"), "decision", "minimum_safety_score", "blockers",
            F.struct(
                F.col("blocking_secrets").alias("secret_exposure"), F.col("blocking_approvals").alias("human_approval"),
                F.col("blocking_tools").alias("tool_permission"),
            ).alias("category_blocker_counts"),
        ), {"pretty": "true"},
    )


def decision_or_fallback(decision: Column, score: Column) -> Column:
    """The stored decision, or one by score alone for reports saved without a gate."""
    by_score = (
        F.when(score >= fv.FALLBACK_ALLOW_SCORE, "ALLOW").when(score >= fv.FALLBACK_REVIEW_SCORE, "REVIEW").otherwise("BLOCK")
    )
    return F.coalesce(F.nullif(decision, F.lit("")), by_score)
