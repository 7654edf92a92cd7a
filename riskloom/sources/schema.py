"""Shapes of findings and reports, and the split into valid and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..session import worked_out

FINDING = (
    "id string, title string, severity string, category string, path string, line_no int, "
    "why_it_matters string, suggested_fix string, description string, evidence string"
)
_STRING_FIELDS = ("title", "severity", "category", "file", "why_it_matters", "suggested_fix")
_OPTIONAL = ("id", "description", "evidence")
_WHOLE = r"^\s*[+-]?\d+(\.0+)?\s*$"


def validate_findings(documents: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """JSON findings split into (valid, quarantined).

    Six texts and a whole-number line are required; the three optional texts default to ''.
    Unknown fields are allowed. Quarantined rows keep their document and the reason.
    """
    parsed = F.try_parse_json(F.col(body))
    get = lambda f, t: F.try_variant_get("_v", f"$.{f}", t)
    kind = lambda f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant"))
    line = get("line", "string")
    reason = F.when(F.col("_v").isNull(), "not json").when(~F.schema_of_variant("_v").startswith("OBJECT"), "not an object")
    for f in _STRING_FIELDS:
        reason = reason.when(F.coalesce(kind(f), F.lit("")) != "STRING", f"{f} is not a text")
    whole = line.rlike(_WHOLE) & F.expr("try_cast(_line AS double)").isNotNull()
    for f in _OPTIONAL:
        reason = reason.when(F.coalesce(kind(f), F.lit("STRING")) != "STRING", f"{f} is not a text")
    reason = reason.when(~F.coalesce(whole, F.lit(False)), "line is not a whole number")
    checked = worked_out(documents, lambda rows: rows.withColumn("_v", parsed).withColumn("_line", line).withColumn("reason", reason))
    keep = [c for c in documents.columns if c != body]
    valid = checked.filter(F.col("reason").isNull()).select(
        *keep, F.coalesce(get("id", "string"), F.lit("")).alias("id"), get("title", "string").alias("title"),
        get("severity", "string").alias("severity"), get("category", "string").alias("category"),
        get("file", "string").alias("path"), F.expr("try_cast(try_cast(_line AS double) AS int)").alias("line_no"),
        get("why_it_matters", "string").alias("why_it_matters"), get("suggested_fix", "string").alias("suggested_fix"),
        *[F.coalesce(get(f, "string"), F.lit("")).alias(f) for f in ("description", "evidence")],
    )
    return valid, checked.filter(F.col("reason").isNotNull()).select(*keep, body, "reason")


_REPORT_TEXTS = ("project_name", "scan_type", "status")
_REPORT_NUMBERS = (
    "safety_score", *[f"summary.{s}" for s in fv.SEVERITY_RANKS], *[f"category_scores.{k}" for k in fv.CATEGORY_WEIGHTS],
)
_REPORT_LISTS = ("findings", "graph.nodes", "graph.edges", "attack_replay", "remediation_checklist")


def validate_reports(documents: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """JSON reports split into (valid, quarantined).

    Texts, whole numbers and lists of a report are required, and every finding in it must pass the
    rules for findings. Unknown fields are allowed.
    """
    parsed = F.try_parse_json(F.col(body))
    kind = lambda v, f: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")), F.lit(""))
    whole = lambda v, f: F.coalesce(F.try_variant_get(v, f"$.{f}", "string").rlike(_WHOLE), F.lit(False))

    def sound(finding):
        ok = whole(finding, "line")
        for f in _STRING_FIELDS:
            ok = ok & (kind(finding, f) == "STRING")
        return ok

    reason = F.when(F.col("_v").isNull(), "not json").when(~F.schema_of_variant("_v").startswith("OBJECT"), "not an object")
    for f in _REPORT_TEXTS:
        reason = reason.when(kind("_v", f) != "STRING", f"{f} is not a text")
    for f in _REPORT_NUMBERS:
        reason = reason.when(~whole("_v", f), f"{f} is not a whole number")
    for f in _REPORT_LISTS:
        reason = reason.when(~kind("_v", f).startswith("ARRAY"), f"{f} is not a list")
    listed = F.try_variant_get("_v", "$.findings", "array<variant>")
    reason = reason.when(~F.forall(listed, sound), "a finding is not valid")
    checked = worked_out(documents, lambda rows: rows.withColumn("_v", parsed).withColumn("reason", reason))
    keep = [c for c in documents.columns if c != body]
    get = lambda f, t: F.try_variant_get("_v", f"$.{f}", t).alias(f.replace(".", "_"))
    valid = checked.filter(F.col("reason").isNull()).select(
        *keep, *[get(f, "string") for f in _REPORT_TEXTS],
        *[F.try_variant_get("_v", f"$.{f}", "string").cast("double").cast("int").alias(f.replace(".", "_")) for f in _REPORT_NUMBERS],
        F.size(listed).alias("n_findings"),
    )
    return valid, checked.filter(F.col("reason").isNotNull()).select(*keep, body, "reason")
