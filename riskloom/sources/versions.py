"""Report documents of several versions, lifted to one shape without losing fields.

A document is held as a VARIANT, so a schema that does not know a member loses nothing. The first version
whose marks a document has says where its fields stand; what no field takes stays in `unknown`, member by
member as JSON, in the report as in each finding. All of it happens in the document's own row, once the rows are dealt evenly over tasks.

Versions are data: a caller hands in own ones, alone or beside `VERSIONS`.

Cases: a null or broken document, or one that names a member twice, is rejected as not json; an empty table gives two
empty tables; repeated documents are lifted each by itself; a column named `report`
(of rejected rows `reason`) is replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..operators.gate import decision_or_fallback
from ..session import worked_out


class Version(NamedTuple):
    """`marks`: members (nested ones dotted) that a document of this version has, of any value but null.

    `fields` and `finding`: where a field stands, where that is not under its own name; of several places the first
    that has a value counts. A place is a member or, with a dot, a member of a member.
    """
    marks: Sequence[str]
    fields: Mapping[str, Sequence[str]] = {}
    finding: Mapping[str, Sequence[str]] = {}


_SCAN = {"path": ("file",), "line_no": ("line",)}
_GATE = {"decision": ("deployment_gate.decision",)}

#: The most particular first.
VERSIONS: dict[str, Version] = {
    "table": Version(("project_id", "safety_score"), {**_GATE, "project_name": ("project_name", "project_id")}),
    "saved": Version(("user_id", "safety_score", "findings"), {**_GATE, "created_at": ("created_at", "timestamp")}, _SCAN),
    "gated": Version(("deployment_gate", "safety_score", "findings"), {**_GATE, "id": ("report_id",)}, _SCAN),
    "plain": Version(("safety_score", "findings"), finding=_SCAN),
}

FIELDS: dict[str, str] = {
    "id": "string", "user_id": "string", "project_name": "string", "scan_type": "string", "status": "string", "created_at": "string",
    "decision": "string", "safety_score": "int",
    **{f"summary.{s}": "int" for s in fv.SEVERITY_RANKS}, **{f"category_scores.{k}": "int" for k in fv.CATEGORY_WEIGHTS},
}
FINDING: dict[str, str] = {
    "id": "string", "title": "string", "severity": "string", "category": "string", "path": "string", "line_no": "int",
    "why_it_matters": "string", "suggested_fix": "string", "description": "string", "evidence": "string",
}


_ENTRIES = "array<struct<name:string,value:string>>"


def _path(place: str) -> str:
    if "'" in place or place.count(".") > 1:
        raise ValueError(f"a place is a member or a member of a member, without quotes: {place}")
    return "$" + "".join(f"['{part}']" for part in place.split("."))


def _has(doc: Column, place: str) -> Column:
    member = F.try_variant_get(doc, _path(place), "variant")
    return member.isNotNull() & ~F.is_variant_null(member)


def _read(doc: Column, place: str, kind: str) -> Column:
    if kind != "int":
        return F.try_variant_get(doc, _path(place), kind)
    # 28.0 is a whole number, 1.5 and what an int cannot hold are none.
    return F.regexp_extract(F.try_variant_get(doc, _path(place), "string"), r"^([+-]?\d+)(?:\.0+)?$", 1).try_cast("int")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _members(doc: Column, place: str = "") -> Column:
    return F.try_variant_get(doc, _path(place) if place else "$", "map<string,variant>")


def _left(members: Column, read: Sequence[str], taken: Sequence[Column], before: str = "") -> Column:
    """The entries of an object less those taken; of those that a field could take, null says nothing and goes too."""
    names = F.array_compact(F.array(*taken)) if taken else F.array().cast("array<string>")
    rest = F.map_filter(members, lambda k, x: ~F.array_contains(names, k) & ~(k.isin(*read) & F.is_variant_null(x)))
    listed = F.transform(F.map_entries(rest), lambda e: F.struct(F.concat(F.lit(before), e["key"]).alias("name"), _json(e["value"]).alias("value")))
    return F.coalesce(listed, F.array().cast(_ENTRIES))


def _json(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("null"))


def _nested(values: Mapping[str, Column]) -> list[Column]:
    """Fields as columns, dotted ones as structs."""
    tops = dict.fromkeys(f.split(".")[0] for f in values)
    return [
        values[t].alias(t) if t in values
        else F.struct(*(v.alias(f.split(".", 1)[1]) for f, v in values.items() if f.startswith(f"{t}."))).alias(t)
        for t in tops
    ]


def _lifted(
    doc: Column, fields: Mapping[str, str], where: Mapping[str, Sequence[str]], finish: Callable[[dict[str, Column], Column], Column],
    lists: Sequence[str] = (),
) -> Column:
    """`finish` of the fields of an object and of what none of them took, (name, value as JSON) in order of names.

    Members in `lists` are read elsewhere, if they are lists. A value that a field cannot hold is not taken, nor is a
    second place that says something else than the first.
    """
    places = {f: tuple(where.get(f, (f,))) for f in fields}
    kinds = {p: fields[f] for f, ps in places.items() for p in ps}
    at = {p: f"p{i}" for i, p in enumerate(kinds)}
    nested = sorted({p.split(".")[0] for p in kinds if "." in p} - set(kinds))

    def split(x: Column) -> Column:
        values = {f: F.coalesce(*(x[at[p]] for p in ps)) for f, ps in places.items()}
        took = {p: F.when(x[at[p]] == values[f], F.lit(p.split(".")[-1])) for f, ps in places.items() for p in ps}
        whole = [took[p] for p in took if "." not in p]
        whole += [F.when(_members(doc, t).isNotNull(), F.lit(t)) for t in nested]
        whole += [F.when(F.try_variant_get(doc, _path(name), "array<variant>").isNotNull(), F.lit(name)) for name in lists]
        parts = [_left(_members(doc), [*(p for p in took if "." not in p), *nested, *lists], whole)]
        for t in {p.split(".")[0]: None for p in took if "." in p}:
            if t in nested:
                inner = [p for p in took if p.startswith(f"{t}.")]
                parts.append(_left(_members(doc, t), [p.split(".")[-1] for p in inner], [took[p] for p in inner], f"{t}."))
        return finish(values, F.array_sort(F.concat(*parts)))

    return _let(F.struct(*(_read(doc, p, kinds[p]).alias(at[p]) for p in kinds)), split)


def _finding(where: Mapping[str, Sequence[str]]) -> Callable[[Column], Column]:
    def lifted(doc: Column) -> Column:
        whole = F.array(F.struct(F.lit("").alias("name"), _json(doc).alias("value"))).cast(_ENTRIES)
        return _lifted(doc, FINDING, where, lambda values, rest: F.struct(
            *_nested(values), F.when(_members(doc).isNull(), whole).otherwise(rest).alias("unknown")))

    return lifted


def _report(doc: Column, name: str, version: Version) -> Column:
    def finish(values: dict[str, Column], rest: Column) -> Column:
        score = values["safety_score"]
        decided = F.when(score.isNull(), values["decision"]).otherwise(decision_or_fallback(values["decision"], score))
        findings = F.transform(F.try_variant_get(doc, _path("findings"), "array<variant>"), _finding(version.finding))
        return F.struct(F.lit(name).alias("version"), *_nested(values | {"decision": decided}), findings.alias("findings"), rest.alias("unknown"))

    return _lifted(doc, FIELDS, version.fields, finish, ["findings"])


def lift(documents: DataFrame, body: str = "body", versions: Mapping[str, Version] = VERSIONS) -> tuple[DataFrame, DataFrame]:
    """JSON reports split into (lifted, rejected).

    Lifted rows have one column `report`: version, the fields of `FIELDS`, `findings` with the fields of `FINDING`, and what
    else the document says as `unknown`. Fields that a document does not name are null; a decision that it does not name
    follows from the score. Rejected rows keep their document and the reason.
    """
    v = F.col("_v")
    which = F
    for name, version in versions.items():
        fits = F.lit(True)
        for mark in version.marks:
            fits = fits & _has(v, mark)
        which = which.when(fits, F.lit(name))
    reason = F.when(v.isNull(), "not json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object").when(F.col("_version").isNull(), "no known version")
    report = F
    for name, version in versions.items():
        report = report.when((F.col("_version") == name) & F.col("_reason").isNull(), _report(v, name, version))
    marked = worked_out(documents, lambda rows: (
        rows.withColumn("_v", F.try_parse_json(F.col(body))).withColumn("_version", which).withColumn("_reason", reason)
        .withColumn("_report", report).drop("_v", "_version")))
    keep = [F.col(f"`{c}`") for c in documents.columns if c not in (body, "report")]
    held = [F.col(f"`{c}`") for c in documents.columns if c not in ("reason",)]
    return (
        marked.filter(F.col("_reason").isNull()).select(*keep, F.col("_report").alias("report")),
        marked.filter(F.col("_reason").isNotNull()).select(*held, F.col("_reason").alias("reason")),
    )
