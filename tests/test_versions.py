"""Report documents of several versions in one shape; what a document says is in a field or among the unknown."""

import json

import pytest

from riskloom.sources import versions

FINDING = {"title": "t", "severity": "High", "category": "Secret Exposure Risk", "file": "a.py", "line": 3, "why_it_matters": "w", "suggested_fix": "s"}
PLAIN = {
    "project_name": "p", "scan_type": "upload", "safety_score": 61, "status": "Moderate Risk",
    "summary": {"critical": 1, "high": 2, "medium": 0, "low": 0}, "category_scores": {"secret_exposure": 40}, "findings": [FINDING],
}
GATED = {**PLAIN, "deployment_gate": {"decision": "BLOCK", "blockers": ["x"]}, "report_id": "r1"}
SAVED = {**GATED, "id": "r2", "user_id": "u", "timestamp": "2024-01-01T08:00:00Z"}
TABLE = {"project_id": "u7", "safety_score": 90.0, "deployment_gate": {"decision": ""}, "findings": [{"title": "t", "path": "b.py", "line_no": 9}]}


@pytest.fixture
def lifted(spark):
    def run(*bodies, **options):
        texts = [b if b is None or isinstance(b, str) else json.dumps(b) for b in bodies]
        rows = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
        good, bad = versions.lift(rows, **options)
        return {r["n"]: r["report"] for r in good.collect()}, {r["n"]: r["reason"] for r in bad.collect()}

    return run


def unknown(row):
    return {e["name"]: json.loads(e["value"]) for e in row["unknown"]}


def test_versions_are_told_apart_and_lifted(lifted):
    good, bad = lifted(PLAIN, GATED, SAVED, TABLE)
    assert not bad
    assert [good[n]["version"] for n in range(4)] == ["plain", "gated", "saved", "table"]
    assert [good[n]["decision"] for n in range(4)] == ["REVIEW", "BLOCK", "BLOCK", "ALLOW"]
    assert [good[n]["id"] for n in range(4)] == [None, "r1", "r2", None]
    assert good[2]["created_at"] == "2024-01-01T08:00:00Z"
    assert good[3]["project_name"] == "u7" and good[3]["safety_score"] == 90
    assert (good[0]["summary"]["high"], good[0]["category_scores"]["secret_exposure"], good[0]["category_scores"]["auditability"]) == (2, 40, None)
    assert [(good[n]["findings"][0]["path"], good[n]["findings"][0]["line_no"]) for n in (0, 2, 3)] == [("a.py", 3), ("a.py", 3), ("b.py", 9)]


def test_nothing_is_lost(lifted):
    odd = {
        **SAVED, "created_at": "2024-01-02T00:00:00Z", "safety_score": "high", "extra": [1, {"a": None}], "nothing": None,
        "summary": {"critical": 1.5, "info": 4}, "category_scores": "none", "summary.info": 5,
        "findings": [{**FINDING, "cwe": 79, "line": 2**40}, 7, None],
    }
    good, _ = lifted(odd)
    rest = [(e["name"], json.loads(e["value"])) for e in good[0]["unknown"]]
    assert sorted(rest, key=str) == sorted([
        ("timestamp", "2024-01-01T08:00:00Z"), ("safety_score", "high"), ("extra", [1, {"a": None}]), ("nothing", None), ("summary.critical", 1.5),
        ("summary.info", 4), ("summary.info", 5), ("category_scores", "none"), ("deployment_gate.blockers", ["x"]), ("report_id", "r1"),
    ], key=str)
    assert good[0]["safety_score"] is None and good[0]["decision"] == "BLOCK" and good[0]["created_at"] == "2024-01-02T00:00:00Z"
    assert [unknown(f) for f in good[0]["findings"]] == [{"cwe": 79, "line": 2**40}, {"": 7}, {"": None}]
    good, _ = lifted({**PLAIN, "findings": "many"})
    assert good[0]["findings"] is None and unknown(good[0]) == {"findings": "many"}


def test_rejected(lifted, spark):
    good, bad = lifted(None, "", "{", "[1]", "{}", '{"safety_score": 1, "safety_score": 2, "findings": []}', {"safety_score": None, "findings": []})
    assert not good
    assert bad == {0: "not json", 1: "not json", 2: "not json", 3: "not an object", 4: "no known version", 5: "not json", 6: "no known version"}
    empty = versions.lift(spark.createDataFrame([], "body string, report int, reason int"))
    assert [d.count() for d in empty] == [0, 0]
    assert empty[0].columns == ["reason", "report"] and empty[1].columns == ["body", "report", "reason"]


def test_own_versions(lifted):
    own = {"old": versions.Version(("score", "items"), {"safety_score": ("score",), "summary.high": ("counts.serious",)})}
    good, bad = lifted({"score": 12, "items": [], "counts": {"serious": 3, "rest": 1}}, PLAIN, versions=own)
    assert (good[0]["version"], good[0]["safety_score"], good[0]["summary"]["high"], good[0]["decision"]) == ("old", 12, 3, "BLOCK")
    assert unknown(good[0]) == {"items": [], "counts.rest": 1}
    assert bad == {1: "no known version"}
    with pytest.raises(ValueError):
        lifted(PLAIN, versions={"odd": versions.Version(("it's",))})


def test_nothing_is_exchanged(spark):
    rows = spark.createDataFrame([(1, "{}")], "n int, body string")
    for part in versions.lift(rows):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


def test_rows_of_one_file_are_dealt_to_tasks(spark, tmp_path):
    """One file is one task; what is made of its documents is not."""
    from riskloom.sources import schema

    body = """concat('{"safety_score": ', id, ', "findings": [], "x": 1', if(id % 4 = 0, '', '}'))"""
    spark.range(400).selectExpr("id", f"{body} AS body").coalesce(1).write.parquet(str(tmp_path / "one"))
    docs = spark.read.parquet(str(tmp_path / "one"))
    assert len(docs.inputFiles()) == 1
    for split, good in ((versions.lift, 300), (schema.validate_reports, 0), (schema.validate_findings, 0)):
        taken, left = split(docs)
        assert len(taken.inputFiles()) > 1 and len(left.inputFiles()) > 1
        assert (taken.count(), left.count()) == (good, 400 - good)
