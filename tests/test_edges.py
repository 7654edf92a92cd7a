"""Inputs that used to be lost, cut or misread."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions.entries import Limits
from riskloom.operators import gate, guidance, history, lines as L, numbering, score
from riskloom.operators.scan import scan
from riskloom.sources import archives, reports, trees
from riskloom.streaming import scan_stream
from test_sources import make_zip, write_tree

FINDING = "project_id string, path string, line_no int, stage int, sub_ord int, title string, severity string, category string, suggested_fix string, evidence string, id string"


def findings(spark, rows):
    return spark.createDataFrame([("p", "a.py", i, 1, 0, f"t{i}", s, c, f"fix {i}", "e", f"x_{i:03d}") for i, (s, c) in enumerate(rows)], FINDING)


def judged(spark, rows, policy=None):
    units = spark.createDataFrame([("p",), ("q",)], "project_id string")
    facts = score.facts(findings(spark, rows), units)
    return gate.judge(gate.under_policies(score.scored(facts), {"x": policy or {}}))


def test_padded_severity_blocks(spark):
    rows = {r.project_id: r for r in judged(spark, [(" Critical ", "x")], {"minimum_safety_score": 0}).collect()}
    assert (rows["p"].decision, rows["p"].n_critical, rows["p"].gate_critical) == ("BLOCK", 0, 1)
    assert rows["q"].decision == "ALLOW"


def test_next_steps_of_any_spelling(spark):
    rows = judged(spark, [("Low", "SECRETS in code"), ("Low", "customer data")]).withColumn("steps", guidance.next_steps()).collect()
    texts = dict(fv.NEXT_STEPS)
    assert {r.project_id: r.steps for r in rows} == {
        "p": [texts["secret_exposure"], texts["data_exposure"], fv.NEXT_STEP_LAST], "q": [fv.NEXT_STEP_LAST]}


def test_first_fix_keeps_units_without_findings(spark):
    rows = findings(spark, [("High", "Tool Permission Risk")])
    out = guidance.first_fix(rows, judged(spark, [("High", "Tool Permission Risk")])).collect()
    assert {r.project_id: r.title for r in out} == {"p": "t0", "q": None}


def test_lists_are_whole_without_a_limit(spark):
    rows = findings(spark, [("High", "Tool Permission Risk")] * 11)
    assert [r.ord for r in guidance.fixes(rows).orderBy("ord").collect()] == list(range(1, 12))
    assert guidance.scenarios(rows).count() == 11 and guidance.scenarios(rows, limit=8).count() == 8
    facts = score.facts(rows, rows)
    assert len(guidance.checklist(rows, facts).collect()[0].checklist) > 11
    assert len(guidance.checklist(rows, facts, limit=8).collect()[0].checklist) == 8


def test_changes_keep_rows_without_time_or_name(spark):
    rows = [("a", "u", "p", 1, 50), ("b", "u", "p", 2, 60), ("c", "u", "p", None, 70), ("d", "u", None, 1, 10), ("e", "u", None, 2, 5), ("f", None, None, None, 1)]
    df = spark.createDataFrame(rows, "id string, user_id string, project_name string, t int, safety_score int").withColumn(
        "created_at", F.timestamp_seconds(F.col("t") * 100_000))
    got = {r.id: r.score_delta for r in history.score_changes(df).collect()}
    assert got == {"a": None, "b": 10, "c": None, "d": None, "e": -5, "f": None}
    numbered = numbering.number_rows(df, ["project_name"], ["id"], "n").collect()
    assert {r.id: r.n for r in numbered} == {"a": 1, "b": 2, "c": 3, "d": 1, "e": 2, "f": 3}


def test_secret_across_the_cut_is_masked(files_of):
    line = " " * 4 + "x" * 190 + ' = 1; API_KEY = "abcdefghijklmnopqrstuvwxyz0123456789abcdefghij"'
    files = files_of({"p": {"a.py": line}})
    for chars in (None, 220):
        rows = scan(files, rules=["secret"], evidence_chars=chars).collect()
        assert rows and all("abcdefgh" not in r.evidence and "***" in r.evidence for r in rows)
    table = files.sparkSession.createDataFrame([("p", "a.py", 1, line)], "project_id string, path string, line_no int, line string")
    looked_up = L.with_evidence(scan(files, rules=["secret"]), table).collect()
    assert all("abcdefgh" not in r.evidence for r in looked_up)


@pytest.mark.parametrize("tail, found", [("", 1), ("]", 0), (", x", 0)])
def test_deep_json(files_of, tail, found):
    depth = 100_000
    text = '{"email": ' + "[" * depth + '{"k": -1.5e3, "t": "a\\"]"}' + "]" * depth + tail + "}"
    assert scan(files_of({"p": {"a.json": text}}), rules=["json"]).count() == found


def test_absent_file_is_skipped(spark):
    rows = findings(spark, [("High", "x"), ("High", "y")])
    files = spark.createDataFrame([("p", "b.py")], "project_id string, path string")
    assert L.in_files(rows, files).count() == 0
    assert L.in_files(rows, files.withColumn("path", F.lit("a.py"))).count() == 2


def test_root_name_again_below(spark, tmp_path):
    write_tree(tmp_path, {"R/proj1/R/main.py": "x = 1", "R/proj2/R/R/a.py": "y = 2"})
    got = {(r.project_id, r.path) for r in trees.read_trees(spark, str(tmp_path / "R")).collect()}
    assert got == {("proj1", "R/main.py"), ("proj2", "R/R/a.py")}
    assert trees.lost_files(spark, str(tmp_path / "R")).count() == 0


def test_archives_of_one_name_and_damage_nobody_reads(spark, tmp_path):
    good = make_zip([("src/a.py", "x = 1"), ("node_modules/b.js", "ABCDEFGH" * 40)])
    broken = bytearray(make_zip([("node_modules/b.js", "x")]))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("src/a.py", "y = 2")
        z.writestr("node_modules/b.js", "MARKMARK")
    damaged = buffer.getvalue().replace(b"MARKMARK", b"MARKMURK")
    assert broken
    write_tree(tmp_path, {"a/app.zip": good, "b/app.zip": damaged})
    rows = archives.judged(archives.expand(archives.read_archives(spark, str(tmp_path))))
    assert {r.archive_id: r.rejected for r in rows.collect()} == {"a/app.zip": None, "b/app.zip": None}
    assert {(r.project_id, r.path, r.text) for r in archives.files_of(rows).collect()} == {
        ("a/app.zip", "src/a.py", "x = 1"), ("b/app.zip", "src/a.py", "y = 2")}
    assert {(r.archive_id, r.name, r.reason) for r in archives.left_out(rows).collect()} == {
        (f"{d}/app.zip", "node_modules/b.js", "blocked_dir") for d in "ab"}


def test_limits_are_the_callers(spark):
    zipped = make_zip([(f"f{i}.py", "x" * 50) for i in range(5)])
    df = spark.createDataFrame([("a", len(zipped), zipped)], "archive_id string, archive_bytes bigint, content binary")
    for limits, reason in ((Limits(), None), (Limits(entries=4), "too_many_entries"), (Limits(kept_bytes=249), "too_many_bytes"),
                           (Limits(archive_bytes=3), "archive_too_large"), (Limits(depth=0), "too_deep")):
        rows = archives.judged(archives.expand(df, limits), limits)
        assert [r.rejected for r in rows.collect()] == [reason]
        assert archives.left_out(rows, limits).count() == (reason is not None)


def test_smaller_repeat_replaces_the_batch(spark, tmp_path):
    rows = [(f"u{i}", f"r{i}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "user_id string, id string, safety_score int")
    store = str(tmp_path / "s")
    reports.append(df, store, "b")
    reports.append(df.limit(1), store, "b")
    assert reports.load(spark, store).count() == 1
    reports.append(df, store, "c")
    assert {r.id for r in reports.load(spark, store, ["u3", "u9"]).collect()} == {"r3", "r9"}
    assert reports.one(spark, store, "u3", "r9").count() == 0 and reports.one(spark, store, "u9", "r9").count() == 1
    plan = reports.load(spark, store, ["u3"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_unreadable_delete_list_is_an_error(spark, tmp_path):
    import shutil

    df = spark.createDataFrame([("u", "r", 1)], "user_id string, id string, safety_score int")
    reports.append(df, str(tmp_path / "s"), "b")
    (tmp_path / "t").mkdir()
    shutil.copytree(tmp_path / "s" / "reports", tmp_path / "t" / "reports")
    with pytest.raises(Exception):
        reports.load(spark, str(tmp_path / "t")).count()


def test_stream_begins_without_findings(spark, tmp_path):
    inbox, store, where = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    run = lambda: scan_stream.start_reports(scan_stream.stream_trees(spark, inbox), store, where).awaitTermination()
    write_tree(inbox, {"p1/a.py": "x = 1\n"})
    run()
    assert [(r.project_id, r.safety_score) for r in reports.load(spark, store).collect()] == [("p1", 100)]
    write_tree(inbox, {"p1/b.py": "def delete_record(x):\n"})
    run()
    scores = sorted(r.safety_score for r in reports.load(spark, store).collect())
    assert len(scores) == 2 and scores[0] < 100


def test_daily_scores_on_a_stream(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", "p", s) for d, h, s in ((1, 1, 10), (1, 2, 30), (2, 1, 50), (5, 1, 90))]
    df = spark.createDataFrame(rows, "t string, project_name string, safety_score int").select(
        F.to_timestamp("t").alias("created_at"), "project_name", "safety_score")
    df.write.parquet(str(tmp_path / "in"))
    stream = history.daily_scores(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r.day)[:10], r.reports, r.lowest, r.highest) for r in spark.table("daily").collect()}
    assert got == {("2024-01-01", 2, 10, 30), ("2024-01-02", 1, 50, 50), ("2024-01-05", 1, 90, 90)}


def test_late_reports_count(spark, tmp_path):
    at = lambda t, s: spark.createDataFrame([(t, "p", s)], "t string, project_name string, safety_score int").select(
        F.to_timestamp("t").alias("created_at"), "project_name", "safety_score")
    inbox, where = str(tmp_path / "in"), str(tmp_path / "cp")
    seen = []
    for t, score in (("2024-01-01 01:00:00", 10), ("2024-02-01 01:00:00", 50), ("2024-01-01 02:00:00", 30)):
        at(t, score).write.mode("append").parquet(inbox)
        stream = history.daily_scores(spark.readStream.schema(at(t, score).schema).parquet(inbox))
        keep = lambda df, _: seen.extend((str(r.day)[:10], r.reports, r.highest) for r in df.collect())
        stream.writeStream.outputMode("update").option("checkpointLocation", where).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert ("2024-01-01", 2, 30) in seen


def test_files_do_not_depend_on_event_numbers(spark, tmp_path):
    """A file goes on over the event id at which tables used to be cut."""
    from riskloom.plans import corpus

    rows = [(131_072 + i, 1, "{}") for i in range(-3, 3)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, props string").withColumn("ts", F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    events.write.parquet(str(tmp_path / "events.parquet"))
    for layout in ("project", "snapshot"):
        found = corpus.lines(spark, str(tmp_path), layout).collect()
        assert len({r.path for r in found}) == 1 and sorted(r.line_no for r in found) == list(range(1, 7))
