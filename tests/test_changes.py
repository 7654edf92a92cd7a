"""Edited and deleted files: found by looks at a folder, taken back from the scores of a stream."""

import os

import pytest

from riskloom.operators import gate, score
from riskloom.operators.scan import scan
from riskloom.sources import reports, snapshots, trees
from riskloom.streaming import scan_stream
from test_sources import write_tree


def seen(changes):
    return sorted((r.project_id, r.path, r.change, r.removed, r.version, r.text) for r in changes.collect())


def test_looks(spark, tmp_path):
    root, store = str(tmp_path / "root"), str(tmp_path / "looks")
    write_tree(root, {"p/a.py": "x = 1", "p/odd name+1%20.txt": "odd", "p/logo.png": "no", "q/b.py": "y = 1", "q/deep/c.py": "z"})
    assert [r[:4] for r in seen(snapshots.look(spark, root, store))] == [
        ("p", "a.py", "added", False), ("p", "odd name+1%20.txt", "added", False), ("q", "b.py", "added", False), ("q", "deep/c.py", "added", False)]
    assert seen(snapshots.look(spark, root, store)) == []
    write_tree(root, {"p/a.py": "x = 2", "q/b.py": "y = 1", "r/new.py": "n"})
    # Same size, and a time before all others: only the digest tells.
    os.utime(os.path.join(root, "p/a.py"), (1_000_000_000, 1_000_000_000))
    os.remove(os.path.join(root, "q/deep/c.py"))
    assert seen(snapshots.look(spark, root, store)) == [
        ("p", "a.py", "changed", False, 3, "x = 2"), ("q", "deep/c.py", "removed", True, 3, None), ("r", "new.py", "added", False, 3, "n")]
    for name in ("p/a.py", "p/odd name+1%20.txt", "q/b.py", "r/new.py"):
        os.remove(os.path.join(root, name))
    assert {r[2] for r in seen(snapshots.look(spark, root, store))} == {"removed"}
    assert seen(snapshots.look(spark, root, store)) == [] and snapshots.last_look(spark, store) == 5


def test_an_unfinished_look_is_done_again(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "root"), str(tmp_path / "looks")
    write_tree(root, {"p/a.py": "x = 1"})
    snapshots.look(spark, root, store)
    write_tree(root, {"p/b.py": "def delete_all(x):"})
    real = spark.createDataFrame

    def fails(data, *args, **kw):
        if data == [(2,)]:
            raise RuntimeError("lost")
        return real(data, *args, **kw)

    monkeypatch.setattr(spark, "createDataFrame", fails)
    with pytest.raises(RuntimeError):
        snapshots.look(spark, root, store)
    monkeypatch.undo()
    assert [r[1:3] for r in seen(snapshots.look(spark, root, store))] == [("b.py", "added")]


def test_scores_follow_edits_and_removals(spark, tmp_path):
    root, looks, store, where = (str(tmp_path / n) for n in ("root", "looks", "store", "cp"))

    def now():
        snapshots.look(spark, root, looks)
        scan_stream.start_reports(snapshots.feed(spark, looks), store, where).awaitTermination()
        rows = reports.load(spark, store).orderBy("created_at").collect()
        return {r.project_id: r.safety_score for r in rows}, len(rows)

    write_tree(root, {"p/a.py": "def issue_refund(x):", "p/b.py": "x = 1", "p/ai_prompt.md": "You are", "q/c.py": "def delete_all(x):"})
    first, n = now()
    assert first["p"] < 100 and first["q"] < 100 and n == 2
    write_tree(root, {"p/a.py": "x = 'harmless'"})
    second, n = now()
    assert first["p"] < second["p"] < 100 and second["q"] == first["q"] and n == 3
    os.remove(os.path.join(root, "p/ai_prompt.md"))
    os.remove(os.path.join(root, "q/c.py"))
    third, n = now()
    assert third == {"p": 100, "q": 100} and n == 5
    write_tree(root, {"p/a.py": "def issue_refund(x):", "p/ai_prompt.md": "You are", "q/c.py": "def delete_all(x):"})
    assert now()[0] == first
    assert now()[1] == 7


def batches(spark, folder, parts):
    out = []
    for rows in parts:
        spark.createDataFrame(rows, "project_id string, path string, text string, version long, removed boolean").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        files = spark.readStream.schema("project_id string, path string, text string, version long, removed boolean").parquet(f"{folder}/in")
        query = scan_stream.changed_counts(files).writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        out.append(query.recentProgress[-1].stateOperators[0])
    return out


def test_running_sums_equal_a_scan_of_what_is_there(spark, tmp_path):
    risky, prompt, secret = "def issue_refund(x):\ndef get_customer_profile(c):", "You are", 'API_KEY = "0123456789abcdef"'
    parts = [
        [("p", "a.py", risky, 1, False), ("p", "my_prompt.md", prompt, 1, False), ("q", "a.py", secret, 1, False), ("r", "a.py", "x", 1, False)],
        [("p", "a.py", secret, 3, False), ("p", "my_prompt.md", "", 3, True), ("q", "b.py", risky, 3, False)],
        [("p", "a.py", risky, 2, False), ("q", "a.py", "", 4, True), ("p", "c.py", risky, 4, False), ("p", "c.py", secret, 5, False)],
        [("p", "c.py", secret, 5, False)],
    ]
    updated = batches(spark, str(tmp_path), parts)
    # State rows written by a batch follow the files it touches; an outdated version writes none.
    assert [p.numRowsUpdated for p in updated] == [4, 3, 2, 1] and updated[-1].numRowsTotal == 6
    deltas = spark.read.schema(scan_stream.DELTAS).parquet(f"{tmp_path}/out")
    there = [("p", "a.py", secret), ("q", "b.py", risky), ("p", "c.py", secret), ("r", "a.py", "x")]
    files = spark.createDataFrame(there, "project_id string, path string, text string")
    want = score.facts(scan(files, brief=True), files)
    plain = lambda df: sorted(map(tuple, gate.judge(gate.under_policies(score.scored(df), {"d": {}})).drop("blockers").collect()))
    assert score.running(deltas).columns == want.columns
    assert sorted(map(tuple, score.running(deltas).collect())) == sorted(map(tuple, want.collect()))
    assert plain(score.running(deltas)) == plain(want)


def test_every_file_is_seen_by_the_scan(spark):
    files = spark.createDataFrame([("p", "a.py", ""), ("p", "b.py", "def issue_refund(x):")], "project_id string, path string, text string")
    rows = scan(files, rules=["tool", "file"]).collect()
    assert sorted((r.path, r.rule, r.severity) for r in rows) == [("a.py", "file", None), ("b.py", "file", None), ("b.py", "tool", "Critical")]


def test_columns_kept_beside_the_text(spark, tmp_path):
    write_tree(str(tmp_path), {"p/a.py": "x"})
    found = trees.from_binary(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)), str(tmp_path), ["length"])
    assert [(r.project_id, r.path, r.text, r.length) for r in found.collect()] == [("p", "a.py", "x", 1)]


def test_many_small_files_share_tasks(spark, tmp_path, monkeypatch):
    from riskloom.sources import snapshots

    root = tmp_path / "root" / "p"
    root.mkdir(parents=True)
    for i in range(400):
        (root / f"f{i}.py").write_text(f"x = {i}")
    parts, settle = [], snapshots.settle
    monkeypatch.setattr(snapshots, "settle", lambda df: parts.append(df.rdd.getNumPartitions()) or settle(df))
    assert snapshots.look(spark, str(tmp_path / "root"), str(tmp_path / "store")).count() == 400
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism
