"""Trees, archives, addresses, documents, report store, streams."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions.entries import PUBLISHED, depth, leaves_target, skip_reason
from riskloom.functions.urls import repository
from riskloom.sources import archives, reports, schema, trees
from riskloom.streaming import scan_stream


def write_tree(root, tree):
    for name, data in tree.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


TREE = {
    "p1/src/a.py": "def issue_refund(x):\n", "p1/.env": "X=1", "p1/prod.env": "X=1", "p1/b.PNG": "x", "p1/README.MD": "hi",
    "p1/odd name+100%.txt": "odd", "p2/latin.txt": "caf\xe9".encode("latin-1"), "p2/utf.txt": "café", "p2/empty.json": "",
}


def test_read_trees(spark, tmp_path):
    write_tree(tmp_path, TREE)
    got = {(r.project_id, r.path): r.text for r in trees.read_trees(spark, str(tmp_path)).collect()}
    assert got == {
        ("p1", "src/a.py"): "def issue_refund(x):\n", ("p1", "prod.env"): "X=1", ("p1", "README.MD"): "hi", ("p1", "odd name+100%.txt"): "odd",
        ("p2", "latin.txt"): "café", ("p2", "utf.txt"): "café",
    }


def make_zip(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            if name.endswith("@link"):
                info = zipfile.ZipInfo(name[:-5])
                info.external_attr = 0o120777 << 16
                z.writestr(info, data)
            else:
                z.writestr(name, data)
    return buffer.getvalue()


ARCHIVES = {
    "good": make_zip([("src/a.py", "x = 1"), ("node_modules/b.js", "x"), ("yarn.lock", "x"), ("d/", ""), ("link.py@link", "a.py"),
                      ("big.py", "x" * (fv.MAX_FILE_BYTES + 1)), ("fits.py", "x" * fv.MAX_FILE_BYTES), ("logo.png", "x"), ("a/b/c/d/e/f.py", "deep")]),
    "slip": make_zip([("../x.py", "x"), ("a.py", "x")]),
    "absolute": make_zip([("/etc/x.py", "x")]),
    "deep": make_zip([("a/b/c/d/e/f/g.py", "x")]),
    "n300": make_zip([(f"f{i}.py", "x") for i in range(300)]),
    "n301": make_zip([(f"f{i}.py", "x") for i in range(301)]),
    "broken": b"this is no archive",
    "empty": make_zip([]),
}


def test_archives(spark, tmp_path):
    write_tree(tmp_path, {f"in/{k}.zip": v for k, v in ARCHIVES.items()})
    judged = archives.judged(archives.expand(archives.read_archives(spark, str(tmp_path), PUBLISHED), PUBLISHED), PUBLISHED)
    reasons = {r.archive_id[3:-4]: r.rejected for r in judged.collect()}
    assert reasons == {"good": None, "slip": "path_traversal", "absolute": "path_traversal", "deep": "too_deep", "n300": None,
                       "n301": "too_many_entries", "broken": "not_a_zip", "empty": None}
    files = archives.files_of(judged, PUBLISHED).filter("project_id = 'in/good.zip'").collect()
    assert {r.path: len(r.text) for r in files} == {"src/a.py": 5, "fits.py": fv.MAX_FILE_BYTES, "a/b/c/d/e/f.py": 4}


def test_archive_size_limit(spark):
    rows = [("at", fv.MAX_ARCHIVE_BYTES, make_zip([("a.py", "x")])), ("over", fv.MAX_ARCHIVE_BYTES + 1, make_zip([("a.py", "x")]))]
    df = spark.createDataFrame(rows, "archive_id string, archive_bytes bigint, content binary")
    got = {r.archive_id: r.rejected for r in archives.judged(archives.expand(df, PUBLISHED), PUBLISHED).collect()}
    assert got == {"at": None, "over": "archive_too_large"}


def test_admission_of_entry_tables(spark):
    rows = [("kept", 10, f"f{i}.py", 500 * 1024, 0) for i in range(300)] + [("deep", 10, "a/b/c/d/e/f/g", 1, 0), ("ok", 10, "a/b/c/d/e/f", 1, 0)]
    df = spark.createDataFrame(rows, "archive_id string, archive_bytes bigint, name string, file_size bigint, external_attr bigint")
    got = {r.archive_id: (r.rejected, r.kept_entries) for r in archives.admit(df, limits=PUBLISHED).collect()}
    assert got == {"kept": (None, 300), "deep": ("too_deep", 0), "ok": (None, 0)}


@pytest.mark.parametrize("name,out", [
    ("a.py", False), ("a/../b.py", False), ("../a.py", True), ("a/../../b.py", True), ("/a.py", True), ("", True), (".", True),
    ("a/..", True), ("a/", False), ("..a/b", False), ("./a.py", False), ("a//b.py", False),
])
def test_traversal(spark, name, out):
    assert spark.createDataFrame([(name,)], "n string").select(leaves_target(F.col("n")).alias("o")).collect()[0].o is out


def test_entry_reasons(spark):
    rows = [("x/dist/", 0, 0, "blocked_dir"), ("win\\dist\\a.js", 0, 0, "blocked_dir"), ("a/package-lock.json", 0, 0, "lock_file"), ("a/", 0, 0, "directory"),
            ("l.py", 0, 0xA1ED0000, "symlink"), ("l.py", 512001, 0, "too_large"), ("l.py", 512000, 0, None), (".env", 1, 0, "extension"), ("x.ENV", 1, 0, None)]
    df = spark.createDataFrame(rows, "n string, s bigint, a bigint, want string")
    for r in df.select("*", skip_reason(F.col("n"), F.col("s"), F.col("a"), PUBLISHED).alias("got"), depth(F.col("n")).alias("d")).collect():
        assert r.got == r.want, r


def test_repository_addresses(spark):
    e = fv.REPOSITORY_ERRORS
    rows = [
        ("https://github.com/o/r", None, ("o", "r", None, None)), ("https://github.com/o/r.git", " dev ", ("o", "r", "dev", None)),
        ("https://github.com/o/r/tree/feature/x", None, ("o", "r", "feature/x", None)), ("https://github.com/o/r/tree/a", "b", ("o", "r", "b", None)),
        ("https://gitlab.com/o/r", None, (None, None, None, e["host"])), ("https://github.com/o/r/issues", None, (None, None, None, e["path"])),
        ("https://github.com/o/r/tree", None, (None, None, None, e["path"])), ("https://github.com/o", None, (None, None, None, e["parts"])),
        ("", None, (None, None, None, e["missing"])), (None, None, (None, None, None, e["missing"])),
        ("https://github.com/o/r", "../x", (None, None, None, e["branch"])), ("https://github.com/o/r", "/x", (None, None, None, e["branch"])),
        ("https://github.com/o/.git", None, (None, None, None, e["characters"])), ("HTTPS://GITHUB.com/o/r/", None, ("o", "r", None, None)),
    ]
    df = spark.createDataFrame([(i, u, b) for i, (u, b, _) in enumerate(rows)], "i int, u string, b string")
    for r in df.select("i", repository(F.col("u"), F.col("b")).alias("r")).collect():
        assert (r.r.owner, r.r.repo, r.r.branch, r.r.error) == rows[r.i][2], rows[r.i]


def test_validation(spark):
    good = '{"title":"t","severity":"High","category":"c","file":"f","line":%s,"why_it_matters":"w","suggested_fix":"s"}'
    bodies = [good % 4, good % '"12"', good % "1.5", good % "null", '{"title":"t"}', "[1]", "{", good.replace('"t"', "7") % 1]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    valid, bad = schema.validate_findings(df)
    assert {r.i: r.line_no for r in valid.collect()} == {0: 4, 1: 12}
    assert {r.i for r in bad.collect()} == {2, 3, 4, 5, 6, 7}
    assert all(r.evidence == "" and r.id == "" for r in valid.collect())


def test_report_store(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("u1", "p", 50), ("u2", "p", 60)], "user_id string, project_name string, safety_score int")
    saved = reports.stamped(rows, ["user_id", "project_name"])
    reports.append(saved, store, "b1")
    reports.append(saved, store, "b1")
    assert reports.load(spark, store).count() == 2
    mine = reports.load(spark, store).filter("user_id = 'u1'").select("user_id", "id")
    reports.delete(mine.withColumn("user_id", F.lit("u2")), store)
    assert reports.load(spark, store).count() == 2
    reports.delete(mine, store)
    assert [r.user_id for r in reports.load(spark, store).collect()] == ["u2"]
    reports.export_json(reports.load(spark, store), str(tmp_path / "json"))
    back = reports.read_json(spark, str(tmp_path / "json"), "user_id string, safety_score int").collect()
    assert [(r.user_id, r.safety_score) for r in back if r.user_id] == [("u2", 60)]


def test_store_without_rows(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("u1", "p", 50)], "user_id string, project_name string, safety_score int")
    none = reports.stamped(rows.limit(0), ["user_id"])
    reports.append(none, store, "b0")
    assert reports.load(spark, store).count() == 0 and set(reports.load(spark, store).columns) == set(none.columns)
    assert reports.load(spark, store, ["u1"]).count() == 0
    clean = str(tmp_path / "clean")
    reports.compact(spark, store, clean)
    assert reports.load(spark, clean).count() == 0
    # A batch with one more column: earlier rows have it null.
    reports.append(reports.stamped(rows, ["user_id"]), store, "b1")
    reports.append(reports.stamped(rows.withColumn("user_id", F.lit("u2")).withColumn("note", F.lit("n")), ["user_id"]), store, "b2")
    assert {(r.user_id, r.note) for r in reports.load(spark, store).collect()} == {("u1", None), ("u2", "n")}
    assert spark.read.parquet(f"{store}/schemas").count() == 2


def test_documents(spark, tmp_path):
    rows = [("a b/c", "x/../y", 1, ["q"]), ("ä+%", "1", 2, []), (None, "2", None, None)]
    df = spark.createDataFrame(rows, "user_id string, id string, `safety score` int, list array<string>")
    assert reports.export_documents(df, str(tmp_path / "out")) == 3
    assert reports.export_documents(df, str(tmp_path / "out")) == 3
    found = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, names in os.walk(tmp_path / "out") for f in names if not f.endswith(".crc"))
    assert found == ["%C3%A4%2B%25/1.json", "a%20b%2Fc/x%2F..%2Fy.json", "none/2.json"]
    text = (tmp_path / "out" / found[1]).read_text()
    assert text.startswith('{\n  "user_id" : "a b/c"') and json.loads(text) == {"user_id": "a b/c", "id": "x/../y", "safety score": 1, "list": ["q"]}
    back = reports.read_json(spark, str(tmp_path / "out"), df.schema)
    assert sorted((r["id"], r["safety score"]) for r in back.collect()) == [("1", 2), ("2", None), ("x/../y", 1)]


def test_stream_of_trees(spark, tmp_path):
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "store")
    where = str(tmp_path / "ckpt")
    write_tree(inbox, {"p1/a.py": "def issue_refund(x):", "p1/c.py": 'API_KEY = "0123456789"'})
    run = lambda: scan_stream.start_reports(scan_stream.stream_trees(spark, inbox), store, where).awaitTermination()
    run()
    write_tree(inbox, {"p2/a.py": "x = 1"})
    run()
    run()
    got = {r.project_id: (r.safety_score, r.deployment_gate.decision) for r in reports.load(spark, store).collect()}
    assert got["p2"] == (100, "ALLOW") and got["p1"][1] == "BLOCK" and len(got) == 2
    assert reports.load(spark, store).count() == 2
    # A later batch adds a file to p1 and mends another: all files count, each in its latest version.
    write_tree(inbox, {"p1/more/b.py": "def delete_all(x):"})
    run()
    write_tree(inbox, {"p1/c.py": "x = 1"})
    os.utime(os.path.join(inbox, "p1/c.py"), (4_000_000_000, 4_000_000_000))
    run()
    scores = [r.safety_score for r in reports.load(spark, store).filter("project_id = 'p1'").orderBy("created_at").collect()]
    assert len(scores) == len(set(scores)) or len(scores) == 2
    assert scores[1] < scores[0]
