"""Files read as lines in splits, held against files read whole."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.lines import explode_lines
from riskloom.operators.scan import scan, scan_lines
from riskloom.sources import long_files, trees

BREAKS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "\n\n", "\r\r\n"]
LINES = ["x = 1", "", "def issue_refund(x):", "needs_review = True", "é ü", "audit_log('a')", 'API_KEY = "sk-abcdefghijklmnopqrstuvwx"',
         "tools = [refund_tool, email_tool]", "row = mask_fields(row)", "def get_customer_profile(c):", "х …"]


def texts(rng, breaks):
    body = "".join(rng.choice(LINES) + rng.choice(breaks) for _ in range(rng.randint(0, 60)))
    return body + rng.choice(["", "last line", "\x85", "a\x0b", "b\r", "\n"])


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("long"), random.Random(4)
    for i in range(60):
        text = texts(rng, ["\n"] if i % 3 == 0 else ["\n", "\r\n"] if i % 3 == 1 else BREAKS)
        data = text.encode() if i % 4 else text.encode("latin-1", "replace")
        data = b"\xef\xbb\xbf" + data if i % 5 == 0 else data
        ext = [".py", ".ts", ".txt", ".json", ".md"][i % 5]
        file = folder / f"p{i % 7}" / "odd dir+1%20" / f"prompt {i}{ext}"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    (folder / "p0" / "keys.json").write_text('{"a": 1,\n "password": [\n{"Phone": 2}]}')
    (folder / "p0" / "logo.png").write_bytes(b"x\ny")
    (folder / "p0" / "empty.py").write_bytes(b"")
    return str(folder)


@pytest.mark.parametrize("size", [100, 700, None])
def test_lines_of_splits(spark, root, size):
    whole = explode_lines(trees.read_trees(spark, root))
    split = long_files.read_lines(spark, root, size)
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert split.columns == whole.columns and plain(split) == plain(whole)


def test_a_file_comes_from_several_tasks(spark, root):
    rows = long_files._rows(spark, root, 100)
    assert rows.groupBy("_path").agg(F.count_distinct("_start").alias("n")).agg(F.max("n")).first()[0] > 5
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "100"


@pytest.mark.parametrize("rules", [None, ["secret", "prompt"], ["json"], ["approval"]])
def test_scan_of_lines(spark, root, rules):
    options = {"rules": rules} if rules else {}
    whole = scan(trees.read_trees(spark, root), **options)
    split = scan_lines(long_files.read_lines(spark, root, 200), **options)
    plain = lambda df: sorted(map(repr, df.select(*whole.columns).collect()))
    assert plain(split) == plain(whole) and whole.count() > 0


def test_controls_reach_across_blocks_of_lines(spark):
    rows = [("p", "a.py", i, "x = 1") for i in range(1, 9000)]
    for at in (4090, 4100, 8190):
        rows[at - 1] = ("p", "a.py", at, "def issue_refund(x):")
    rows[4103 - 1], rows[8200 - 1] = ("p", "a.py", 4103, "needs_review = requires_approval(x)"), ("p", "a.py", 8200, "audit_log('x')")
    lines = spark.createDataFrame(rows, "project_id string, path string, line_no int, line string")
    text = "\n".join(r[3] for r in rows)
    whole = scan(spark.createDataFrame([("p", "a.py", text)], "project_id string, path string, text string"))
    plain = lambda df: sorted(map(repr, df.select(*whole.columns).collect()))
    assert plain(scan_lines(lines)) == plain(whole) and whole.count() > 4


def test_small_splits_share_tasks(spark, tmp_path):
    """Tasks follow from cores, however many splits there are."""
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("x = 1\n" * 40_000)
    rows = long_files._rows(spark, str(tmp_path), 64)
    assert rows.select("_start").distinct().count() > 3000
    assert len(rows.inputFiles()) <= 2 * long_files.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None


def test_the_driver_holds_no_list_of_the_files(spark, root, monkeypatch):
    read, settle = [], long_files.settle
    monkeypatch.setattr(long_files, "settle", lambda df: read.extend(df.inputFiles()) or settle(df))
    long_files._rows(spark, root, 100)
    assert read and not [x for x in read if not x.endswith(".parquet")]


def test_lines_of_a_place_that_only_spark_can_read(spark, root, monkeypatch):
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = plain(long_files.read_lines(spark, root, 300))
    monkeypatch.setattr(long_files, "address", lambda *_: None)
    assert plain(long_files.read_lines(spark, root, 300)) == want


@pytest.mark.parametrize("size", [1, 7, 5000, 1 << 30])
def test_each_row_is_read_in_one_split(tmp_path, size):
    import pyarrow as pa

    rows = [b"", b"a", b"b" * 9000, b"", b"", b"c" * 11, b"d" * 4096, b"\r", b"e" * 12_000] * (1 if size < 100 else 150)
    for end in (b"", b"\n"):
        (tmp_path / "a.txt").write_bytes(data := b"\n".join(rows) + end)
        starts = range(0, len(data), size)
        splits = pa.RecordBatch.from_pydict({
            "path": [f"file:{tmp_path}/a.txt"] * len(starts), "size": [len(data)] * len(starts), "start": list(starts), "end": [min(s + size, len(data)) for s in starts]})
        found = pa.Table.from_batches(long_files._split_rows([splits])).to_pylist()
        assert [x["_value"] for x in found] == rows
        assert sorted(found, key=lambda x: (x["_start"], x["_row"])) == found
