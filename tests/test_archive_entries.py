"""Archive entries read one by one, held against archives unpacked whole."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from riskloom.functions.entries import NONE, PUBLISHED, Limits
from riskloom.sources import archive_entries as A, archives
from test_sources import ARCHIVES, make_zip, write_tree


def packed(entries, method):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return buffer.getvalue()


def damaged():
    data = bytearray(packed([("a.py", "x = 1 " * 50), ("b.py", "y = 2 " * 50)], zipfile.ZIP_STORED))
    data[60] ^= 0xFF
    return bytes(data)


def bomb(stated):
    """An entry of 40 MB of which the directory says that it has `stated` bytes."""
    data = bytearray(packed([("ok.py", "x"), ("bomb.py", b"0" * 40_000_000)], zipfile.ZIP_DEFLATED))
    at = data.rindex(b"PK\x01\x02")
    data[at + 24 : at + 28] = stated.to_bytes(4, "little")
    return bytes(data)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("zips")), random.Random(3)
    many = [(f"d{i % 5}/f{i}{rng.choice(['.py', '.txt', '.png'])}", rng.choice(["", "é", "x" * i])) for i in range(400)]
    more = {
        "stored": packed(many, zipfile.ZIP_STORED), "bzip": packed(many[:20], zipfile.ZIP_BZIP2), "lzma": packed(many[:20], zipfile.ZIP_LZMA),
        "twice": packed([("a.py", "one"), ("a.py", "two")], zipfile.ZIP_DEFLATED), "damaged": damaged(), "front": b"some bytes" + make_zip([("a.py", "x")]),
        "skipped damage": damaged().replace(b"a.py", b"a.go"), "latin+1%": make_zip([("a.py", "caf\xe9".encode("latin-1"))]),
    }
    write_tree(folder, {f"in/{k}.zip": v for k, v in (ARCHIVES | more).items()} | {"in/note.txt": "no archive"})
    return folder


def whole(spark, root, limits):
    judged = archives.judged(archives.expand(archives.read_archives(spark, root, limits), limits), limits)
    return archives.files_of(judged, limits), archives.left_out(judged, limits)


@pytest.mark.parametrize("limits", [NONE, PUBLISHED, Limits(archive_bytes=2000), Limits(entries=3)])
def test_as_archives_unpacked_whole(spark, root, limits, monkeypatch):
    monkeypatch.setattr(A, "TASK_BYTES", 50_000)
    plain = lambda df, *columns: sorted(map(repr, df.select(*columns).collect()))
    (files, left), (want_files, want_left) = A.read(spark, root, limits), whole(spark, root, limits)
    for got, want, columns in ((files, want_files, ("project_id", "path", "text")), (left, want_left, ("archive_id", "name", "reason"))):
        assert plain(got, *columns) == plain(want, *columns) and got.count() > 0


def test_unpacking_stops_at_the_stated_size(spark, tmp_path):
    write_tree(str(tmp_path), {"lies.zip": bomb(1000), "true.zip": bomb(40_000_000)})
    files, left = A.read(spark, str(tmp_path), Limits(file_bytes=1_000_000))
    assert {(r.project_id, r.path) for r in files.collect()} == {("true.zip", "ok.py")}
    assert {(r.archive_id, r.name, r.reason) for r in left.collect()} == {("lies.zip", None, "not_a_zip"), ("true.zip", "bomb.py", "too_large")}


def test_an_entry_larger_than_a_row_is_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "ROW_BYTES", 1000)
    write_tree(str(tmp_path), {"a.zip": make_zip([("a.py", "x" * 1000), ("b.py", "x" * 1001)])})
    files, left = A.read(spark, str(tmp_path))
    assert [r.path for r in files.collect()] == ["a.py"] and [(r.name, r.reason) for r in left.collect()] == [("b.py", "too_large")]


def test_a_large_archive_is_read_by_several_tasks(spark, root, monkeypatch):
    monkeypatch.setattr(A, "TASK_BYTES", 2_000)
    seen = []
    real = A.settle
    monkeypatch.setattr(A, "settle", lambda df: seen.append(real(df)) or seen[-1])
    A.read(spark, root)
    files = seen[-1].filter(F.col("archive_id") == "in/stored.zip").select(F.input_file_name()).distinct().count()
    assert files > 5


def test_no_archives(spark, tmp_path):
    write_tree(str(tmp_path), {"note.txt": "x"})
    files, left = A.read(spark, str(tmp_path))
    assert files.count() == 0 and left.count() == 0


def test_small_entries_leave_together(spark, tmp_path):
    """300 small entries are few batches, and a large one does not wait for others."""
    import zipfile

    import pyarrow as pa

    from riskloom.sources import archive_entries as A

    texts = [f"x = {i}" if i != 280 else "y" * (2 << 20) for i in range(300)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i, text in enumerate(texts):
            z.writestr(f"f{i}.py", text)
    rows = A.manifest(A.list_archives(spark, str(tmp_path))).orderBy("ord").toArrow().to_batches()
    out = list(A._unpack(rows))
    assert [b.num_rows for b in out] == [256, 25, 19]
    assert [c.decode() for c in pa.Table.from_batches(out).column("content").to_pylist()] == texts


def test_archives_are_expanded_from_arrow(spark, tmp_path, capsys):
    """A batch of archives is not turned into Python objects as a whole."""
    from riskloom.sources import archives

    archives.expand(spark.createDataFrame([("a", 1, bytearray(b"x"))], "archive_id string, archive_bytes long, content binary")).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_the_driver_holds_no_list_of_the_archives(spark, root):
    listed = A.list_archives(spark, root)
    assert listed.inputFiles() and not [x for x in listed.inputFiles() if not x.endswith(".parquet")]


def test_archives_of_a_place_that_only_spark_can_list(spark, root, monkeypatch):
    want = sorted(A.list_archives(spark, root).collect())
    monkeypatch.setattr(A, "address", lambda *_: None)
    assert sorted(A.list_archives(spark, root).collect()) == want and len(want) > 8


def test_reports_of_archives_in_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """archive_reports: no archive is in a plan of the driver, and archives of equal names keep apart."""
    from riskloom.plans import catalog

    docs = [(i, f"text {i}. API_KEY = 'sk-0123456789abcdefgh{i}'") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    read, settle = [], A.settle
    monkeypatch.setattr(A, "settle", lambda df: read.extend(df.inputFiles()) or settle(df))
    rows = catalog.archive_reports(spark, str(tmp_path)).collect()
    kept = [i for i in range(40) if i % 13 and i % 7]
    assert sorted((r.user_id, r.project_id) for r in rows) == sorted((h := "odd" if i % 2 else "even", f"{h}/a{i // 2}.zip") for i in kept)
    assert read and not [x for x in read if not x.endswith(".parquet")]
