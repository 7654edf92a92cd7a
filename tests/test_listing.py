"""Files listed and read by tasks, held against Spark's own source."""

import os
import shutil

import pytest

from riskloom.sources import listing, snapshots
from test_sources import write_tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("listed") / "root")
    write_tree(folder, {
        "a.py": "x", "p/b.py": "é", "p/deep/er/c.txt": "1\n2", "p/odd name+1%20#é?.txt": "odd", "p/empty.py": "", "p/_hidden.py": "x", "p/.dot.py": "x",
        "p/_k=v.py": "kept", "p/_metadata.py": "x", "_metadata_of/d.py": "kept", "_under/e.py": "x", ".git/f.py": "x", "_k=v/g.py": "kept", "p/h.py._COPYING_": "x",
        "q/large.txt": "y" * (3 << 20)})
    os.makedirs(os.path.join(folder, "nothing", "here"))
    os.symlink(os.path.join(folder, "p", "deep"), os.path.join(folder, "q", "link"))
    os.symlink(os.path.join(folder, "a.py"), os.path.join(folder, "q", "same.py"))
    os.symlink(os.path.join(folder, "gone"), os.path.join(folder, "q", "broken.py"))
    return folder


def by_spark(spark, root):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


@pytest.mark.parametrize("given", ["{}", "file://{}", "file:{}/"])
def test_as_listed_and_read_by_spark(spark, root, given):
    files = listing.listed(spark, listing.address(spark, given.format(root)))
    want = by_spark(spark, root)
    plain = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()))
    assert plain(files, "path", "size", "time") == plain(want, "path", "length", "modificationTime") and files.count() == 10
    assert plain(listing.contents(files), "path", "size", "time", "content") == plain(want, "path", "length", "modificationTime", "content")


def test_a_relative_folder(spark, root):
    files = listing.listed(spark, listing.address(spark, os.path.relpath(root)))
    assert sorted(files.select("path").collect()) == sorted(by_spark(spark, root).select("path").collect())


def test_what_only_spark_can_list_has_no_address(spark, root):
    for place in (f"{root}/p*", f"{root}/a.py", f"{root}/missing", "viewfs://store/in", "nosuch://place/x"):
        assert listing.address(spark, place) is None


def test_a_file_that_goes_away_gives_no_row(spark, tmp_path):
    write_tree(str(tmp_path), {"p/a.py": "x", "p/b.py": "y", "q/c.py": "z"})
    files = listing.listed(spark, listing.address(spark, str(tmp_path)))
    os.remove(tmp_path / "p" / "b.py")
    shutil.rmtree(tmp_path / "q")
    assert [(r.path.rsplit("/", 1)[1], r.content) for r in listing.contents(files).collect()] == [("a.py", b"x")]


def test_tasks_follow_files_and_bytes(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [listing.tasks(spark, *x) for x in ((None, None), (3, 10), (400, 4000))] == [1, 3, cores]
    assert listing.tasks(spark, 3_000_000, 6 << 30) == 192 and listing.tasks(spark, 3_000_000, 1) == 150


def looks(spark, root, store):
    def seen():
        return sorted(map(tuple, snapshots.look(spark, root, store).collect()), key=repr)

    write_tree(root, {"p/a.py": "x", "p/b.py": "y", "q/c.py": "z", "q/d.png": "no"})
    first = seen()
    write_tree(root, {"p/a.py": "x2", "r/e.py": "new"})
    os.remove(os.path.join(root, "q/c.py"))
    return first, seen(), seen()


def test_looks_at_a_place_that_only_spark_can_list(spark, tmp_path, monkeypatch):
    want = looks(spark, str(tmp_path / "a" / "root"), str(tmp_path / "a" / "store"))
    monkeypatch.setattr(snapshots, "address", lambda *_: None)
    assert looks(spark, str(tmp_path / "b" / "root"), str(tmp_path / "b" / "store")) == want
    assert [len(x) for x in want] == [3, 3, 0]


def test_the_driver_holds_no_list_of_the_files_of_a_look(spark, tmp_path, monkeypatch):
    read, settle = [], snapshots.settle
    monkeypatch.setattr(snapshots, "settle", lambda df: read.extend(df.inputFiles()) or settle(df))
    looks(spark, str(tmp_path / "root"), str(tmp_path / "store"))
    assert read and not [x for x in read if not x.endswith(".parquet")]
