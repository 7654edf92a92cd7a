"""The window, band-join and numbering forms against brute force, with one group far larger than the rest."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.operators import findings as found, lines as L, numbering


@pytest.fixture(scope="module")
def marks(spark):
    rnd = random.Random(7)
    rows = []
    for path, n in (("hot.py", 3000), ("b.py", 40), ("c.py", 1)):
        for i in range(1, n + 1):
            rows.append(("p", path, i, rnd.choice(["hit", "other"] + ["x"] * 40)))
    return rows


def brute(rows, word, k):
    at = {}
    for _, path, n, line in rows:
        if line == word:
            at.setdefault(path, []).append(n)
    return {(path, n) for _, path, n, _ in rows if any(abs(n - h) <= k for h in at.get(path, []))}


@pytest.mark.parametrize("block", [32, 256, 4096])
def test_window_form(spark, marks, block):
    df = spark.createDataFrame(marks, "project_id string, path string, line_no int, line string")
    flags = {"hit": (F.col("line") == "hit", 15), "other": (F.col("line") == "other", 10)}
    got = L.near_by_window(df, ["project_id"], flags, block=block).collect()
    assert len(got) == len(marks)
    assert {(r.path, r.line_no) for r in got if r.near_hit} == brute(marks, "hit", 15)
    assert {(r.path, r.line_no) for r in got if r.near_other} == brute(marks, "other", 10)
    kept = L.near_by_window(df, ["project_id"], flags, keep=F.col("line_no") % 3 == 0, block=block).collect()
    assert {(r.path, r.line_no) for r in kept} == {(p, n) for _, p, n, _ in marks if n % 3 == 0}
    assert {(r.path, r.line_no) for r in kept if r.near_hit} == {x for x in brute(marks, "hit", 15) if x[1] % 3 == 0}


@pytest.mark.parametrize("block", [16, 256])
def test_band_anti_join(spark, marks, block):
    df = spark.createDataFrame(marks, "project_id string, path string, line_no int, line string")
    got = L.far_from(df, df.filter("line = 'hit'"), ["project_id"], 10, block=block).collect()
    assert {(r.path, r.line_no) for r in got} == {(p, n) for _, p, n, _ in marks} - brute(marks, "hit", 10)
    assert len(got) == len({(r.path, r.line_no) for r in got})


def test_numbering_of_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 50}", rnd.random(), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {(r.g, r.i): r.n for r in numbering.number_rows(df, ["g"], ["v", "i"], "n").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1:]), 1):
            want[(g, r[2])] = n
    assert got == want


def test_hot_group_is_spread(spark):
    """The range partitions split a single group."""
    df = spark.range(20000).select(F.lit("one").alias("g"), "id")
    parts = df.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id()).count().count()
    assert parts == 8


def test_previous_value_across_buckets(spark):
    rnd = random.Random(5)
    rows = [(f"p{rnd.randint(0, 3)}", rnd.randint(0, 400_000), i, rnd.randint(0, 100)) for i in range(600)]
    df = spark.createDataFrame(rows, "p string, s int, id int, v int").withColumn("t", F.timestamp_seconds("s"))
    got = {r.id: r.before for r in numbering.with_previous(df, ["p"], "t", "id", "v", "before").collect()}
    for p in {r[0] for r in rows}:
        before = None
        for r in sorted((x for x in rows if x[0] == p), key=lambda x: (x[1], x[2])):
            assert got[r[2]] == before
            before = r[3]


def test_first_wins(spark):
    rows = [("p", "Tool Permission Risk", "a.py", 1, "t", 2, 0, "High"), ("p", "Tool Permission Risk", "a.py", 1, "t", 1, 0, "Low")]
    df = spark.createDataFrame(rows, "project_id string, category string, path string, line_no int, title string, stage int, sub_ord int, severity string")
    assert [r.severity for r in found.first_wins(df).collect()] == ["Low"]


def test_ids_grow_past_three_digits(spark):
    df = spark.range(1005).select(
        F.lit("p").alias("project_id"), F.lit(0).alias("stage"), F.lit("a").alias("path"), F.col("id").cast("int").alias("line_no"),
        F.lit(0).alias("sub_ord"), F.lit("t").alias("title"), F.lit("Secret Exposure Risk").alias("category"))
    ids = [r.id for r in found.with_ids(df).orderBy("line_no").collect()]
    assert ids[0] == "secret_exposure_001" and ids[-1] == "secret_exposure_1005" and len(set(ids)) == 1005


def test_roots_cover_their_lists():
    words = (fv.MITIGATION_APPROVAL_WORDS + fv.MITIGATION_AUDIT_WORDS + fv.MITIGATION_WRAPPER_WORDS + fv.MASKING_WORDS
             + fv.FRAMEWORK_APPROVAL_WORDS + fv.APPROVAL_WORDS + fv.AUDIT_WORDS)
    assert [w for w in words if not any(r in w for r in fv.CONTROL_ROOTS)] == []
    parts = [p.replace("\\s*", "").replace("\\", "").lower() for _, p in fv.FRAMEWORK_PATTERNS for p in p.split("|")]
    assert [p for p in parts if not any(r in p for r in fv.CANDIDATE_ROOTS)] == []
