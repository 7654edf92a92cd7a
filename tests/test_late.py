"""Late reports: parted from the others batch by batch, none lost, repeated batches counted once."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException

from riskloom.streaming import late

SCHEMA = "id long, created_at timestamp"
DAY = timedelta(days=1)


def at(day, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour)


BATCHES = [
    [(0, at(0, 5)), (1, at(3, 23)), (2, None)],
    [],
    # The greatest time so far is day 3, 23:00; with two days' allowance day 0 is closed, day 1 is not.
    [(3, at(0, 23)), (3, at(0, 23)), (4, at(1)), (5, at(9)), (6, None)],
    # Day 9, 00:00 less two days: day 6 has ended just then, day 7 has not.
    [(7, at(6, 23)), (8, at(7)), (9, at(2))],
]


def brute(batches, allowance):
    mark, out = None, {True: [], False: []}
    for number, rows in enumerate(batches):
        for ident, when in rows:
            end = when and datetime(when.year, when.month, when.day) + DAY
            out[bool(mark and end and end <= mark - allowance)].append((ident, number))
        mark = max([t for _, t in rows if t] + ([mark] if mark else []), default=mark)
    return {k: sorted(v) for k, v in out.items()}


def test_parted_like_brute_force(spark, tmp_path):
    store, allowance = str(tmp_path), timedelta(days=2)
    step = late.parted(store, allowance)
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in BATCHES]
    for number, rows in enumerate(frames):
        step(rows, number)
    step(frames[3], 3)  # repeated after a failure
    want = brute(BATCHES, allowance)
    for flag in (True, False):
        got = late.arrived(spark, store, frames[0].schema, flag)
        assert got.columns == ["id", "created_at", "batch"]
        assert sorted((r.id, r.batch) for r in got.collect()) == want[flag]
    assert want[True] == [(3, 2), (3, 2), (7, 3), (9, 3)]


def test_refused(spark, tmp_path):
    step = late.parted(str(tmp_path), DAY)
    with pytest.raises(ValueError):
        step(spark.createDataFrame([], SCHEMA + ", Late int"), 0)
    with pytest.raises(AnalysisException):  # the store of another checkpoint
        step(spark.createDataFrame([], SCHEMA), 7)
