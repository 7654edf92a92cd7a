import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import bytewise as B, substring_dedup as D


def removed(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_against_all_windows(spark, window):
    rng = random.Random(window)
    phrase = [rng.choice("abcdefgh") * 2 for _ in range(12)]
    texts = [None, "", " \n"]
    for _ in range(60):
        words = [rng.choice(["é", "b", "cc", "dé", "x,"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            words[len(words) // 2 : len(words) // 2] = phrase[rng.randint(0, 5) :]
        texts.append(rng.choice([" ", "\t", "  \r\n"]).join(words))
    texts += texts[5:12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in D.without_repeats(docs, window).collect()}
    for i, (n, gone, kept) in enumerate(removed(texts, window)):
        row = got[i]
        assert (row["n_words"], row["n_removed"], row["kept"]) == (n, gone, kept)
        assert sum(s["end"] - s["start"] for s in row["removed"]) == gone
        assert all(a["end"] < b["start"] for a, b in zip(row["removed"], row["removed"][1:]))


def test_awkward_rows(awkward, nothing):
    rows = awkward.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), *w) for r, w in zip(rows, removed([r["text"] for r in rows], 13)))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in D.without_repeats(awkward, 13).collect())
    assert [hashlib.sha256(repr(x).encode()).hexdigest() for x in got] == [hashlib.sha256(repr(x).encode()).hexdigest() for x in want]
    assert D.without_repeats(nothing).count() == 0


def test_small_buckets_and_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 200)
    monkeypatch.setattr(D, "BUCKET_WINDOWS", 20)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in D.without_repeats(docs, 6).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 6)


def test_packing_numbers():
    rng = np.random.default_rng(1)
    first = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    second, mark = rng.integers(0, 1 << 16, 500).astype(np.uint16), rng.integers(0, 1 << 32, 500, dtype=np.uint32)
    for got, want in zip(D.unpacked(D.packed(first, second, mark), True), (first, second, mark)):
        assert (got == want).all()
    for got, want in zip(D.unpacked(D.packed(first, second)), (first, second)):
        assert (got == want).all()
    assert [len(x) for x in D.unpacked(D.packed(first[:0], second[:0]))] == [0, 0]


def test_windows_that_agree_in_the_first_number_only():
    first = np.array([5, 5, 5, 7, 9, 9, 9], np.uint64)
    second = np.array([2, 1, 2, 1, 3, 3, 4], np.uint16)
    table = np.array([5, 9, 9, 12], np.uint64), np.array([1, 4, 5, 1], np.uint16)
    assert D.found_in(first, second, table).tolist() == [False, True, False, False, False, False, True]
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    assert not D.found_in(first, second, none).any()
    shards = np.array([4, 4, 3, 0, 8, 8, 8], np.uint32)
    rows = D.packs_of(first, second, shards, 1, none)
    assert [b for b, _ in rows] == [0]
    got = list(zip(*(x.tolist() for x in D.unpacked(rows[0][1], True))))
    assert got == [(5, 1, 8), (5, 2, 6), (5, 2, 8), (7, 1, 0), (9, 3, 17), (9, 4, 16)]
    found = D._repeated(pa.table({"bucket": [0], "windows": pa.array([rows[0][1]], pa.binary())})).to_pylist()
    assert [(r["shard"], [x.tolist() for x in D.unpacked(r["windows"])]) for r in found] == [
        (3, [[5], [2]]), (4, [[5], [2]]), (8, [[9], [3]])]


@pytest.mark.parametrize("gigabytes,most", [(0.5, 0.001), (30, 0.005), (1000, 0.05)])
def test_packs_stay_long_as_the_table_grows(gigabytes, most):
    """Rows and bytes for a window at the settings of larger tables."""
    size = int(gigabytes * 1.6e9)
    shards, buckets = -(-size // D.SHARD_BYTES), D.buckets_of(size // 6)
    rng = np.random.default_rng(2)
    n = 1 << 20
    first, second = rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 16, n).astype(np.uint16)
    rows = D.packs_of(first, second, rng.integers(0, shards, n).astype(np.uint32), buckets, (first[:0], second[:0]))
    # An emission is four times as large.
    assert len(rows) / (n * (D.EMIT_WINDOWS / n)) < most
    assert sum(len(x) for _, x in rows) == 14 * n
    assert size / 6 / buckets <= D.BUCKET_MOST


def test_rows_that_are_there_many_times(spark, monkeypatch):
    rows = [(None, "a b c d e f")] * 3000 + [(1, "a b c d e f")] + [(7, None)] * 50 + [(2, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = D.without_repeats(docs, 4).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, 6, 6, 3000), (1, 6, 6, 1), (7, 0, 0, 50), (2, 3, 0, 1)]))
    folded = docs.selectExpr("doc_id as _0", "xxhash64(doc_id, text) as key", "coalesce(text, '') as text")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*folded.schema, StructField("_n", LongType())])
    assert folded.mapInArrow(D._folded(["_0"], to_arrow_schema(schema)), schema).count() < 20


def test_rolling_hash_is_the_polynomial():
    words, base = B.stream(90, 3), 0x9E3779B97F4A7C15
    for k in (1, 2, 3, 13, 35, 64, 90, 91):
        got = B.rolled(words, k).tolist()
        want = [sum(int(words[i + j]) * pow(base, k - 1 - j, 1 << 64) for j in range(k)) % (1 << 64) for i in range(90 - k + 1)]
        assert got == want
