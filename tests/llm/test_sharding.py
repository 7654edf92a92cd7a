import collections
import zlib

import numpy as np
import pytest

from riskloom.llm import external_shuffle as X, queries


def test_fisher_yates_draws_every_order():
    seen = collections.Counter(tuple(X.fisher_yates(4, 1, b).tolist()) for b in range(4800))
    assert len(seen) == 24 and min(seen.values()) > 130 and max(seen.values()) < 280
    assert X.fisher_yates(50, 3, 7).tolist() == X.fisher_yates(50, 3, 7).tolist() != X.fisher_yates(50, 4, 7).tolist()
    assert X.fisher_yates(0, 1, 1).tolist() == [] and X.fisher_yates(1, 1, 1).tolist() == [0]


@pytest.mark.parametrize("rows,shards,bucket", [(1000, 8, 64), (1000, 3, 100_000), (5, 8, 2), (17, 1, 4)])
def test_shards(spark, rows, shards, bucket):
    docs = spark.range(rows).selectExpr("id as doc_id", "concat('text ', id % 7) as text")
    got = X.shuffled(docs, shards, seed=5, bucket_rows=bucket).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(rows))
    assert all(r["text"] == f"text {r['doc_id'] % 7}" for r in got)
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1 and set(sizes) <= set(range(shards))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))


def test_order_is_random_and_repeats_with_the_seed(spark):
    docs = spark.range(0, 4000, 1, 4).selectExpr("id as doc_id")
    order = lambda seed: [r["doc_id"] for r in X.shuffled(docs, 4, seed, bucket_rows=300).orderBy("shard", "slot").collect()]
    one, same, other = order(1), order(1), order(2)
    assert one == same != other
    assert abs(np.corrcoef(one, range(4000))[0, 1]) < 0.06 and abs(np.corrcoef(one, other)[0, 1]) < 0.06
    assert sum(abs(a - b) == 1 for a, b in zip(one, one[1:])) < 12
    # Places of the first thousand rows are spread over all shards.
    assert all(200 < sum(x < 1000 for x in one[k : k + 1000]) < 300 for k in range(0, 4000, 1000))


def test_copies_spread_over_buckets(spark):
    docs = spark.range(0, 6000, 1, 4).selectExpr("if(id < 4000, 0, id) as doc_id", "if(id < 4000, 'same', string(id)) as text")
    got = X.shuffled(docs, 6, bucket_rows=500)
    copies = [r["n"] for r in got.filter("text = 'same'").groupBy("shard").agg({"*": "count"}).toDF("shard", "n").collect()]
    assert len(copies) == 6 and min(copies) > 580 and max(copies) < 750


def test_awkward_rows(awkward, nothing):
    got = X.shuffled(awkward, 3)
    assert got.columns == [*("_shard" if c == "shard" else c for c in awkward.columns), "slot", "shard"]
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert plain(got.drop("slot", "shard").collect()) == plain(awkward.collect())
    assert X.shuffled(nothing).count() == 0 and X.shuffled(nothing).columns[-1] == "shard"


def test_query(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else "é" * (i % 13)) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_sharding(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text in rows:
        data = (text or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert sorted(collections.Counter(r["shard"] for r in got.values()).values()) == [12] * 4 + [13] * 4
