import random

from riskloom.llm import packing as P


def slow_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fit = [(left, i) for i, (left, s, c) in enumerate(bins) if left >= size and source not in s and cluster not in c]
        if fit:
            i = min(fit)[1]
            bins[i] = (bins[i][0] - size, bins[i][1] | {source}, bins[i][2] | {cluster})
        else:
            i = len(bins)
            bins.append((capacity - size, {source}, {cluster}))
        out.append(i)
    return out


def test_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 60)
        sizes = [rng.randint(1, 30) for _ in range(n)]
        sources, clusters = [rng.randint(0, 5) for _ in range(n)], [rng.randint(0, 20) for _ in range(n)]
        assert P.best_fit(sizes, sources, clusters, 30) == slow_best_fit(sizes, sources, clusters, 30)


def check(rows, capacity):
    bins = {}
    for r in rows:
        if r["bin"] is not None:
            bins.setdefault(r["bin"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_start"])
        assert sum(r["n_words"] for r in own) <= capacity
        assert [r["bin_start"] for r in own] == [sum(r["n_words"] for r in own[:i]) for i in range(len(own))]
        assert len({r["source"] for r in own}) == len(own) == len({r["cluster"] for r in own})
    return bins


def test_every_word_has_one_place(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["w%d" % rng.randint(0, 9)] * rng.choice([0, 1, 5, 17, 40, 90])), "s%d" % rng.choice([0, 0, 1, 2, 3])) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for shard_rows in (40, 2000):
        rows = P.packed(P.items(table), 40, shard_rows).collect()
        assert len(check(rows, 40)) > 1
        for i, text, _ in docs:
            own = sorted((r["word_start"], r["n_words"]) for r in rows if r["doc_id"] == i)
            assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
            assert sum(n for _, n in own) == len(text.split())


def test_awkward_rows(awkward, nothing):
    rows = P.packed(P.items(awkward)).collect()
    check(rows, P.CAPACITY)
    assert sum(r["n_words"] for r in rows) == sum(len((r["text"] or "").split()) for r in awkward.collect())
    assert sum(r["bin"] is None for r in rows) == 3
    assert len({r["bin"] for r in rows if r["doc_id"] == 1 and r["source"] == "s0"}) == 2
    assert P.packed(P.items(nothing)).count() == 0
