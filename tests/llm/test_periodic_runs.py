import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from riskloom.llm import periodic_runs as P, queries


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_definition(words, least=24, times=3):
    """Every stretch, looked at by its period."""
    out, n = [], len(words)
    for p in range(1, n // times + 1):
        at = 0
        while at + p < n:
            if words[at] != words[at + p]:
                at += 1
                continue
            end = at + p
            while end < n and words[end] == words[end - p]:
                end += 1
            whole = words[at:end]
            smaller = any(all(whole[k] == whole[k + q] for k in range(len(whole) - q)) for q in range(1, p))
            if end - at >= max(least, times * p) and not smaller:
                out.append((at, end - at, p))
            at = end - p
            at += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    out = []
    for _ in range(rng.randint(0, 4)):
        block = [rng.choice("abc") for _ in range(rng.randint(1, rng.choice([2, 3, 9])))]
        out += (block * rng.randint(1, 30))[: rng.randint(0, 70)]
        out += [rng.choice("abcd") for _ in range(rng.randint(0, 6))]
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (1, 2), (5, 2), (6, 4)])
def test_against_the_definition(least, times):
    rng = random.Random(least)
    seen = 0
    for _ in range(250):
        words = random_words(rng)
        ids = np.array([ord(w) for w in words], np.int64)
        want = by_definition(words, least, times)
        assert P.runs_of(ids, least, times) == want, words
        seen += len(want)
    assert seen > 50


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(100):
        ids = [rng.randint(0, 2) for _ in range(rng.randint(2, 60))]
        order, shared = P.sorted_suffixes(np.array(ids, np.int64))
        assert order.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:])
        for k, (i, j) in enumerate(zip(order, order[1:])):
            t = 0
            while max(i, j) + t < len(ids) and ids[i + t] == ids[j + t]:
                t += 1
            assert shared[k] == t


def test_runs_share_enough_words_to_be_suspected():
    for least in range(1, 40):
        for times in (2, 3, 4):
            assert P._shared(least, times) == min(max(least - p, (times - 1) * p) for p in range(1, 100))


def collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_texts(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "x " * 30, ("é\tü  " * 12).strip(), "a " * 23]
    texts += [rng.choice([" ", "\t", "\r\n "]).join(random_words(rng)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "runs id")
    got = {r["runs id"]: r for r in P.runs(docs, keep=("runs id",)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = words_of(text)
        want = by_definition(words)
        assert [tuple(r) for r in got[i]["runs"]] == want and got[i]["n_words"] == len(words)
        assert got[i]["collapsed"] == collapsed(words, want)


def test_awkward_rows(awkward, nothing):
    got = P.runs(awkward).collect()
    assert len(got) == awkward.count()
    assert P.runs(nothing).count() == 0
    # 60,000 words that go round every 977
    long = next(r for r in got if r["n_words"] == 60_000)
    assert [tuple(r) for r in long["runs"]] == [(0, 60_000, 977)] and len(long["collapsed"].split()) == 977


def expected(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_definition(words)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(collapsed(words, runs)))


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", " ".join(random_words(rng)), " ".join(rng.choice(["ab", "c", "é"]) for _ in range(rng.randint(0, 90)))])) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(expected(i, t) for i, t in rows)
    assert sum(r["n_runs"] for r in out.collect()) > 50
