import collections
import random
import re
import zlib

import numpy as np
import pytest

from riskloom.llm import queries, spelling_variants as S


def one_edit(u, v):
    """By definition: some single change makes v of u."""
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    short, long = sorted((u, v), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def by_definition(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(row) for w, row in out.items()}


def many_words(seed, n, letters="abé", most=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(5, most))): rng.choice([3, 3, 4, 7, 20, 50, 200]) for _ in range(n)}


@pytest.mark.parametrize("work", [1, 500, S.GROUP_WORK])
def test_against_all_pairs(spark, work):
    counts = many_words(work, 500) | {"a" * 300: 3, "a" * 301: 9, "b" + "a" * 300: 40, "word\U00020000x": 5, "word\U00020001x": 50}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in S.grouped(words, work=work).collect()}
    assert got == by_definition(counts)


def test_tiles_of_any_size(monkeypatch):
    counts = many_words(5, 200, most=6)
    for cells in (1, 50, 1 << 19):
        monkeypatch.setattr(S, "TILE_CELLS", cells)
        for cls in (5, 6):
            words = sorted(w for w in counts if len(w) in (cls, cls + 1))
            longer = np.array([len(w) > cls for w in words])
            n, first = S.near_words(words, longer, cls)
            for i, w in enumerate(words):
                near = [k for k, v in enumerate(words) if one_edit(w, v) and not (longer[i] and longer[k])]
                assert (n[i], first[i]) == (len(near), min(near, default=-1))


def test_no_group_exceeds_its_work(spark):
    """A vocabulary with one common beginning makes more groups, not larger ones."""
    rng = random.Random(1)
    words = {"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)}
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    from pyspark.sql import functions as F

    groups, _ = S._groups(table, 20_000)
    sizes = groups.groupBy("grp").agg(F.sum((~F.col("longer")).cast("long")).alias("base"), F.count("*").alias("n"), F.first("cls").alias("cls"))
    assert sizes.filter("base * n * (cls + 1) > 20000").count() == 0
    assert groups.count() < 40 * len(words)


def test_chains_reach_their_root(spark):
    counts = {"x" * 5 + "".join(chr(97 + i) for i in range(k)): 3 * 2**k for k in range(20)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r["root"] for r in S.grouped(words).collect()} == {max(counts, key=counts.get)}


def expected(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return by_definition({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})


def test_query(spark, tmp_path):
    rng = random.Random(9)
    words = [w for w in many_words(3, 150, "aBÀé", 7)] + ["x1", "Ünder_score", "naïve", "NAÏVE", "it's"]
    rows = [(i, rng.choice([None, "", "-"]) if i % 20 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_spelling_variants(spark, str(tmp_path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out.collect()}
    assert got == expected(rows) and any(r[0] for r in got.values())


def test_awkward_rows(awkward, nothing):
    words = S.words_of(awkward, keep=("doc_id",), length=1)
    assert words.filter("doc_id is null").count() == 8 and words.columns == ["doc_id", "word"]
    assert {(r["word"], r["n"]) for r in S.vocabulary(words, 3, 4).collect()} == {("the", 5)}
    assert S.grouped(S.vocabulary(S.words_of(nothing))).count() == 0
