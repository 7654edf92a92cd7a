import random
import re

import numpy as np
import pytest
import xxhash

from riskloom.llm import simhash_groups as S


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance):
    """Component of each fingerprint by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    index = S.decoded(words)
    assert (np.bincount(index, minlength=4096) == 2048).all()
    codewords = words[S.syndrome(words) == 0]
    assert len(codewords) == 4096 and np.bitwise_count(codewords[1:]).min() == 7
    assert S.decoded(codewords).tolist() == (codewords >> 11).tolist()


def test_two_errors_share_a_key():
    rng = random.Random(3)
    for bits in (23, 18):
        for _ in range(300):
            x = rng.getrandbits(bits)
            y = x
            for b in rng.sample(range(bits), rng.randint(0, 2)):
                y ^= 1 << b
            (kx, nx), (ky, ny) = (S.segment_keys(np.array([v], np.uint32), bits) for v in (x, y))
            assert set(kx[nx].tolist()) & set(ky[ny].tolist())


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_links_connect_what_all_pairs_connect(spark, most):
    rng = random.Random(11)
    prints = set()
    for _ in range(12):
        chain = [rng.getrandbits(64)]
        for _ in range(rng.choice([1, 3, 25])):
            x = rng.choice(chain)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            chain.append(x)
        prints |= set(chain)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in S.components(S.links(table, 4, most)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = groups(prints, 4)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_documents(spark, awkward, nothing):
    near = spark.createDataFrame([(20, "the same id with another Text"), (21, "The same ID with another text")], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(near)
    rows = [tuple(r) for r in docs.collect()]
    want_prints = [fingerprint(t) for _, t in rows]
    of = groups(want_prints, 4)
    least = {}
    for (doc_id, _), g in zip(rows, of):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    want = sorted((str(i), f"{p:016x}", str(least.get(g))) for (i, _), p, g in zip(rows, want_prints, of))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in S.near_duplicates(docs).collect())
    assert got == want
    assert S.near_duplicates(nothing).count() == 0


def test_one_of_each(awkward, nothing):
    kept = S.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids.count("1") == 2  # two texts under one id; the repeated row is gone
    assert ids.count("2") == 1 and "3" not in ids and "4" not in ids  # no words: one group
    assert "None" in ids
    assert S.one_of_each(nothing).count() == 0


def test_majority_in_pieces():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    sizes, at = np.array([0, 1, 254, 255, 256, 0, 600, 1634]), 0
    for got, size in zip(S.majority(hashes, sizes).tolist(), sizes):
        own = hashes[at : at + size].tolist()
        at += size
        assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > size)


def test_long_keys_in_bounded_blocks():
    """As many points as one round takes of a key, and more: found are all pairs, memory and time stay small."""
    import time
    import tracemalloc

    rng = np.random.default_rng(5)
    block = rng.integers(0, 1 << 64, S.MOST, dtype=np.uint64)
    flips = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, len(x)), dtype=np.uint64), axis=0)
    points = np.concatenate([flips(block[:3000], 4), rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)])
    block[-2000:] = flips(block[:2000], 3)
    tracemalloc.start()
    began = time.perf_counter()
    found = {(int(i), int(j)) for a, b in S._near(points, block, 4) for i, j in zip(a, b)}
    heads = S._labels(block, 4)
    assert time.perf_counter() - began < 120 and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    some = np.concatenate([np.arange(500), np.arange(3000, 3100)])
    for i in some:
        assert {j for k, j in found if k == i} == set(np.flatnonzero(np.bitwise_count(points[i] ^ block) <= 4).tolist())
    assert (heads[-2000:] == heads[:2000]).all() and len(np.unique(heads)) <= S.MOST - 2000
