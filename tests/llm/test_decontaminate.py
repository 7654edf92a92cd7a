import itertools
import random
import re

import numpy as np

from riskloom.llm import bytewise as B, decontaminate as D


def tokens(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def holds(text, item):
    """Whether some aligned window of the item has at most the allowed number of other words."""
    x, y = tokens(item), tokens(text)
    length = min(D.LENGTH, len(x))
    allowed = 2 if len(x) >= 13 else 1 if len(x) >= 5 else 0
    return len(x) >= D.SHORTEST and any(
        sum(a != b for a, b in zip(x[i : i + length], y[j : j + length])) <= allowed
        for i in range(len(x) - length + 1) for j in range(len(y) - length + 1))


def test_masks_find_every_placement_of_changes():
    for changed in itertools.combinations(range(D.LENGTH), D.CHANGES):
        assert any(
            all(at + i not in changed for i, c in enumerate(mask) if c == "1")
            for mask in D.MASKS for at in range(D.LENGTH - len(mask) + 1))


def test_short_masks_find_every_single_change():
    for n in range(D.SHORT, D.LENGTH):
        for changed in range(n):
            assert any(
                all(at + i != changed for i, c in enumerate(mask) if c == "1")
                for mask in D.SHORT_MASKS for at in range(n - len(mask) + 1))


def test_short_items_with_one_other_word(spark):
    """Each place of items of one to twelve words replaced in turn, after a text that begins like the item."""
    items = [" ".join(f"i{n}w{k}" for k in range(n)) for n in range(1, 13)]
    texts, want = [], set()
    for j, item in enumerate(items):
        words = item.split()
        for changed in range(-1, len(words)):
            body = [w if k != changed else "other" for k, w in enumerate(words)]
            texts.append(" ".join([*words[:4], "and"] if len(words) > 4 else ["x"]) + " then " + " ".join(body) + " end")
            if changed < 0 or len(words) >= 5:
                want.add((len(texts) - 1, j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = D.passages(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["words"] == len(items[r["item_id"]].split()) and r["words"] - r["equal"] <= 1 for r in got)


def test_ignored_words_do_not_change_a_seed():
    words = B.stream(12, 9)
    for mask in D.MASKS:
        for i, c in enumerate(mask):
            other = words.copy()
            other[i] ^= np.uint64(77)
            assert (D.seed_hashes(words, mask)[0] == D.seed_hashes(other, mask)[0]) == (c == "0")


def cases():
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "ä", "x1"]) if rng.random() < 0.3 else "w" + str(rng.randint(0, 300))
    items = [" ".join(word() for _ in range(n)) for n in (3, 5, 8, 12, 13, 20, 40, 40)]
    items[7] = items[6].upper() + "!"
    texts = [None, "", "the of"]
    for k in range(120):
        body = [word() for _ in range(rng.randint(0, 60))]
        if k % 2:
            part = rng.choice(items).split()
            part = part[rng.randint(0, len(part) // 2) :]
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "changed"
            body[len(body) // 2 : len(body) // 2] = part
        texts.append(rng.choice([" ", ", ", "\n"]).join(body))
    return items, texts


def test_against_all_alignments(spark):
    items, texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.passages(docs, bench).collect()}
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if j != 7 and holds(t, x)}
    assert got == want and len(want) > 20
    kept = {r["doc_id"] for r in D.clean(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}


def test_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog and runs away from"), (2, None)], "item_id long, text string")
    out = D.clean(awkward, bench)
    assert out.columns == awkward.columns
    assert out.count() == awkward.count() - 2 and out.filter("doc_id = 1").count() == 1
    assert D.clean(awkward, bench.limit(0)).count() == awkward.count()
    assert D.clean(nothing, bench).count() == 0
    assert sorted(D.passages(awkward, bench).select("doc_id", "item_id").collect()) == [(1, 1), (1, 1)]


def test_every_item_is_looked_for(spark):
    bench = spark.createDataFrame(
        [(1, "白日依山尽黄河入海流欲穷千里目更上一层楼"), (2, "two words"), (3, "curly quotes mark these seven plain words"), (None, "an item that has no id at all"), (5, "ทดสอบ")],
        "item_id long, text string")
    texts = ["前 白日依山尽，黄河入海流。欲穷千X目，更上一层楼 后", "just two, words", "“Curly quotes” mark—these seven plain words…", "an item that has no id at all", "นี่คือทดสอบ", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.passages(docs, bench).collect()} == {(0, 1), (1, 2), (2, 3), (3, None), (4, 5)}
    assert [r["doc_id"] for r in D.clean(docs, bench).collect()] == [5]
