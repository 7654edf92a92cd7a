import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import language_id as L, toxicity as T
from riskloom.llm.common import remainder


def made(n, seed):
    """Texts of two made-up languages; some hold a word of a bad stem."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        bits = ["th", "er", "on", "ing"] if lang == "en" else ["eau", "oi", "é", "que"]
        words = ["".join(rng.choices(bits, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = ("scum" if lang == "en" else "vequ" + rng.choice(["ta", "ée", "sse"])) + rng.choice(["", "!", "###"])
        rows.append((i, " ".join(words), lang, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = made(900, 1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"), {r[0]: r for r in rows}


def test_toxicity_held_out(tables):
    from pyspark.sql import functions as F

    docs, labels, truth = tables
    held = remainder(F.col("doc_id"), 5) == 0
    model = T.learned(docs, labels, ~held)
    rows = T.scored(docs.filter(held), model).collect()
    right = sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]][3]) for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_table_form_equals_the_network():
    """The multiplied-out model gives what embeddings and filters give one by one."""
    rng = np.random.default_rng(0)
    texts = [r[1] for r in made(60, 2)] + ["", "one", "two words"]
    labels = np.array([i % 2 for i in range(len(texts))])
    tokens, bounds = T._tokens(pa.array(texts))
    net = T._Trainer(tokens, bounds, labels, rng)
    model = net.model()
    got = model.logits(tokens, bounds)
    for i in range(len(texts)):
        x = net.embed[tokens[bounds[i] : bounds[i + 1]]].sum(axis=1)
        pooled = []
        for w, f in net.filters.items():
            places = [sum(x[t + j] @ f[j] for j in range(w)) for t in range(len(x) - w + 1)]
            pooled.append(np.max(places, axis=0) if places else np.full(f.shape[2], -np.inf))
        want = np.maximum(np.concatenate(pooled) + net.filter_bias, 0) @ net.out + net.bias
        assert abs(got[i] - want) < 1e-3


def test_threshold_takes_the_best_gap():
    assert T._threshold(np.array([0.0, 1, 2, 5]), np.array([0, 0, 0, 1])) == 3.5


def test_toxicity_learns_from_long_texts(spark):
    """Texts of over 200,000 characters are labelled texts like others; all toxic ones are that long here."""
    rows = [(i, "calm words here " * 3, "en") for i in range(30)] + [(100 + i, "calm words here " * 13_000 + "scum", "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = T.learned(docs, docs.selectExpr("doc_id", "int(doc_id >= 100) as toxic"))
    assert model.fixed is None
    assert {r["doc_id"] for r in T.scored(docs, model).filter("score >= 0.5").collect()} == {100, 101, 102}


def test_toxicity_counts_all_texts(spark):
    """Counts of 9,000 texts in several parts, 3,000 of them toxic, against counts of all at once."""
    rows = [(f"w{i % 7} " * (i % 4) + f"x{i}", [None, "en", "fr"][i % 3], int(i % 3 == 0), i % 5 > 0) for i in range(9000)]
    table = spark.createDataFrame(rows, "text string, lang string, toxic int, train boolean").repartition(5)
    held, toxic, starts = T._counted(table, ["fr", "en"])
    own = [r for r in rows if r[3]]
    tokens, bounds = T._tokens(pa.array([r[0] for r in own]))
    want = T._held(tokens, bounds, np.array([r[2] for r in own]))
    assert (held == want[0]).all() and (toxic == want[1]).all()
    for g, lang in enumerate(["fr", "en"]):
        tokens, _ = T._tokens(pa.array([r[0] for r in rows if r[1] == lang]))
        n = np.bincount(tokens[:, T.STARTS] - T._BASES[T.STARTS], minlength=len(starts))
        assert np.allclose(starts[:, g], n + 0.01)


def test_toxicity_rounds_average_the_changes(spark, tables):
    """One round over two parts: what each part changes, from the same weights, averaged by how often it moved a bucket."""
    rows = spark.createDataFrame([(r[1], r[3]) for r in made(120, 5)], "text string, toxic int").repartition(2)
    texts, labels = zip(*((r["text"], r["toxic"]) for r in rows.collect()))
    tokens, bounds = T._tokens(pa.array(texts))
    net = T._Trainer(tokens, bounds, np.array(labels), np.random.default_rng(1))
    parts, start = rows.rdd.glom().collect(), T.copy.deepcopy(net)
    T._trained(rows, net, 0, 7)
    top, below, bias, n = np.zeros_like(net.embed, dtype=float), np.zeros(len(net.embed)), 0.0, 0
    for number, part in enumerate(parts):
        own, rng = T.copy.deepcopy(start), np.random.default_rng([7, 0, number])
        tokens, bounds = T._tokens(pa.array([r["text"] for r in part]))
        for some in np.array_split(rng.permutation(len(part)), max(1, len(part) // T.BATCH)):
            own.step(*T._picked(tokens, bounds, some), np.array([part[i]["toxic"] for i in some], np.float32))
        top += (own.embed - start.embed).astype(float) * own.moved[:, None]
        below += own.moved
        bias, n = bias + float(own.bias[0] - start.bias[0]) * len(part), n + len(part)
    want = start.embed + top / np.maximum(below, 1)[:, None]
    assert len(parts) == 2 and below.any() and np.allclose(net.embed, want, atol=1e-5)
    assert abs(net.bias[0] - start.bias[0] - bias / n) < 1e-5


def test_toxicity_thresholds_of_all_texts(spark, tables):
    """Thresholds of counted steps against those of the sorted logits, to the width of a step."""
    model = T.learned(*tables[:2])
    rows = spark.createDataFrame([(r[1], r[3]) for r in made(600, 6)], "text string, toxic int").repartition(3)
    got = T._calibrated(rows, model)
    texts, labels = zip(*rows.collect())
    tokens, bounds = T._tokens(pa.array(texts))
    logits, looks, labels = model.logits(tokens, bounds), model.language(tokens, bounds), np.array(labels)
    for g in range(len(model.languages)):
        own = looks == g
        assert abs(got[g] - T._threshold(logits[own], labels[own])) <= 1 / T.STEPS


@pytest.mark.parametrize("slots", [6, 9, 25])
def test_toxicity_labels_meet_their_texts(spark, slots):
    """Ids that share no slot, some or all: the rows and labels that a join by id gives, repeated and null ids included."""
    rows = [(i % 500 if i % 50 else None, f"text {i}", "en") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {i: int(i % 4 == 0) for i in range(0, 900, 3)}
    got = T._labelled(docs, spark.createDataFrame([*known.items()], "doc_id int, toxic int"), slots).collect()
    assert sorted(map(tuple, got)) == sorted((*r, known[r[0]]) for r in rows if r[0] in known)


def test_toxicity_exchanges_ids_not_texts(spark):
    """Labels too large to broadcast: with ids in slots of their own, the plan that ran exchanges no row with a text."""
    from riskloom.session import configured

    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(400)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)], "doc_id long, toxic int")
    with configured(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        rows = T._labelled(docs, known)
        assert len(rows.collect()) == 134
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_toxicity_without_labels(awkward, nothing, spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = T.learned(awkward, labels)
    out = T.scored(awkward, model, "tox")
    assert out.columns == [*awkward.columns, "tox"] and {r["tox"] for r in out.collect()} == {0.0}
    one = T.learned(awkward, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r["tox"] for r in T.scored(awkward, one, "tox").collect()} == {1.0}
    assert T.scored(nothing, model, "tox").count() == 0
    assert T.learned(nothing, labels).fixed == 0.0


def test_toxicity_of_awkward_rows(tables, awkward):
    docs, labels, _ = tables
    rows = T.scored(awkward, T.learned(docs, labels), "tox").collect()
    assert len(rows) == awkward.count() and all(0 <= r["tox"] <= 1 for r in rows)
    assert len({r["tox"] for r in rows if not (r["text"] or "").strip()}) == 1


def test_language_held_out(tables):
    from pyspark.sql import functions as F

    docs, _, truth = tables
    held = remainder(F.col("doc_id"), 4) == 2
    rows = L.predicted(docs.filter(held), L.learned(docs, ~held)).collect()
    assert sum(r["lang_pred"] == truth[r["doc_id"]][2] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pairs_inside_a_family(spark):
    rng, bits = random.Random(4), {"en": ["th", "ing"], "de": ["sch", "ung"], "fr": ["eau", "oi"], "es": ["ción", "ado"], "xx": ["zz", "qq"]}
    rows = [(i, " ".join("".join(rng.choices(bits[g], k=2)) for _ in range(30)), g) for i, g in enumerate(sorted(bits) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learned(docs)
    assert model.families == ["germanic", "romance", "xx"]
    assert [(model.languages[a], model.languages[b]) for a, b in model.pairs] == [("de", "en"), ("es", "fr")]
    assert all(r["lang_pred"] == r["lang"] for r in L.predicted(docs, model).collect())


def test_language_of_awkward_rows(tables, awkward, nothing):
    docs, _, _ = tables
    model = L.learned(docs)
    out = L.predicted(awkward, model, ("guess", "sure"))
    assert out.columns == [*awkward.columns, "guess", "sure"]
    for r in out.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["guess"] == "und") == (not letters) and (letters or r["sure"] == 0)
    assert L.predicted(nothing, model, ("guess", "sure")).count() == 0
    assert {r["guess"] for r in L.predicted(awkward, L.learned(nothing), ("guess", "sure")).collect()} == {"und"}
    one = L.learned(docs.filter("lang = 'fr'"))
    assert {r["lang_pred"] for r in L.predicted(docs, one).collect()} == {"fr"}


def test_folding_keeps_texts_apart():
    texts = ["ab12cd", "", "  x", "é!!é", "z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    body, starts = L._folded(data, offsets)
    got = [body[a:b].tobytes().decode() for a, b in zip(starts, starts[1:])]
    assert got == [" ab cd ", " ", " x ", " é é ", " z "]


def test_every_language_is_learned(spark):
    rng = random.Random(7)
    rows = []
    for g in range(70):
        bits = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(6)]
        rows += [(100 * g + i, " ".join(rng.choices(bits, k=25)), f"q{g}") for i in range(4 if g else 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learned(docs, most=70)
    assert len(model.languages) == 70
    right = [r["lang_pred"] == r["lang"] for r in L.predicted(docs, model).collect()]
    assert sum(right) / len(right) > 0.97


def test_margins_by_definition(spark):
    """Scores of a batch against sums over the runs of each text, one byte at a time."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdé fg1-", k=rng.randint(0, 60))) for _ in range(40)]
    langs = [["en", "de", "fr", "xx"][i % 4] for i in range(40)]

    def runs(text):
        plain = re.sub(rb"[^a-zA-Z\x80-\xff]+", b" ", b" " + text.encode() + b" ")
        for number, k in enumerate(L.RUNS):
            for i in range(len(plain) - k + 1):
                key = int.from_bytes(plain[i : i + k], "big") & 0xFFFFFFFF
                yield (key * 0x9E3779B1 % (1 << 32) >> (32 - L.BITS)) + (number << L.BITS)

    x = np.zeros((40, L.SIZE), np.float32)
    for i, text in enumerate(texts):
        for bucket in runs(text):
            x[i, bucket] += 1
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    model = L.fit(x.copy(), langs)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got, _ = model.predicted(data, offsets)
    margins = x.astype(np.float64) @ model.table + model.bias
    assert np.allclose(model.margins(data, offsets), margins, atol=1e-4)
    for i in range(40):
        # By hand: the family with the largest margin, then most votes of its pairs.
        best = max(range(len(model.families)), key=lambda f: margins[i, f])
        members = [g for g in range(len(model.languages)) if L.family(model.languages[g]) == model.families[best]]
        votes = {g: 0 for g in members}
        for p, (a, b) in enumerate(model.pairs):
            if a in votes:
                votes[a if margins[i, len(model.families) + p] > 0 else b] += 1
        assert got[i] in members and votes[got[i]] == max(votes.values())
