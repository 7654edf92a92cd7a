"""Random names and texts against small plain-Python statements of the rules."""

import json
import random
import re

from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions import guidance as G, rules as R
from riskloom.functions.text import extension, lines_of
from riskloom.operators.scan import sensitive_keys

RND = random.Random(11)
ALPHABET = "aZ_9é日"


def noise(n=4):
    return "".join(RND.choice(ALPHABET) for _ in range(RND.randint(0, n)))


def test_tool_words(spark):
    words = fv.CRITICAL_TOOL_WORDS + fv.HIGH_TOOL_WORDS
    camel = lambda w: "".join(p.title() for p in w.split("_"))
    names = [noise() + RND.choice([w, w.upper(), camel(w)]) + noise() for w in words for _ in range(5)] + [noise(9) for _ in range(60)]
    squeeze = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", R.tool_word(F.col("n")).alias("w"), R.tool_tier(R.tool_word(F.col("n"))).alias("t")).collect():
        want = next((w for w in words if squeeze(w) in squeeze(r.n)), None)
        assert r.w == want, r.n
        assert r.t == (None if want is None else "Critical" if want in fv.CRITICAL_TOOL_WORDS else "High")


def test_lines(spark):
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = ["".join(RND.choice(["a", "", " "]) + RND.choice(breaks) for _ in range(RND.randint(0, 6))) + RND.choice(["", "z"]) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", lines_of(F.col("t")).alias("l")).collect():
        assert r.l == texts[r.i].splitlines(), repr(texts[r.i])


def test_extensions(spark):
    import os

    paths = ["a.py", ".env", "x/.env", "prod.env", "..b.TXT", "a/b.c/d", "a.", "...", "x/y.tar.GZ", "a/.b.c", ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", extension(F.col("p")).alias("e")).collect():
        assert r.e == os.path.splitext(r.p.lower())[1], r.p


def test_json_keys(spark):
    def tree(depth):
        if depth == 0 or RND.random() < 0.2:
            return RND.choice([1, "email", None, "x\"phone\": 1", True, 1.5])
        if RND.random() < 0.5:
            return [tree(depth - 1) for _ in range(RND.randint(0, 3))]
        return {RND.choice(["Email", "phone", "k", "pass\"word", "ssn", "é"]): tree(depth - 1) for _ in range(RND.randint(0, 3))}

    def keys(node):
        if isinstance(node, dict):
            return {k.lower() for k in node} | {k for v in node.values() for k in keys(v)}
        return {k for v in node for k in keys(v)} if isinstance(node, list) else set()

    trees = [tree(4) for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, t string")
    for r in df.select("i", sensitive_keys(F.col("t")).alias("k")).collect():
        assert r.k == [k for k in fv.SENSITIVE_JSON_KEYS if k in keys(trees[r.i])]


def test_question_routes(spark):
    asked = {
        "Which deployment rule blocks me?": "deployment", "How would someone attack this?": "attack", "show the patch": "patch",
        "what should I do first about risk": "fix_first", "tell me a poem": "off_topic", "poem about my audit": "fix_first",
        "who won the football game": "off_topic", "is this special": "deployment",
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    rows = df.select("q", G.question_route(F.col("q")).alias("r"), G.question_route(F.col("q"), True).alias("w")).collect()
    assert {r.q: r.r for r in rows} == asked
    assert {r.q: r.w for r in rows}["is this special"] == "fix_first"
