"""Rules as a table, held against every phrase looked for on every line."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import custom_rules as C
from riskloom.operators.scan import scan

RULES = "rule_id string, phrase string, severity string, category string, title string, extensions array<string>, unless array<string>, reach int"


def by_definition(files, rules):
    out = set()
    for project, path, text in files:
        lines = text.split("\n")[: -1 if text.endswith("\n") else None] if text else []
        for rule_id, phrase, severity, _, _, extensions, unless, reach in rules:
            if not phrase or (extensions is not None and "." + path.rsplit(".", 1)[1] not in extensions):
                continue
            for i, line in enumerate(lines):
                if phrase.lower() in line.lower():
                    around = lines[max(0, i - (reach or 0)) : i + (reach or 0) + 1]
                    if not any(u.lower() in x.lower() for u in unless or [] if u for x in around):
                        out.add((project, path, i + 1, rule_id, severity))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcxÉé1_ (") for _ in range(n))
    files = [(f"p{i % 3}", f"d/f{i}.{rng.choice(['py', 'md'])}", "\n".join(word(rng.randint(0, 30)) for _ in range(rng.randint(0, 700)))) for i in range(12)]
    files.append(("p0", "empty.py", ""))
    rules = []
    for i in range(300):
        phrase = rng.choice([word(rng.randint(1, 5)), rng.choice(files)[2][50 : 50 + rng.randint(3, 9)].replace("\n", "")])
        rules.append((f"r{i}", phrase, rng.choice(["High", "Low"]), "c", "t", rng.choice([None, None, [".py"], []]),
                      rng.choice([None, [], [word(4)], [word(3), word(2), ""]]), rng.choice([None, 0, 3, 300])))
    return files, rules + [("none", None, "High", "c", "t", None, None, 1), ("empty", "", "High", "c", "t", None, None, 1)]


def rows(df):
    return [(r.project_id, r.path, r.line_no, r.rule, r.severity) for r in df.collect()]


@pytest.mark.parametrize("sampled", [0.0, 1.0])
def test_against_all_phrases_on_all_lines(spark, tables, sampled):
    files, rules = tables
    lines = C.explode_lines(spark.createDataFrame(files, "project_id string, path string, text string"))
    got = rows(C.find(lines, spark.createDataFrame(rules, RULES), sampled=sampled))
    assert len(got) == len(set(got)) and set(got) == by_definition(files, rules) and len(got) > 200


def test_several_phrases_of_a_rule(spark):
    files = spark.createDataFrame([("p", "a.py", "one TWO\nthree\ntwo")], "project_id string, path string, text string")
    rules = spark.createDataFrame([("r", "Two", "High", "c", "t"), ("r", "one", "High", "c", "t"), ("s", "e", "Low", "c", "t")],
                                  "rule_id string, phrase string, severity string, category string, title string")
    got = scan(files, rules=rules)
    assert sorted((r.line_no, r.rule, r.keyword, r.evidence) for r in got.collect()) == [
        (1, "r", "one", "one TWO"), (1, "s", "e", "one TWO"), (2, "s", "e", "three"), (3, "r", "two", "two")]
    assert scan(files, rules=rules.limit(0)).count() == 0 and scan(files.limit(0), rules=rules).count() == 0


def test_a_line_meets_few_of_many_rules(spark):
    """With more rules, no more lines meet a rule: what is joined follows what is found."""
    lines = spark.range(4000).select(F.lit("p").alias("project_id"), F.lit("a.py").alias("path"), F.col("id").cast("int").alias("line_no"),
                                     F.concat(F.lit("value = step_"), F.sha2(F.col("id").cast("string"), 256)).alias("line"))
    words = spark.range(5000).select(F.col("id").cast("string").alias("rule_id"), F.concat(F.lit("step_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12)).alias("phrase"))
    rules = words.select("*", *(F.lit(c).alias(c) for c in ("severity", "category", "title")))
    for n, found in ((50, 50), (5000, 4000)):
        index = C._index(C._phrases(rules.filter(F.col("rule_id").cast("int") < n).withColumns({c: F.lit(None).cast(t) for c, t in C._OPTIONAL.items()})), lines, 1.0)
        # The common beginning is no rule's run.
        assert index.filter(F.col("run").isin("ste", "tep", "ep_")).count() == 0
        assert C.find(lines, rules.filter(F.col("rule_id").cast("int") < n), sampled=1.0).count() == found


def test_what_excuses_many_rules_is_looked_for_once(spark):
    """A line with a phrase that excuses every rule is one row, not one for each rule."""
    lines = spark.range(1, 401).selectExpr("'p' AS project_id", "'a.py' AS path", "CAST(id AS INT) AS line_no",
                                           "CASE WHEN id % 4 = 0 THEN 'row = mask_fields(row)' ELSE 'key = pw' || id || '@' END AS line")
    rules = spark.range(1, 501).selectExpr("CAST(id AS STRING) AS rule_id", "'PW' || id || '@' AS phrase", "'High' AS severity", "'c' AS category", "'t' AS title",
                                           "array('Mask_Fields', 'sanitize') AS unless", "CAST(id % 2 AS INT) AS reach")
    given = rules.withColumn("extensions", F.lit(None).cast("array<string>"))
    assert C.matches(lines, given).count() == 100 + 300
    # Rules of odd numbers reach the next line, and all but the first of these stand next to a fourth line.
    want = {1} | {i for i in range(1, 401) if i % 4 == 2}
    assert {r.line_no for r in C.find(lines, rules).collect()} == want
