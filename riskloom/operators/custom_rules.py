"""Rules that come as a table: phrases to find in lines, any number of them.

Lines are not matched against the rules one by one. Each phrase is known by one of its runs of three characters, the one
that is rarest in a sample of the lines. Where a line has such a run, the texts around it that have the place and length of a phrase
known by it are looked up among the phrases: so a line meets as many texts as there are shapes of phrases (place of
the run, length), however many phrases share a shape, and a text meets one phrase.

Phrases are looked for once, whatever rules they belong to. Phrases that excuse a rule meet its findings only, not the rules.

Runs that no phrase is known by are sorted out before any join, by a bit table of fixed size in the plan.

rules: rule_id, phrase, severity, category, title and, where the table has them, extensions (array: only files of
these; null: all), unless (array of phrases: no finding where a line within `reach` lines holds one) and reach (null: 0).

Cases: case does not matter; a rule_id may have several rows, any of its phrases counts and a line gives one finding for each
rule_id, with the first phrase in order as keyword; phrases of one or two characters are known by themselves; a null or
empty phrase is found nowhere; null keys are keys; an empty rule table gives no findings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import evidence, extension
from ..session import settle
from .lines import explode_lines

RUN = 3
BITS = 1 << 20
BLOCK = 256
SAMPLED = 0.01
_OPTIONAL = {"extensions": "array<string>", "unless": "array<string>", "reach": "int"}


def _runs(text: Column, size: int) -> Column:
    last = F.length(text) - (size - 1)
    every = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _bit(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BITS))


def _phrases(rules: DataFrame) -> DataFrame:
    """Every phrase to look for once: low, the phrase in lower case; `unless` phrases too."""
    rows = rules.select(F.explode(F.concat(F.array("phrase"), F.coalesce("unless", F.array().cast("array<string>")))).alias("low"))
    return rows.select(F.lower("low").alias("low")).filter("low <> ''").distinct()


def _index(phrases: DataFrame, lines: DataFrame, sampled: float) -> DataFrame:
    """low, the run that it is known by, and where in it that run begins. The sample of lines decides which run that is, never what is found."""
    size = F.least(F.length("low"), F.lit(RUN))
    runs = F.when(size == RUN, _runs(F.col("low"), RUN)).otherwise(F.array("low"))
    each = phrases.withColumn("run", F.explode(runs))
    some = lines.filter(F.pmod(F.xxhash64("path", "line_no"), F.lit(10_000)) < int(sampled * 10_000))
    seen = some.select(F.explode(_runs(F.lower("line"), RUN)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))
    known = each.join(seen, "run", "left").groupBy("low").agg(rarest.alias("_best")).select("low", F.col("_best.run").alias("run"))
    return settle(known.withColumn("at", F.expr("locate(run, low)")))


def _table(index: DataFrame) -> tuple[Column | None, list[int]]:
    """The bit table of all runs in the index as a literal of at most BITS / 64 numbers, and the lengths of runs there are."""
    bit = _bit(F.col("run"))
    set_ = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
    words = index.groupBy(F.floor(bit / 64).cast("int").alias("w")).agg(F.bit_or(set_).alias("bits")).collect()
    sizes = sorted(r["n"] for r in index.select(F.length("run").alias("n")).distinct().collect())
    held = {r["w"]: r["bits"] for r in words}
    # One text that the optimizer turns into the array: an array of literals would be as many expressions.
    numbers = ",".join(str(held.get(i, 0)) for i in range(BITS // 64))
    return (F.split(F.lit(numbers), ",").cast("array<bigint>") if held else None), sizes


def matches(lines: DataFrame, rules: DataFrame, keys: Sequence[str] = ("project_id",), sampled: float = SAMPLED) -> DataFrame:
    """keys, path, line_no, line, low: every phrase on every line that holds it, once for each place there."""
    index = _index(_phrases(rules), lines, sampled)
    table, sizes = _table(index)
    rows = lines.select(*keys, "path", "line_no", "line").withColumn("_low", F.lower("line"))
    if table is None:
        return rows.limit(0).withColumnRenamed("_low", "low")
    known = lambda run: F.call_function("getbit", F.get(table, F.floor(_bit(run) / 64).cast("int")), (_bit(run) % 64).cast("int")) == 1

    def places(size: int) -> Column:
        last = F.length("_low") - (size - 1)
        at = F.filter(F.sequence(F.lit(1), last), lambda i: known(F.substring(F.col("_low"), i, F.lit(size))))
        return F.when(last >= 1, F.transform(at, lambda i: F.struct(i.alias("at"), F.substring(F.col("_low"), i, F.lit(size)).alias("run"))))

    none = F.array().cast("array<struct<at:int,run:string>>")
    met = rows.withColumn("_met", F.explode(F.concat(*(F.coalesce(places(size), none) for size in sizes))))
    shapes = index.select("run", "at", F.length("low").alias("n")).distinct().select(F.col("run").alias("_run"), F.col("at").alias("_at"), "n")
    begin = F.col("_met.at") - F.col("_at") + 1
    met = met.join(shapes, F.col("_met.run") == F.col("_run")).filter((begin >= 1) & (begin + F.col("n") - 1 <= F.length("_low")))
    texts = met.select(*keys, "path", "line_no", "line", F.substring(F.col("_low"), begin, F.col("n")).alias("low"), F.col("_run").alias("run"), F.col("_at").alias("at"))
    return texts.join(index, ["low", "run", "at"]).select(*keys, "path", "line_no", "line", "low")


def _fits(extensions: Column) -> Column:
    return extensions.isNull() | F.array_contains(extensions, extension(F.col("path")))


def _same(columns: Sequence[str], left: str, right: str) -> Column:
    return reduce(and_, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def find(
    lines: DataFrame, rules: DataFrame, keys: Sequence[str] = ("project_id",), evidence_chars: int | None = None, sampled: float = SAMPLED
) -> DataFrame:
    """Findings of a line table (keys, path, line_no, line) under a table of rules.

    Columns: keys, path, line_no, evidence, rule, severity, category, title, keyword.
    """
    rules = rules.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in rules.columns})
    rules = rules.select("rule_id", "phrase", "severity", "category", "title", "extensions", "unless", F.coalesce("reach", F.lit(0)).cast("int").alias("reach"))
    met = settle(matches(lines, rules, keys, sampled))
    place, rule = [*keys, "path"], ["rule_id", "severity", "category", "title", "reach"]
    named = rules.select(*rule, "extensions", F.lower("phrase").alias("low")).distinct()
    found = met.join(named, "low").filter(_fits(F.col("extensions")))
    found = settle(found.groupBy(*place, "line_no", *rule).agg(F.first("line").alias("line"), F.min("low").alias("keyword")))
    # Lines that excuse a finding, by blocks of lines: phrases that excuse its rule meet the blocks in its reach, which are bounded rows.
    block = lambda at: F.floor(at / BLOCK).cast("int")
    unless = rules.select("rule_id", "extensions", F.explode("unless").alias("low")).select("rule_id", "extensions", F.lower("low").alias("low")).filter("low <> ''").distinct()
    asked = found.select(*place, "line_no", "rule_id", "reach").distinct().alias("f").join(unless.alias("u"), _same(["rule_id"], "f", "u"))
    asked = asked.filter(_fits(F.col("u.extensions"))).select(*(f"f.{c}" for c in (*place, "line_no", "rule_id", "reach")), "u.low").distinct()
    asked = asked.withColumn("_block", F.explode(F.sequence(block(F.col("line_no") - F.col("reach")), block(F.col("line_no") + F.col("reach")))))
    control = met.join(unless.select("low").distinct(), "low", "left_semi")
    control = control.groupBy(*place, "low", block(F.col("line_no")).alias("_block")).agg(F.collect_set("line_no").alias("_lines"))
    near = F.exists(F.col("e._lines"), lambda at: F.abs(at - F.col("f.line_no")) <= F.col("f.reach"))
    excused = asked.alias("f").join(control.alias("e"), _same([*place, "low", "_block"], "f", "e") & near, "left_semi")
    one = ["line_no", "rule_id", "reach"]
    left = found.alias("f").join(excused.select(*place, *one).alias("e"), _same([*place, *one], "f", "e"), "left_anti")
    return left.select(
        *place, "line_no", evidence(F.col("line"), evidence_chars).alias("evidence"), F.col("rule_id").alias("rule"), "severity", "category", "title", "keyword")


def find_in_files(files: DataFrame, rules: DataFrame, keys: Sequence[str] = ("project_id",), evidence_chars: int | None = None) -> DataFrame:
    """As `find`, of files(keys, path, text)."""
    return find(settle(explode_lines(files, keys)), rules, keys, evidence_chars)
