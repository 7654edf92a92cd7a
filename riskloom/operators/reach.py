"""User input that reaches a privileged call inside a function.

The lines of a function are those after its definition whose level is above the definition's: the indentation in
Python files, elsewhere the running sum of opening less closing braces. Its parameters are input. A name that is assigned
from input is input too, until it is assigned from anything else or through a masking word. A call of a function whose
name carries a risky word, with input among its arguments, is a finding; so is one inside an inner function.

One pass per file, no exchange: the facts of each line are worked out for themselves, then one fold over the lines
keeps the functions that are open, each with its input names. Its state is as deep as functions are nested.

Cases: a null text has no lines; blank lines and lines that only close a bracket end nothing; words in quotes are no
names, but for formatted strings and templates; a definition or call is read from one line, so parameters and
arguments on further lines are not seen, nor the body of a function that stands on the line of its definition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import rules as R
from ..functions.reuse import built_once
from ..functions.text import any_of, contains_any, evidence, extension, lines_of, squeeze, squeezed

_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*+"
# Formatted strings and templates (group 1) are kept, other quoted words go.
_QUOTED = "([fF]{0}|[fF]{1}|`[^`]*+`)|{0}|{1}".format(r'"(?:[^"\\]++|\\.)*+"', r"'(?:[^'\\]++|\\.)*+'")
_COMMENT = {".py": r"(?:^|\s)#.*$", "script": r"(?:^|\s)//.*$"}
# A risky word inside a name may be parted by underscores, as in names that are squeezed.
_RISKY = "|".join("_*".join(squeeze(w)) for w in dict.fromkeys(fv.CRITICAL_TOOL_WORDS + fv.HIGH_TOOL_WORDS))
_CALL = rf"(?i)((?:[\p{{L}}\p{{N}}_$])*?(?:{_RISKY})[\p{{L}}\p{{N}}_$]*)\s*\((.*)"
_ASSIGNED = rf"^\s*(?:(?:const|let|var)\s+)?({_NAME})\s*(?::[^=]*)?([-+*/|&]?=)(?![=>])(.*)$"
_STACK = "array<struct<level:int,at:int,names:array<string>>>"
_HITS = "array<struct<at:int,line_no:int>>"


def _names(text: Column) -> Column:
    """Names used in an expression: no attributes, no keywords of arguments."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_$.])({_NAME})(?!\s*=(?!=))"), F.lit(1))


def _parameters(code: Column) -> Column:
    """Names a definition takes, without defaults, types and the object itself."""
    bare = F.regexp_replace(code, r"\[[^\[\]]*\]", "")
    listed = F.regexp_extract(bare, r"\((.*)\)", 1)
    given = F.when(bare.rlike(r"\("), listed).otherwise(F.regexp_extract(bare, rf"({_NAME})\s*=>", 1))
    first = F.transform(F.split(given, ","), lambda p: F.regexp_extract(p, rf"^[\s*.{{]*({_NAME})", 1))
    return F.array_except(F.array_distinct(first), F.array(*map(F.lit, ("", "self", "cls", "this"))))


def _line_facts(line: Column, i: Column) -> Column:
    """What a line is, as far as it can be told from the line alone."""
    python = F.col("_ext") == ".py"
    plain = F.when(line.rlike("[\"']"), F.regexp_replace(line, _QUOTED, "$1")).otherwise(line)
    code = F.regexp_replace(plain, F.when(python, _COMMENT[".py"]).otherwise(_COMMENT["script"]), "")
    return F.struct((i + 1).alias("line_no"), line.alias("line"), code.alias("code"))


def _judged_line(fact: Column) -> Column:
    code, python = fact["code"], F.col("_ext") == ".py"
    named = R.definition_name(code, F.col("_ext"))
    fn = F.when(contains_any(F.lower(code), ("def", "function", "=>")), named).otherwise("")
    calls = code.contains("(") & (fn == "") & squeezed(code).rlike(R.RISKY_NAME)
    spaces = F.regexp_extract(F.replace(code, F.lit("\t"), F.lit(" " * 8)), "^ *", 0)
    passed = code.rlike(r"^\s*$") | (python & code.rlike(r"^\s*[)\]}]"))
    count = lambda c: F.length(code) - F.length(F.replace(code, F.lit(c), F.lit("")))
    none = F.array().cast("array<string>")
    assigned = code.contains("=") & (fn == "")
    return F.struct(
        fact["line_no"].alias("line_no"), fact["line"].alias("line"), passed.alias("passed"),
        F.when(python, F.length(spaces)).alias("indent"), code.rlike(r"^\s*\{").cast("int").alias("opens"),
        (count("{") - count("}")).cast("int").alias("deeper"), fn.alias("fn"),
        F.when(fn != "", _parameters(code)).otherwise(none).alias("parameters"),
        F.when(assigned, F.regexp_extract(code, _ASSIGNED, 1)).otherwise("").alias("name"),
        F.when(assigned, F.regexp_extract(code, _ASSIGNED, 2)).otherwise("").alias("sign"),
        F.when(assigned, _names(F.regexp_extract(code, _ASSIGNED, 3))).otherwise(none).alias("used"),
        F.lower(code).rlike(any_of(fv.MASKING_WORDS)).alias("masks"),
        F.when(calls, F.regexp_extract(code, _CALL, 1)).otherwise("").alias("action"),
        F.when(calls, _names(F.regexp_extract(code, _CALL, 2))).otherwise(none).alias("arguments"),
    )


def _step(state: Column, x: Column) -> Column:
    """Functions still open after a line, and the calls that input reached so far."""
    level = F.coalesce(x["indent"], state["depth"] + x["opens"])
    open_ = F.when(x["passed"], state["open"]).otherwise(F.filter(state["open"], lambda s: s["level"] < level))
    reached = F.transform(
        F.filter(open_, lambda s: F.arrays_overlap(s["names"], x["arguments"])), lambda s: F.struct(s["at"].alias("at"), x["line_no"].alias("line_no")))

    def after(s):
        from_input = F.arrays_overlap(s["names"], x["used"]) & ~x["masks"]
        names = (F.when(from_input, F.array_union(s["names"], F.array(x["name"])))
                 .when((x["sign"] == "=") | x["masks"], F.array_except(s["names"], F.array(x["name"]))).otherwise(s["names"]))
        return F.struct(s["level"].alias("level"), s["at"].alias("at"), names.alias("names"))

    kept = F.when(x["name"] == "", open_).otherwise(F.transform(open_, after))
    own = F.array(F.struct(level.alias("level"), x["line_no"].alias("at"), x["parameters"].alias("names")))
    return F.struct(
        (state["depth"] + x["deeper"]).alias("depth"), F.when(x["fn"] == "", kept).otherwise(F.concat(kept, own)).alias("open"),
        F.when(x["action"] == "", state["hits"]).otherwise(F.concat(state["hits"], reached)).alias("hits"))


@built_once
def _columns() -> tuple[Column, ...]:
    text, start = F.col("text"), F.struct(
        F.lit(0).alias("depth"), F.array().cast(_STACK).alias("open"), F.array().cast(_HITS).alias("hits"))
    may = (extension(F.col("path")).isin(fv.CODE_EXTENSIONS) & contains_any(F.lower(text), ("def", "function", "=>"))
           & squeezed(text).rlike(R.RISKY_NAME))
    found = F.transform(
        F.aggregate("_facts", start, _step, lambda s: s["hits"]),
        lambda h: F.struct(h["line_no"].alias("line_no"), h["at"].alias("input_line"), F.get("_facts", h["at"] - 1)["fn"].alias("fn"),
                           F.get("_facts", h["line_no"] - 1)["action"].alias("action"), F.get("_facts", h["line_no"] - 1)["line"].alias("line")))
    return may, F.transform(lines_of(text), _line_facts), F.transform("_lines", _judged_line), found


def input_reaches_action(files: DataFrame, keys: Sequence[str] = ("project_id",), evidence_chars: int | None = None) -> DataFrame:
    """One finding per call and function whose input reaches it; columns as `scan` gives them, and `input_line`.

    `files` as for `scan`. The severity is the tier of the called function's name; `input_line` is the line of the
    definition whose parameters are the input, `subject` the called function, `keyword` the defined one.
    """
    may, lines, facts, found = _columns()
    rows = files.filter(may).select(*keys, "path", "text", extension(F.col("path")).alias("_ext"))
    rows = rows.withColumn("_lines", lines).withColumn("_facts", facts)
    # Not by a column of its own: the planner would ask for its size first, and work all of it out twice.
    rows = rows.select(*keys, "path", F.inline(found)).withColumn("_word", R.tool_word(F.col("action")))
    return rows.select(
        *keys, "path", "line_no", evidence(F.col("line"), evidence_chars).alias("evidence"), F.lit(1).alias("stage"), F.col("input_line").alias("sub_ord"),
        F.lit("input").alias("rule"), R.tool_tier(F.col("_word")).alias("severity"), F.lit("Prompt Injection Risk").alias("category"),
        F.format_string(fv.INPUT_TITLE, "fn", "action").alias("title"), F.col("action").alias("subject"), F.col("fn").alias("keyword"),
        F.lit(False).alias("partial"), "input_line")
