"""Scan source files: one pass per file, no shuffle.

Every rule looks at one file only, and so do the approval and audit checks that follow from a
tool finding. A file is therefore judged inside its own row: its lines become an array, the few
lines that can matter are kept as `facts`, the lines around each are searched in place, and
only findings leave the row. Nothing is exchanged between tasks, so the size of a project does
not matter here, and the same code runs on a streaming DataFrame.

`files` needs `path`, `text` and the columns named in `keys` (a project, a report, a snapshot).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as fv
from ..functions import rules as R
from ..functions.nearby import window
from ..functions.reuse import built_once
from ..functions.text import (
    any_of, base_name, contains_any, evidence, extension, lines_of, masked, squeezed, trimmed, whole_words,
)
from .lines import near_by_window

ALL_RULES = ("secret", "prompt", "tool", "data", "json", "framework", "approval", "audit")
# Asked for beside the rules, it gives a row without severity and category for every file, so files without findings are seen too.
FILE = "file"
# Order of findings inside one project: rule stage, path, line, position on the line.
POSITION = ("stage", "path", "line_no", "sub_ord")

_SECRET = "|".join(f"(?:{pattern})" for pattern, _, _ in fv.SECRET_RULES)
_JSON_HINT = r"(?iu)\\u|" + any_of(fv.SENSITIVE_JSON_KEYS)

# Controls around a line: pattern, reach in lines, compare on lower-cased text. Each gets one bit.
_CONTROLS = {
    "approval": (whole_words(fv.MITIGATION_APPROVAL_WORDS), fv.MITIGATION_LINES, True),
    "audit": (whole_words(fv.MITIGATION_AUDIT_WORDS), fv.MITIGATION_LINES, True),
    "wrapper": (any_of(fv.MITIGATION_WRAPPER_WORDS), fv.MITIGATION_LINES, True),
    "masking": (any_of(fv.MASKING_WORDS), fv.MASKING_LINES, True),
    "framework_approval": (any_of(fv.FRAMEWORK_APPROVAL_WORDS), fv.FRAMEWORK_APPROVAL_LINES, True),
    "approval_gate": ("(?iu)" + any_of(fv.APPROVAL_WORDS), fv.APPROVAL_LINES, False),
    "audit_trail": ("(?iu)" + any_of(fv.AUDIT_WORDS), fv.AUDIT_LINES, False),
}
_REACHES = sorted({k for _, k, _ in _CONTROLS.values()})

_FACT = {
    "kind": "string", "line_no": "int", "line": "string", "fn": "string", "framework": "string",
    **{f"bits_{k}": "int" for k in _REACHES}, "json_text": "string",
}
_FACTS_TYPE = "array<struct<" + ",".join(f"{k}:{v}" for k, v in _FACT.items()) + ">>"


def _fact(**values: Column) -> Column:
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in _FACT.items()])


def _none() -> Column:
    return F.array().cast(_FACTS_TYPE)


def _candidates() -> Column:
    """Lines that define a risky function or register a risky tool."""
    ext = F.col("_ext")

    def candidate(lower: Column, i: Column) -> Column:
        line = F.get("_lines", i)
        return F.when(
            F.col("_odd") | contains_any(lower, fv.CANDIDATE_ROOTS),
            F.struct(
                (i + 1).alias("line_no"), line.alias("line"),
                R.definition_name(line, ext).alias("fn"), R.framework_of(line).alias("framework"),
            ),
        )

    return F.filter(F.transform("_lower", candidate), lambda c: c.isNotNull() & _risky(c["fn"], c["framework"], c["line"]))


def _risky(fn: Column, framework: Column, line: Column) -> Column:
    """Is the name of a definition, or what a line registers, one that a rule speaks of?"""
    risky_fn = squeezed(fn).rlike(R.RISKY_NAME) | F.lower(fn).rlike(R.DATA_NAME)
    risky_tool = framework.isNotNull() & squeezed(line).rlike(R.FRAMEWORK_RISK)
    return ((fn != "") & risky_fn) | risky_tool


def _line_bits() -> Column:
    """One number per line: which controls the line itself shows."""
    def bits(lower: Column, i: Column) -> Column:
        total = F.lit(0)
        for bit, (pattern, _, lowered) in enumerate(_CONTROLS.values()):
            shown = (lower if lowered else F.get("_lines", i)).rlike(pattern)
            total = total.bitwiseOR(F.when(shown, 1 << bit).otherwise(0))
        return F.when(F.col("_odd") | contains_any(lower, fv.CONTROL_ROOTS), total).otherwise(0)

    return F.transform("_lower", bits)


def _around(line_no: Column, k: int) -> Column:
    """Controls shown by any line from line_no - k to line_no + k."""
    return F.aggregate(window("_bits", line_no, k), F.lit(0), lambda seen, b: seen.bitwiseOR(b))


def _near(name: str) -> Column:
    bit, k = list(_CONTROLS).index(name), _CONTROLS[name][1]
    return F.col(f"bits_{k}").bitwiseAND(F.lit(1 << bit)) != 0


def _code_facts() -> Column:
    return F.transform("_found", lambda c: _fact(
        kind=F.lit("code"), line_no=c["line_no"], line=c["line"], fn=c["fn"], framework=c["framework"],
        **{f"bits_{k}": _around(c["line_no"], k) for k in _REACHES},
    ))


def _secret_facts() -> Column:
    def hit(lower: Column, i: Column) -> Column:
        line = F.get("_lines", i)
        close = (F.col("_odd") | contains_any(lower, fv.SECRET_ROOTS)) & line.rlike(_SECRET)
        return F.when(close, _fact(kind=F.lit("secret"), line_no=i + 1, line=line))

    return F.filter(F.transform("_lower", hit), lambda c: c.isNotNull())


@built_once
def _file_columns(rules: frozenset[str]) -> tuple[list[Column], list[Column], dict[str, Column], Column, Column, Column]:
    text, ext = F.col("text"), F.col("_ext")
    code_rules = {"tool", "data", "framework", "approval", "audit"} & rules
    is_code = ext.isin(fv.CODE_EXTENSIONS) if code_rules else F.lit(False)
    may_leak = (F.col("_odd") | contains_any(F.col("_low"), fv.SECRET_ROOTS)) if "secret" in rules else F.lit(False)
    parts = [F.when(F.size("_found") > 0, _code_facts()).otherwise(_none())]
    if "secret" in rules:
        parts.append(F.when(F.col("_leak"), _secret_facts()).otherwise(_none()))
    first_line = F.get(lines_of(text), F.lit(0))
    if "json" in rules:
        suspect = (ext == ".json") & text.rlike(_JSON_HINT)
        fact = _fact(kind=F.lit("json"), line_no=F.lit(1), line=first_line, json_text=text)
        parts.append(F.when(suspect, F.array(fact)).otherwise(_none()))
    if "prompt" in rules:
        named = ext.isin(".txt", ".md") & F.lower(base_name(F.col("path"))).contains("prompt") & (trimmed(text) != "")
        fact = _fact(kind=F.lit("prompt"), line_no=F.lit(1), line=first_line)
        parts.append(F.when(named, F.array(fact)).otherwise(_none()))
    if FILE in rules:
        parts.append(F.array(_fact(kind=F.lit(FILE))))
    return (
        [extension(F.col("path")).alias("_ext"), F.lower("text").alias("_low"),
         contains_any(text, fv.ODD_LETTERS).alias("_odd")],
        [is_code.alias("_code"), may_leak.alias("_leak")],
        {"_lines": F.when(F.col("_code") | F.col("_leak"), lines_of(text))},
        F.when(F.col("_code"), _candidates()),
        F.when(F.size("_found") > 0, _line_bits()),
        F.inline(F.concat(*parts)),
    )


def facts(files: DataFrame, keys: Sequence[str] = ("project_id",), rules: Sequence[str] = ALL_RULES) -> DataFrame:
    """The lines of each file that can lead to a finding, with the controls shown around them.

    Cheap tests come first: a line is only matched against patterns when it contains one of a few
    root words, and controls are only looked for in files that have a risky line.
    """
    of_path, needs, lines, found, bits, out = _file_columns(frozenset(rules))
    return (
        files.select(*keys, "path", "text", *of_path)
        .select("*", *needs)
        .withColumns(lines)
        .withColumn("_lower", F.transform("_lines", F.lower))
        .withColumn("_found", found)
        .withColumn("_bits", bits)
        .select(*keys, "path", out)
    )


def sensitive_keys(text: Column) -> Column:
    """The sensitive keys a JSON text holds at any depth, in list order; null when it is not valid JSON."""
    wanted = list(fv.SENSITIVE_JSON_KEYS)

    # A local function travels to the executors by value, so they need no copy of this package.
    def keys_of(texts: pd.Series) -> pd.Series:
        import json
        import re

        string = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"')
        other = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
        space = re.compile(r"[ \t\n\r]*")

        def deep(one):
            """As below for a text nested too deeply for the parser: brackets are kept on a list."""
            keys, open_, at, need = set(), [], space.match(one).end(), "value"
            while at < len(one):
                c = one[at]
                if need in ("value", "value or end") and c in "{[":
                    open_.append(c)
                    need, at = ("key or end" if c == "{" else "value or end"), at + 1
                elif c in "}]" and open_ and open_[-1] + c in ("{}", "[]") and need in ("more", "key or end", "value or end"):
                    open_.pop()
                    need, at = "more", at + 1
                elif c == "," and need == "more" and open_:
                    need, at = ("key" if open_[-1] == "{" else "value"), at + 1
                elif need in ("key", "key or end", "value", "value or end"):
                    found = string.match(one, at) or (other.match(one, at) if need.startswith("value") else None)
                    if not found:
                        return None
                    at = space.match(one, found.end()).end()
                    if need.startswith("key"):
                        if one[at : at + 1] != ":":
                            return None
                        keys.add(json.loads(found[0]).lower())
                        at, need = at + 1, "value"
                    else:
                        need = "more"
                else:
                    return None
                at = space.match(one, at).end()
            return [key for key in wanted if key in keys] if need == "more" and not open_ else None

        def walk(one):
            try:
                todo, keys = [json.loads(one)], set()
            except RecursionError:
                return deep(one)
            except (TypeError, ValueError):
                return None
            while todo:
                node = todo.pop()
                if isinstance(node, dict):
                    keys.update(key.lower() for key in node)
                    todo.extend(node.values())
                elif isinstance(node, list):
                    todo.extend(node)
            return [key for key in wanted if key in keys]

        return texts.map(walk)

    return F.pandas_udf(keys_of, T.ArrayType(T.StringType()))(text)


def _title(kind: str, *parts: Column) -> Column:
    return F.format_string(fv.TITLES[kind], *parts)


_FINDING = {
    "stage": "int", "sub_ord": "int", "rule": "string", "severity": "string", "category": "string",
    "title": "string", "subject": "string", "keyword": "string", "partial": "boolean",
}
# What scores, counts and gates need; leaving the rest out keeps their plans small.
_BRIEF = ("stage", "sub_ord", "rule", "severity", "category")


def _finding(fields: Sequence[str], when: Column, **values) -> Column:
    """A finding as a struct, null unless `when` holds."""
    cols = []
    for k in fields:
        v = values.get(k)
        v = v if isinstance(v, Column) else F.lit(v)
        cols.append((v.cast(_FINDING[k]) if values.get(k) is None else v).alias(k))
    return F.when(when, F.struct(*cols))


@built_once
def _line_columns(with_json: bool, brief: bool) -> list[dict[str, Column]]:
    fn, line, framework, is_secret = F.col("fn"), F.col("line"), F.col("framework"), F.col("kind") == "secret"
    first = {f"near_{name}": _near(name) for name in _CONTROLS} | {
        "_word": R.tool_word(fn), "_data_word": R.data_word(fn),
        "_fw_word": F.when(framework.isNotNull(), R.framework_word(line)),
        "_secret": F.when(is_secret, R.secret_severity(line)),
    }
    second = {
        "_tool": R.eased_severity(
            R.tool_tier(F.col("_word")), F.col("near_approval"), F.col("near_audit"), F.col("near_wrapper")),
        "_data": F.when(~F.col("near_masking"), F.col("_data_word")),
        "_fw": F.when(~F.col("near_framework_approval"), R.framework_severity(F.col("_fw_word"))),
    }
    if with_json:
        first["_json"] = sensitive_keys(F.col("json_text"))
    if not brief:
        first["_secret_name"] = F.when(is_secret, R.secret_name(line))
        second["_tool_title"] = _title("tool", fn)
        second["_fw_title"] = _title("framework", framework)
    return [first, second]


@built_once
def _finding_columns(rules: frozenset[str], brief: bool) -> Column:
    fn, framework = F.col("fn"), F.col("framework")
    tool_title, fw_title = F.col("_tool_title"), F.col("_fw_title")
    no_gate, no_trail = ~F.col("near_approval_gate"), ~F.col("near_audit_trail")
    has_tool, has_fw = F.col("_tool").isNotNull(), F.col("_fw").isNotNull()
    name, sensitive = F.col("_secret_name"), F.concat(F.lit("'"), F.array_join("_json", "', '"), F.lit("'"))
    tools = dict(category="Tool Permission Risk")
    approvals = dict(rule="approval", category="Human Approval Risk", sub_ord=0)
    audits = dict(rule="audit", category="Auditability Risk", sub_ord=0)
    make = partial(_finding, _BRIEF if brief else tuple(_FINDING))
    made = {
        "secret": lambda: [
            make(F.col("_secret").isNotNull(), stage=0, sub_ord=0, rule="secret", title=_title("secret", name),
                 severity=F.col("_secret"), category="Secret Exposure Risk", subject=name)],
        "prompt": lambda: [
            make(F.col("kind") == "prompt", stage=0, sub_ord=1, rule="prompt", title=fv.PROMPT_TITLE,
                 severity="Medium", category="Prompt Injection Risk", subject=base_name(F.col("path")))],
        "tool": lambda: [
            make(has_tool, stage=1, sub_ord=0, rule="tool", title=tool_title, severity=F.col("_tool"), subject=fn,
                 keyword=F.col("_word"), partial=F.col("near_approval") | F.col("near_audit"), **tools)],
        "data": lambda: [
            make(F.col("_data").isNotNull(), stage=1, sub_ord=1, rule="data", title=_title("data", fn),
                 severity="High", category="Data Exposure Risk", subject=fn, keyword=F.col("_data"))],
        "json": lambda: [
            make((F.col("kind") == "json") & (F.size("_json") > 0), stage=1, sub_ord=0, rule="json",
                 title=fv.JSON_TITLE, severity="Medium", category="Data Exposure Risk", keyword=sensitive)],
        "framework": lambda: [
            make(has_fw, stage=2, sub_ord=0, rule="framework", title=fw_title, severity=F.col("_fw"),
                 subject=framework, keyword=F.col("_fw_word"), **tools)],
        "approval": lambda: [
            make(has_tool & no_gate, stage=3, title=_title("approval", tool_title), severity=F.col("_tool"),
                 subject=fn, **approvals),
            make(has_fw & no_gate, stage=4, title=_title("approval", fw_title), severity=F.col("_fw"),
                 subject=framework, **approvals)],
        "audit": lambda: [
            make(has_tool & no_trail, stage=5, title=_title("audit", tool_title),
                 severity=R.audit_severity(F.col("_tool")), subject=fn, **audits),
            make(has_fw & no_trail, stage=6, title=_title("audit", fw_title),
                 severity=R.audit_severity(F.col("_fw")), subject=framework, **audits)],
        FILE: lambda: [make(F.col("kind") == FILE, stage=-1, sub_ord=0, rule=FILE)],
    }
    return F.inline(F.array(*[struct for rule in made if rule in rules for struct in made[rule]()]))


def scan(
    files: DataFrame, keys: Sequence[str] = ("project_id",), rules: Sequence[str] | DataFrame = ALL_RULES, brief: bool = False,
    evidence_chars: int | None = None,
) -> DataFrame:
    """All findings of all files; with a table as `rules`, those of its rules (see `custom_rules`).

    Evidence is the whole line, or its first `evidence_chars` characters; in secret findings the values
    are blanked out before any cut.

    Columns: keys, path, line_no, evidence, stage, sub_ord, rule, severity, category, title,
    subject, keyword, partial; the last four are left out when `brief`, which is enough for scores.
    A file yields at most one finding per (category, line, title), so with one row per (keys, path)
    the result is already free of repeats.
    """
    if isinstance(rules, DataFrame):
        from .custom_rules import find_in_files

        return find_in_files(files, rules, keys, evidence_chars)
    return _found(facts(files, keys, rules), keys, rules, brief, evidence_chars)


def _found(rows: DataFrame, keys: Sequence[str], rules: Sequence[str], brief: bool, evidence_chars: int | None) -> DataFrame:
    """Findings of facts; those of a line table bring their `near_` columns with them."""
    for columns in _line_columns("json" in rules, brief):
        rows = rows.withColumns({name: column for name, column in columns.items() if name not in rows.columns})
    line = F.when(F.col("kind") == "secret", masked(F.col("line"))).otherwise(F.col("line"))
    shown = [] if brief else [evidence(line, evidence_chars).alias("evidence")]
    return (
        rows.select(*keys, "path", "line_no", *shown, _finding_columns(frozenset(rules), brief))
        .filter(F.col("rule").isNotNull())
    )


def scan_lines(
    lines: DataFrame, keys: Sequence[str] = ("project_id",), rules: Sequence[str] = ALL_RULES, brief: bool = False,
    evidence_chars: int | None = None,
) -> DataFrame:
    """As `scan`, of a line table (keys, path, line_no, line), so a file may be longer than a row.

    Controls around a risky line are looked up in blocks of lines (`lines.near_by_window`), secrets on each line for
    itself. Of .json files only those with a sensitive word are put together again: whether a text is JSON
    is known of the whole only, so such a file must fit into a row.
    """
    line, ext = F.col("line"), extension(F.col("path"))
    rows = lines.select(*keys, "path", "line_no", "line").withColumn("_lower", F.lower("line"))
    lower, odd = F.col("_lower"), contains_any(line, fv.ODD_LETTERS)
    parts = []
    if {"tool", "data", "framework", "approval", "audit"} & set(rules):
        code = rows.filter(ext.isin(fv.CODE_EXTENSIONS)).withColumn("_try", odd | contains_any(lower, fv.CANDIDATE_ROOTS))
        code = code.withColumns({"fn": F.when(F.col("_try"), R.definition_name(line, ext)), "framework": F.when(F.col("_try"), R.framework_of(line))})
        shows = odd | contains_any(lower, fv.CONTROL_ROOTS)
        flags = {name: (shows & (lower if lowered else line).rlike(pattern), k) for name, (pattern, k, lowered) in _CONTROLS.items()}
        near = near_by_window(code, keys, flags, F.coalesce(_risky(F.col("fn"), F.col("framework"), line), F.lit(False)))
        parts.append(near.withColumns({"kind": F.lit("code"), "json_text": F.lit(None).cast("string")}))
    none = {f"near_{name}": F.lit(False) for name in _CONTROLS} | {c: F.lit(None).cast("string") for c in ("fn", "framework", "json_text")}
    if "secret" in rules:
        secret = rows.filter((odd | contains_any(lower, fv.SECRET_ROOTS)) & line.rlike(_SECRET))
        parts.append(secret.withColumns(none | {"kind": F.lit("secret")}))
    if "prompt" in rules:
        named = rows.filter(ext.isin(".txt", ".md") & F.lower(base_name(F.col("path"))).contains("prompt"))
        first = named.groupBy(*keys, "path").agg(F.max(trimmed(line) != "").alias("_said"), F.min_by("line", "line_no").alias("line"))
        parts.append(first.filter("_said").withColumns(none | {"kind": F.lit("prompt"), "line_no": F.lit(1)}))
    if "json" in rules:
        json_lines = rows.filter(ext == ".json")
        suspect = json_lines.filter(line.rlike(_JSON_HINT)).select(*keys, "path").distinct()
        ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
        text = F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("json_text")
        whole = json_lines.join(suspect, [*keys, "path"], "left_semi").groupBy(*keys, "path").agg(text, F.min_by("line", "line_no").alias("line"))
        parts.append(whole.withColumns(none | {"kind": F.lit("json"), "line_no": F.lit(1), "json_text": F.col("json_text")}))
    shown = [*keys, "path", "kind", "line_no", "line", "fn", "framework", *(f"near_{name}" for name in _CONTROLS), "json_text"]
    return _found(reduce(DataFrame.unionByName, (part.select(*shown) for part in parts)), keys, rules, brief, evidence_chars)


@built_once
def _text_columns() -> dict[str, Column]:
    subject, keyword, rule = F.col("subject"), F.col("keyword"), F.col("rule")
    whole_tool = (rule == "tool") & ~F.col("partial")
    why = (
        F.when(whole_tool, F.format_string(fv.TOOL_WHY, subject, keyword))
        .when(rule == "tool", F.format_string(fv.TOOL_WHY_PARTIAL, subject, keyword))
        .when(rule == "data", F.format_string(fv.DATA_WHY, subject))
        .when(rule == "json", F.format_string(fv.JSON_WHY, keyword))
        .when(rule == "framework", F.format_string(fv.FRAMEWORK_WHY, keyword, subject))
        .when(rule == "approval", fv.APPROVAL_WHY)
        .when(rule == "audit", fv.AUDIT_WHY)
        .when(rule == "secret", fv.SECRET_WHY)
        .when(rule == "prompt", fv.PROMPT_WHY)
        .when(rule == "input", F.format_string(fv.INPUT_WHY, keyword, subject))
    )
    fix = (
        F.when(whole_tool, F.format_string(fv.TOOL_FIX, subject))
        .when(rule == "tool", F.format_string(fv.TOOL_FIX_PARTIAL, subject))
        .when(rule == "data", F.format_string(fv.DATA_FIX, subject))
        .when(rule == "json", fv.JSON_FIX)
        .when(rule == "framework", fv.FRAMEWORK_FIX)
        .when(rule == "approval", fv.APPROVAL_FIX)
        .when(rule == "audit", fv.AUDIT_FIX)
        .when(rule == "secret", fv.SECRET_FIX)
        .when(rule == "prompt", fv.PROMPT_FIX)
        .when(rule == "input", F.format_string(fv.INPUT_FIX, subject))
    )
    return {"why_it_matters": why, "suggested_fix": fix}


def with_texts(findings: DataFrame) -> DataFrame:
    """Adds why_it_matters and suggested_fix, written out from the finding's rule and subject."""
    return findings.withColumns(_text_columns())


def definitions(files: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Every function definition in code files, with the words its name carries."""
    code, ext, lines, line_no, fn, words = _definition_columns()
    named = files.filter(code).select(*keys, "path", ext, lines).select(*keys, "path", line_no, fn)
    return named.filter(F.col("fn") != "").select("*", *words)


@built_once
def _definition_columns() -> tuple:
    ext, fn = extension(F.col("path")), F.col("fn")
    word = R.tool_word(fn)
    return (
        ext.isin(fv.CODE_EXTENSIONS), ext.alias("_ext"), F.posexplode(lines_of(F.col("text"))).alias("_pos", "line"),
        (F.col("_pos") + 1).alias("line_no"), R.definition_name(F.col("line"), F.col("_ext")).alias("fn"),
        [word.alias("tool_word"), R.tool_tier(word).alias("tool_tier"), R.data_word(fn).alias("data_word")],
    )
