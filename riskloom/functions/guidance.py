"""Columns that class a finding: scenario, fix, phrases, question routes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import SPACE, WORD, contains_any, first_word, trimmed, whole_words

_IDENT = rf"[a-zA-Z_]{WORD}*"


def _mapped(key: Column, table: dict, default: str | None = None) -> Column:
    out = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return out if default is None else F.coalesce(out, F.lit(default))


def scenario_type(category: Column) -> Column:
    value = F.lower(category)
    out = F.when(value.contains(fv.SCENARIO_TYPES[0][0]), fv.SCENARIO_TYPES[0][1])
    for needle, name in fv.SCENARIO_TYPES[1:]:
        out = out.when(value.contains(needle), name)
    return out


def scenario_priority(severity: Column, category: Column) -> Column:
    base = _mapped(F.lower(severity), fv.SCENARIO_PRIORITY)
    bonus = F.when(contains_any(F.lower(category), fv.SCENARIO_BONUS_CATEGORIES), fv.SCENARIO_PRIORITY_BONUS).otherwise(0)
    return F.least(F.coalesce(base, F.lit(55)) + bonus, F.lit(100))


def scenario_tool(title: Column, evidence: Column) -> Column:
    """The tool a scenario is about: a defined name, a risky-looking name, or a hint word."""
    text = F.lower(F.concat_ws(" ", title, evidence))
    defined = F.regexp_extract(text, rf"(?:function|def){SPACE}+['\"]?({_IDENT})", 1)
    risky = "|".join(fv.RISKY_NAME_PARTS)
    named = F.regexp_extract(text, rf"(?<!{WORD})({_IDENT}(?:{risky})[a-zA-Z_\p{{Nd}}]*)(?!{WORD})", 1)
    return F.coalesce(
        F.nullif(defined, F.lit("")), F.nullif(named, F.lit("")), first_word(text, fv.TOOL_HINTS), F.lit(fv.TOOL_HINT_DEFAULT)
    )


def capability(tool: Column) -> Column:
    value = F.lower(tool)
    hint = first_word(value, [h for h, _ in fv.TOOL_CAPABILITIES])
    return _mapped(hint, dict(fv.TOOL_CAPABILITIES), fv.TOOL_CAPABILITY_DEFAULT)


def scenario_title(kind: Column, tool: Column, secret: Column) -> Column:
    return (
        F.when(kind == "tool_abuse", F.format_string(fv.SCENARIO_TITLES["tool_abuse"], tool))
        .when(kind == "secret_reuse", F.format_string(fv.SCENARIO_TITLES["secret_reuse"], secret))
        .otherwise(_mapped(kind, fv.SCENARIO_TITLES))
    )


def scenario_secret(title: Column, evidence: Column) -> Column:
    text = F.upper(F.concat_ws("\n", title, evidence))
    return F.coalesce(first_word(text, fv.SECRET_NAMES), F.lit(fv.SCENARIO_SECRET_DEFAULT))


def fix_type(category: Column, title: Column) -> Column:
    """The kind of fix a finding calls for, by its category or by words of its title; else null."""
    value, words = F.lower(category), F.lower(title)
    out = None
    for needle, title_words, name in fv.FIX_TYPES:
        cond = value.contains(needle) | contains_any(words, title_words)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def fix_secret(title: Column, evidence: Column) -> Column:
    text = F.upper(F.concat_ws("\n", title, evidence))
    shaped = F.regexp_extract(text, rf"(?<!{WORD})([A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD))(?!{WORD})", 1)
    return F.coalesce(first_word(text, fv.SECRET_NAMES), F.nullif(shaped, F.lit("")), F.lit(fv.SECRET_NAME_DEFAULT))


def fix_tool(title: Column, evidence: Column) -> Column:
    text = F.concat_ws("\n", title, evidence)
    defined = F.regexp_extract(text, rf"(?:def|function){SPACE}+({_IDENT})", 1)
    quoted = F.regexp_extract(text, rf"['\"]({_IDENT})['\"]", 1)
    return F.coalesce(
        F.nullif(defined, F.lit("")), F.nullif(quoted, F.lit("")),
        first_word(F.lower(text), fv.FIX_TOOL_HINTS), F.lit(fv.FIX_TOOL_DEFAULT),
    )


def fix_title(kind: Column, tool: Column, secret: Column) -> Column:
    out = _mapped(kind, fv.FIX_TITLES)
    for name in ("human_approval_wrapper", "audit_logging_addition", "tool_scope_guard"):
        out = F.when(kind == name, F.format_string(fv.FIX_TITLES[name], tool)).otherwise(out)
    return F.when(kind == "env_secret_fix", F.format_string(fv.FIX_TITLES["env_secret_fix"], secret)).otherwise(out)


def fix_confidence(kind: Column, path: Column) -> Column:
    low = (kind == "tool_scope_guard") | ((kind == "prompt_input_sanitization") & F.lower(path).endswith(".txt"))
    return F.when(low, "low").otherwise("medium")


def fix_effort(kind: Column, confidence: Column) -> Column:
    return F.when((confidence != "low") & kind.isin(fv.LOW_EFFORT_FIXES), "low").otherwise("medium")


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(trimmed(text)), "[^a-zA-Z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("patch"))


def fix_file(finding_id: Column, kind: Column) -> Column:
    return F.format_string("%s-%s.patch", slug(finding_id), slug(kind))


def fix_phrase(category: Column, title: Column) -> Column:
    """One short sentence: what to do about a finding."""
    value, words = F.lower(category), F.lower(title)
    out = None
    for needle, title_words, phrase in fv.FIX_PHRASES:
        cond = value.contains(needle) | contains_any(words, title_words)
        out = F.when(cond, phrase) if out is None else out.when(cond, phrase)
    return out.otherwise(fv.FIX_PHRASE_DEFAULT)


def _mentions(text: Column, words: list[str], whole_word: bool) -> Column:
    found = contains_any(text, words)
    return found & text.rlike(whole_words(words)) if whole_word else found


def question_route(question: Column, whole_word: bool = False) -> Column:
    """Which answer a question gets; off-topic only when no on-topic word occurs at all."""
    text = F.lower(question)
    off = ~_mentions(text, fv.ON_TOPIC_WORDS, whole_word) & _mentions(text, fv.OFF_TOPIC_WORDS, whole_word)
    out = F.when(off, fv.ROUTE_OFF_TOPIC)
    for route, words in fv.QUESTION_ROUTES:
        out = out.when(_mentions(text, words, whole_word), route)
    return out.otherwise(fv.ROUTE_DEFAULT)


def overrides_instructions(text: Column) -> Column:
    """Does a message use one of the known override phrases?"""
    return contains_any(F.lower(text), fv.OVERRIDE_PHRASES)

