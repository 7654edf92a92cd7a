"""Columns that judge a line, a name, a severity or a category."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import SPACE, WORD, any_of, first_word, squeeze, squeezed, trimmed

_PY_DEF = rf"(?iu)def{SPACE}+({WORD}+){SPACE}*\("
_JS_DEF = rf"(?iu)function{SPACE}+({WORD}+){SPACE}*\("
_JS_ARROW = (
    rf"(?iu)(?:const|let|var){SPACE}+({WORD}+){SPACE}*={SPACE}*"
    rf"(?:async{SPACE}*)?(?:\([^)]*\)|{WORD}+){SPACE}*=>"
)
FRAMEWORK_PATTERNS = [(name, "(?iu)" + p.replace(r"\s", SPACE)) for name, p in fv.FRAMEWORK_PATTERNS]
RISKY_NAME = any_of(dict.fromkeys(squeeze(w) for w in fv.CRITICAL_TOOL_WORDS + fv.HIGH_TOOL_WORDS))
DATA_NAME = any_of(fv.DATA_ACCESS_WORDS)
FRAMEWORK_RISK = any_of(dict.fromkeys(squeeze(w) for w in fv.FRAMEWORK_RISK_WORDS))


def definition_name(line: Column, ext: Column) -> Column:
    """Name of the function a line defines, '' when it defines none."""
    named = F.regexp_extract(line, _JS_DEF, 1)
    script = F.when(named != "", named).otherwise(F.regexp_extract(line, _JS_ARROW, 1))
    return (
        F.when(ext == ".py", F.regexp_extract(line, _PY_DEF, 1))
        .when(ext.isin(fv.SCRIPT_EXTENSIONS), script)
        .otherwise("")
    )


def tool_word(name: Column) -> Column:
    """The risky word a function name carries: critical words first, list order decides."""
    squeezed_name = squeezed(name)
    return F.coalesce(
        first_word(squeezed_name, fv.CRITICAL_TOOL_WORDS, squeeze),
        first_word(squeezed_name, fv.HIGH_TOOL_WORDS, squeeze),
    )


def tool_tier(word: Column) -> Column:
    return F.when(word.isin(fv.CRITICAL_TOOL_WORDS), "Critical").when(word.isNotNull(), "High")


def data_word(name: Column) -> Column:
    return first_word(F.lower(name), fv.DATA_ACCESS_WORDS)


def framework_of(line: Column) -> Column:
    """The first agent framework whose pattern the line shows, else null."""
    name, pattern = FRAMEWORK_PATTERNS[0]
    out = F.when(line.rlike(pattern), name)
    for name, pattern in FRAMEWORK_PATTERNS[1:]:
        out = out.when(line.rlike(pattern), name)
    return out


def framework_word(line: Column) -> Column:
    return first_word(squeezed(line), fv.FRAMEWORK_RISK_WORDS, squeeze)


def framework_severity(word: Column) -> Column:
    return F.when(word.isin(fv.FRAMEWORK_HIGH_WORDS), "High").when(word.isNotNull(), "Medium")


def eased_severity(tier: Column, approval: Column, audit: Column, wrapper: Column) -> Column:
    """Tool severity after the controls near the definition; null when they cover it fully."""
    covered = (approval & audit) | wrapper
    eased = F.when(tier == "Critical", "Medium").otherwise("Low")
    return F.when(covered | tier.isNull(), None).when(approval | audit, eased).otherwise(tier)


def audit_severity(severity: Column) -> Column:
    """One step down from the tool finding; everything below High ends at Medium."""
    return F.when(severity == "Critical", "High").otherwise("Medium")


def secret_severity(line: Column) -> Column:
    pattern, severity, _ = fv.SECRET_RULES[0]
    out = F.when(line.rlike(pattern), severity)
    for pattern, severity, _ in fv.SECRET_RULES[1:]:
        out = out.when(line.rlike(pattern), severity)
    return out


def secret_name(line: Column) -> Column:
    """Name of the value the first matching secret rule found, upper-cased."""
    out = None
    for pattern, _, default in fv.SECRET_RULES:
        found = F.coalesce(F.nullif(F.upper(F.regexp_extract(line, pattern, 1)), F.lit("")), F.lit(default))
        out = F.when(line.rlike(pattern), found) if out is None else out.when(line.rlike(pattern), found)
    return out


def severity_rank(severity: Column) -> Column:
    """critical 4 ... low 1, anything else 0; case and outer blanks do not matter."""
    value = F.lower(trimmed(F.coalesce(severity, F.lit(""))))
    out = F.lit(0)
    for name, rank in fv.SEVERITY_RANKS.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def severity_weight(severity: Column) -> Column:
    value = F.lower(F.coalesce(severity, F.lit("")))
    out = F.lit(0)
    for name, weight in fv.SEVERITY_WEIGHTS.items():
        out = F.when(value == name.lower(), weight).otherwise(out)
    return out


def normal_category(category: Column) -> Column:
    """One of the six category names when the text mentions it, else the text itself."""
    value, out = F.lower(category), None
    for mention, name in fv.CATEGORY_MENTIONS.items():
        out = F.when(value.contains(mention), name) if out is None else out.when(value.contains(mention), name)
    return out.otherwise(category)


def category_key(category: Column) -> Column:
    return F.translate(F.replace(F.lower(category), F.lit(" risk"), F.lit("")), " /", "__")


def status_of(score: Column) -> Column:
    top, name = fv.STATUS_BANDS[0]
    out = F.when(score <= top, name)
    for top, name in fv.STATUS_BANDS[1:]:
        out = out.when(score <= top, name)
    return out.otherwise(fv.STATUS_TOP)


def risk_band(score: Column) -> Column:
    """Band of a category score: lower risk, watch and review, fix first."""
    out = None
    for top, name in fv.RISK_BANDS:
        out = F.when(score <= top, name) if out is None else out.when(score <= top, name)
    return out.otherwise(fv.RISK_BAND_TOP)
