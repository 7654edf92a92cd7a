"""Columns over file paths and source text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1C-\x1F\x85\u00A0\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_EXTENSION = r"(?s)^(?:.*/)?\.*[^./][^/]*(\.[^./]*)$"


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' when the base name is only a dot-file name."""
    return F.lower(F.regexp_extract(path, _EXTENSION, 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """Language of a path by what follows its last dot; 'text' when unknown."""
    last = F.lower(F.substring_index(path, ".", -1))
    found = F.when(path.contains("."), last)
    out = F.lit("text")
    for ext, name in fv.LANGUAGES.items():
        out = F.when(found == ext, name).otherwise(out)
    return out


def lines_of(text: Column) -> Column:
    """Lines of a text as an array: every Unicode line break counts, no empty tail line."""
    last = F.substring(text, -1, 1)
    cut = F.when(text.endswith("\r\n"), 2).when(last.rlike(LINE_BREAK), 1).otherwise(0)
    body = F.substring(text, F.lit(1), F.length(text) - cut)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK, -1))


def trimmed(text: Column) -> Column:
    """Both ends freed of any Unicode white space."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def evidence(line: Column, limit: int | None = None) -> Column:
    """A source line as evidence: trimmed; with `limit`, its first characters."""
    return trimmed(line) if limit is None else F.substring(trimmed(line), 1, limit)


def masked(line: Column) -> Column:
    """A line with quoted literals, key literals and credentials in addresses blanked out."""
    quoted = F.regexp_replace(line, r"([\"'])[^\"'\s]{8,}[\"']", "$1***$1")
    keyed = F.regexp_replace(quoted, r"\b(sk-|AIza)[A-Za-z0-9_-]{16,}", "$1***")
    return F.regexp_replace(keyed, r"(://[^\s:/@\"']+):[^\s:/@\"']+@", "$1:***@")


def squeezed(text: Column) -> Column:
    """Only the lower-case letters and digits, so snake_case and camelCase compare equal."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def squeeze(word: str) -> str:
    return re.sub("[^a-z0-9]", "", word.lower())


def any_of(words: Iterable[str]) -> str:
    """A pattern that finds any of the words, taken literally."""
    return "|".join(re.escape(word) for word in words)


def whole_words(words: Iterable[str]) -> str:
    """As `any_of`, but not inside a longer identifier."""
    return rf"(?<!{WORD})(?:{any_of(words)})(?!{WORD})"


def first_word(text: Column, words: Iterable[str], key=lambda w: w) -> Column:
    """The first word of the list (list order, not text order) that `text` contains, else null."""
    pairs = [(key(word), word) for word in words]
    out = F.when(text.contains(pairs[0][0]), pairs[0][1])
    for needle, word in pairs[1:]:
        out = out.when(text.contains(needle), word)
    return out


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def filled(value: Column, default: str) -> Column:
    """`value` trimmed, or the default when it is null or blank."""
    return F.coalesce(F.nullif(trimmed(value), F.lit("")), F.lit(default))
