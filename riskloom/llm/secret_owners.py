"""Secrets in texts, told apart by who owns them across the whole corpus.

Spans of several kinds are found in every text. Each span's value is hashed, and the hashes are counted
over the corpus by distinct owners and repositories. A value that more than `most_owners` owners hold
is an example that was copied around; one of few owners that looks like a credential of its kind is `live`;
the rest is `weak`. Keys with a body and tokens of a known form always look so; a value assigned to a
password-like name, or the password of an address, does by its place, unless it is a placeholder.

Everything is DataFrame functions. A text is split at the matches of a kind, and lengths of the pieces
give the positions, so each kind costs one pass over texts without a match. Only spans leave
the scan; counts are combined before each exchange, so a value in a third of all texts is no hot key.

Cases: a null or empty text has no spans; positions count code points, ends are exclusive; matches of one kind
do not overlap, those of two kinds may; equal values in one text count once for it; a null owner or
repository counts as one owner or repository of its own; repeated rows each get their row and count once;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import restored, sheltered, text_of

# Patterns of the kinds, the group that holds the value, the least length of it.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]{16,})", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
_KEY = r"(?:[A-Z]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----"
ADDED = {
    # The marker; what belongs to it is found in the text up to the next one (`_body`).
    "key": (rf"(-----BEGIN {_KEY})", 1, 1),
    "jwt": (r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1),
    "vendor": (r"((?:ghp_|gho_|glpat-|xox[bap]-|sk_live_|AIza)[A-Za-z0-9_-]{16,})", 1, 1),
    "address": (r"""(://[^\s:/@"']+:[^\s:/@"']{6,}@)""", 1, 1),
}
#: A key goes up to its END marker; where the text breaks off before, so do the lines of at least 12 key letters that follow.
KEY_END = rf"(?s)^(.*?-----END {_KEY})"
KEY_LINES = r"^((?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{12,})*)"
# What `KEY_LINES` finds, said by where it stops: a repeated group would need a deeper stack for each line.
_STOP = r"(?:\s|\\[nr])(?!\s|\\[nr]|[A-Za-z0-9+/=]{12})|(?!\\[nr])[^A-Za-z0-9+/=\s]"
KINDS = list(BASE) + list(ADDED)
PLACEHOLDER = (r"(?i)change.?(?:me|it)|example|placeholder|redacted|dummy|^your|^insert|^replace|"
               r"^(?:null|none|true|false|undefined|required|optional|string|password|passwd|secret|token|default|value|text)$")
MOST_OWNERS = 2
WHOLE_WORD = 16
COVER = "[SECRET]"


def _body(rest: Column) -> Column:
    """What belongs to a key marker, of the text after it."""
    whole = F.regexp_extract(rest, KEY_END, 1)
    lines = F.when(rest.rlike(r"^(?:\s|\\[nr])"), F.regexp_extract(rest, rf"(?s)^(.*?)(?:{_STOP}|$)", 1)).otherwise("")
    return F.when(whole != "", whole).otherwise(F.regexp_replace(lines, r"(?:\s|\\[nr])+$", ""))


def _spans(text: Column, kind: str) -> Column:
    """start, ord, end, value of every span of one kind, by position."""
    pattern, group, least = (BASE | ADDED)[kind]
    gaps = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start: bigint, ord: int, end: bigint, value: string>>)")
    bodies = F.transform(F.slice(gaps, 2, F.size(gaps)), _body) if kind == "key" else F.array().cast("array<string>")
    parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), bodies.alias("body"))

    def add(state, part):
        start, body = state["at"] + F.length(part["gap"]), F.coalesce(part["body"], F.lit(""))
        end = start + F.length(part["all"])
        span = F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (end + F.length(body)).cast("long").alias("end"),
                        F.concat(part["value"], body).alias("value"))
        kept = F.when(F.length(part["value"]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(F.coalesce(end, start).cast("long").alias("at"), kept.alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), add, lambda s: s["out"])
    return F.when(F.size(gaps) > 1, found).otherwise(empty)


def found_spans(text: Column) -> Column:
    """All spans by start, then kind as listed."""
    return F.array_sort(F.flatten(F.array(*(_spans(text, kind) for kind in KINDS))))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")


def _random(value: Column) -> Column:
    """Long enough, of letters and digits, and of many different characters."""
    letters = F.size(F.array_distinct(F.split(value, "")))
    random = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (letters >= 8)
    return (F.length(value) >= 16) & (random | value.startswith("AKIA"))


def _by_place(value: Column) -> Column:
    """No placeholder, and not one or few characters repeated."""
    return ~value.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(F.lower(value), ""))) >= 5)


def live_looking(value: Column, kind: Column) -> Column:
    """Whether a value looks like a credential of its kind (number in KINDS)."""
    of = lambda *names: kind.isin([KINDS.index(n) for n in names])
    body = F.length(F.regexp_replace(value, rf"-----(?:BEGIN|END) {_KEY}|\s", "")) > 0
    return _random(value) | of("jwt", "vendor") | (of("key") & body) | (of("assign") & _by_place(value)) | (
        of("address") & _by_place(F.regexp_extract(value, ":([^:@]*)@$", 1)))


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, mark (of the row's id and text), owner, repository and the spans of every text; written once."""
    return settle(docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("mark"), F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"), found_spans(text_of()).alias("spans")))


def ownership(scan: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """digest, n_owners, n_repositories and class of each value found in a scan."""
    each = F.array_distinct(F.transform("spans", lambda s: F.struct(s["value"].alias("value"), s["ord"].alias("ord"))))
    values = scan.select("owner", "repository", F.explode(each).alias("s")).select("owner", "repository", "s.value", "s.ord")
    values = values.select("owner", "repository", F.sha2("value", 256).alias("digest"), live_looking(F.col("value"), F.col("ord")).alias("looks"))
    one = values.groupBy("digest", "owner", "repository").agg(F.max("looks").alias("looks"))
    by_owner = one.groupBy("digest", "owner").agg(F.count("*").alias("n"), F.max("looks").alias("looks"))
    out = by_owner.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.max("looks").alias("looks"))
    kind = F.when(F.col("n_owners") > most_owners, "example").when(F.col("looks"), "live").otherwise("weak")
    return out.select("digest", "n_owners", "n_repositories", kind.alias("class"))


def _judged(scan: DataFrame, most_owners: int) -> DataFrame:
    """mark, live: values; example, weak: numbers of values, of each different row with spans."""
    values = scan.filter(F.size("spans") > 0).select("mark", F.explode(F.array_distinct(F.col("spans.value"))).alias("value"))
    named = values.withColumn("digest", F.sha2("value", 256)).join(ownership(scan, most_owners), "digest")
    return named.groupBy("mark").agg(
        F.collect_set(F.when(F.col("class") == "live", F.col("value"))).alias("live"),
        F.collect_set(F.when(F.col("class") == "example", F.col("value"))).alias("example"))


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS) -> DataFrame:
    """doc_id, all spans, and the classes of their values, one row per row of docs.

    spans: array of (start, ord: number in KINDS, end, value); live, example: values of these classes.
    """
    scan = scanned(docs, owner, repository)
    none = F.expr("cast(array() as array<string>)")
    return scan.join(_judged(scan, most_owners), "mark", "left").select(
        "doc_id", "spans", *(F.coalesce(c, none).alias(c) for c in ("live", "example")))


def _without(text: Column, value: Column) -> Column:
    """`text` with `value` blanked out; a short one only where it is no part of a longer word."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    return F.when(F.length(value) < WHOLE_WORD, F.regexp_replace(text, quoted, F.lit(COVER))).otherwise(F.replace(text, value, F.lit(COVER)))


def covered(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS) -> DataFrame:
    """`docs` with every live-looking value blanked out in the text, wherever it stands; n_chars follows."""
    judged = _judged(scanned(docs, owner, repository), most_owners).filter(F.size("live") > 0)
    longest = F.array_sort(F.col("live"), lambda a, b: F.length(b) - F.length(a))
    needed = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    own = sheltered(docs, needed).withColumn("_mark", F.xxhash64("doc_id", "text"))
    both = own.join(judged.select(F.col("mark").alias("_own"), longest.alias("_live")), F.col("_mark") == F.col("_own"), "left")
    text = F.when(F.col("_live").isNotNull(), F.aggregate("_live", F.col("text"), _without)).otherwise(F.col("text"))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_live").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restored(out, docs, needed)
