"""Winnowed fingerprints of texts.

Words are runs of letters, marks and digits in lower case; in scripts that put no spaces between words every character
is one. Each word has a hash, and every run of `GRAM` words the polynomial of its words' hashes in `BASE` modulo a prime,
the value that a rolling hash takes there; with three words it is worked out in place. In each window
of `WINDOW` neighbouring hashes the smallest is chosen, the rightmost of equals, and kept with its position. Two
texts that share WINDOW + GRAM - 1 words in a row share a chosen hash there.

A hash and its position are one number, 31 bits of hash above 31 bits that fall with the position,
so a plain minimum chooses the smallest hash and among equals the rightmost.

Everything is DataFrame functions. `edited` exchanges texts once, by id; the next text's beginning and hashes
go to the row before it in a second, smaller exchange. The order of ids is worked out on ids alone, in slices, so
no task holds it all. Of an edited text only the words from just before the edit on are hashed again.

Cases: a null text counts as empty; texts with fewer than `GRAM` words have one run of all their words, texts
without words an empty fingerprint; two empty fingerprints are alike (1), an empty and another are not (0). Rows of one
id share the next document, the one of the next larger id; if that id has several texts, the one with the
smallest 64-bit hash. A missing id comes before all others. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import number_rows
from ..session import settle
from .common import UNSPACED, text_of

GRAM = 3
WINDOW = 8
BASE = 1_540_483_477
MODULUS = (1 << 31) - 1
_GAP = r"[^\p{L}\p{M}\p{N}]+"
# The first of the scripts without spaces begins here; a cheap test before that for the scripts.
_HIGH = "[\u0E00-\\x{10FFFF}]"
_PLACES = (1 << 31) - 1


def spaced(text: Column) -> Column:
    """Lower case, everything between words as one space."""
    words = F.regexp_replace(F.lower(text), _GAP, " ")
    alone = F.regexp_replace(F.regexp_replace(words, f"([{UNSPACED}])", " $1 "), " +", " ")
    return F.when(text.rlike(_HIGH) & text.rlike(f"[{UNSPACED}]"), alone).otherwise(words)


def n_words(spaced_text: Column) -> Column:
    """Words of a text as `spaced` gives it, trimmed."""
    return F.when(spaced_text == "", 0).otherwise(F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit(""))) + 1)


def word_hashes(words: Column) -> Column:
    """A hash of each word of a trimmed, spaced text, below MODULUS."""
    each = F.transform(F.split(words, " "), lambda w: F.pmod(F.xxhash64(w), F.lit(MODULUS)))
    return F.when(words == "", F.array().cast("array<bigint>")).otherwise(each)


def hashed(words: Column, first: Column) -> Column:
    """Hash and position of each run of GRAM words (fewer: of all); `first` is the position of the first."""
    def run(h, i):
        for j in range(1, GRAM):
            word = F.get(words, i + j)
            h = F.when(word.isNull(), h).otherwise((h * BASE + word) % MODULUS)
        return F.shiftleft(h, 31) + F.lit(_PLACES) - (i + first).cast("long")

    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (GRAM - 1), F.lit(1))), run)


def chosen(hashes: Column) -> Column:
    """The minimum of each window, once."""
    least = F.transform(hashes, lambda x, i: F.least(x, *(F.get(hashes, i + j) for j in range(1, WINDOW))))
    return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.least(F.size(hashes), F.lit(1)))))


def position(x: Column) -> Column:
    return F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))


def hash_set(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: (F.shiftright(x, 31) - F.lit(1 << 31)).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two hash sets."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def written(prints: Column) -> Column:
    """hash:position of each choice, in order of position."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), position(x))), " ")


def with_prints(docs: DataFrame, text: Column, name: str = "prints") -> DataFrame:
    """`docs` with the chosen hashes of a text column; each step is a projection of its own."""
    return (
        docs.withColumn("_words", word_hashes(F.trim(spaced(text)))).withColumn("_hashes", hashed(F.col("_words"), F.lit(0)))
        .withColumn(name, chosen(F.col("_hashes"))).drop("_words", "_hashes")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of docs(doc_id, text)."""
    rows = with_prints(docs.select("doc_id", text_of().alias("text")), F.col("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), written(F.col("prints")).alias("fingerprint"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """key, rep: hash of the text that stands for the id; before, take: the id before it in the ring and how much of this text that takes."""
    ids = rows.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("rep"))
    ring = number_rows(ids.withColumn("g", F.lit(0)), ["g"], ["doc_id"], "at")
    total = ids.count()
    before = ring.select(F.col("key").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("take"), (F.col("at") % total + 1).alias("at"))
    return ring.select("key", "rep", "at").join(before, "at").drop("at")


def _edited_prints(rows: DataFrame) -> DataFrame:
    """edited_prints from head, taken (the new end) and prints of the whole old text."""
    head = F.ltrim(spaced(F.col("head")))
    rows = rows.withColumn("_head", head).withColumn("_open", F.when(F.col("_head").endswith(" "), 1).otherwise(0))
    rows = rows.withColumn("_count", n_words(F.rtrim("_head")))
    # Runs before `_same` hold none of the head's last word, which the edit may change.
    rows = rows.withColumn("_same", F.greatest(F.col("_count") - GRAM, F.lit(0)))
    rows = rows.withColumn("_from", F.greatest(F.col("_same") - (2 * WINDOW - 2), F.lit(0)))
    tail = F.when(F.col("_from") == 0, F.col("_head")).otherwise(F.expr("substring_index(_head, ' ', -(_count - _from + _open))"))
    rows = rows.withColumn("_tail", F.trim(F.regexp_replace(F.concat(tail, spaced(F.col("taken"))), " +", " ")))
    rows = rows.withColumn("_words", word_hashes(F.col("_tail"))).withColumn("_hashes", hashed(F.col("_words"), F.col("_from")))
    kept = F.filter("prints", lambda x: position(x) <= F.col("_same") - WINDOW)
    return rows.withColumn("edited_prints", F.array_distinct(F.concat(kept, chosen(F.col("_hashes"))))).drop(
        "_head", "_open", "_count", "_same", "_from", "_tail", "_words", "_hashes")


def edited(docs: DataFrame) -> DataFrame:
    """Each text beside itself with its last quarter replaced by the beginning of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("key"), text_of().alias("text"))
    order = settle(_neighbours(rows))
    # Both uses of `own` need the same columns, so that texts are hashed and exchanged once for the two.
    own = with_prints(rows.select("key", "text"), F.col("text")).repartition("key").join(order, "key")
    # Written as a difference, or the planner would exchange texts by this hash too.
    nexts = own.filter(F.xxhash64("text").bitwiseXOR(F.col("rep")) == 0).select(
        F.col("before").alias("key"), F.expr("left(text, take)").alias("start"), hash_set(F.col("prints")).alias("next_hashes"))
    both = own.drop("rep", "before", "take").join(nexts.dropDuplicates(["key"]), "key")
    both = both.withColumn("n", F.length("text")).withColumn("q", F.floor(F.col("n") / 4).cast("int"))
    both = both.withColumn("head", F.expr("left(text, n - q)")).withColumn("taken", F.expr("left(start, q)"))
    out = _edited_prints(both).withColumn("_own", hash_set(F.col("prints")))
    doc_id = F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(docs.schema["doc_id"].dataType))
    return out.select(
        doc_id.alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.sha2(F.concat("head", "taken"), 256).alias("edited_sha256"),
        written(F.col("prints")).alias("fingerprint"), written(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("_own"), hash_set(F.col("edited_prints"))).alias("near_edited"),
        likeness(F.col("_own"), F.col("next_hashes")).alias("near_next"))
