"""Spelling variants: words of a corpus that are one edit apart, each led to its most frequent form.

Two words are near when one code point is inserted, deleted or replaced. They are compared as rows of padded
matrices of code points, a tile of one block of words by another at a time: the common prefix and the common suffix of
every pair come from comparing columns, and a pair is near if both together reach the length of the longer word
less one.

Which words meet in a tile: words of length L and L + 1 form a class. A pair that is near agrees on the first half of the
shorter word or on all after it, so each word goes to two groups of its class, one for either half. A group whose
tiles would be too much work is parted again the same way, in the middle of what its words need not share, so a half that very
many words have in common makes more groups, not larger ones. When one code point is left, the alphabet
bounds the group. A pair belongs to one group only (its common prefix says which), so nothing is counted twice.
Only counts and the best form of each word leave a task, no pairs.

The form of a word is its near word with the largest count (ties: the smallest in code-point order), if that has `ratio` times
the word's count. Forms lead on to a root; counts grow by the ratio each step, so joins that double the
distance reach it in a few rounds.

Cases: words are runs of the letters A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased; null and empty texts
have none; repeated rows and rows without an id count like all others; words of any length are compared whole; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import text_of

LENGTH = 5
COUNT = 3
RATIO = 2
LETTERS = r"[a-zÀ-ÿ]+"
#: Code points that the tiles of a group may compare before the group is parted.
GROUP_WORK = 1 << 26
BUCKET_WORK = 1 << 30
BUCKET_ROWS = 20_000
TILE_CELLS = 1 << 19
_NEAR = "word string, n_near long, form_n long, form string"


def words_of(docs: DataFrame, keep: tuple[str, ...] = (), length: int = LENGTH) -> DataFrame:
    """The columns `keep` and `word`, a row for each run of letters of at least `length` code points."""
    lower = F.translate(text_of(), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(*keep, F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("word"))
    return rows.filter(F.length("word") >= length)


def vocabulary(words: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """word, n: the words of at least `length` code points that occur `count` times."""
    counted = words.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n"))
    return settle(counted.filter(F.col("n") >= count))


def _group() -> Column:
    """Words of a class that share the first `a` and the last `b` code points."""
    last = F.substring("word", F.length("word") - F.col("b") + 1, F.col("b"))
    return F.xxhash64("cls", "a", "b", F.substring("word", F.lit(1), F.col("a")), last)


def _parted(rows: DataFrame) -> DataFrame:
    """Each word in two groups: the middle that its group does not share is parted in two."""
    half = F.floor((F.col("cls") - F.col("a") - F.col("b")) / 2).cast("int")
    left = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    right = F.struct(F.col("a").alias("a"), (F.col("cls") - F.col("a") - half).alias("b"))
    two = rows.withColumn("_c", F.explode(F.array(left, right))).select("word", "n", "cls", "longer", "_c.a", "_c.b")
    return two.withColumn("grp", _group())


def _groups(words: DataFrame, work: int) -> tuple[DataFrame, float]:
    """Rows (word, n, cls, longer, a, b, grp) of groups of bounded work, and the work of all."""
    length = F.length("word")
    of_class = F.array(F.struct(length.alias("cls"), F.lit(False).alias("longer")), F.struct((length - 1).alias("cls"), F.lit(True).alias("longer")))
    rows = words.withColumn("_c", F.explode(of_class)).select("word", "n", "_c.*", F.lit(0).alias("a"), F.lit(0).alias("b"))
    done, total = [], 0.0
    while True:
        rows = settle(_parted(rows))
        base, every = F.sum((~F.col("longer")).cast("long")), F.count("*")
        cost = (base * every).cast("double") * (F.first("cls") + 1)
        # One code point between what all share: the alphabet bounds the group.
        last = F.first(F.col("cls") - F.col("a") - F.col("b")) <= 1
        sizes = settle(rows.groupBy("grp").agg(cost.alias("cost"), last.alias("last"), every.alias("every")).filter("cost > 0 and every > 1"))
        hot = ~F.col("last") & (F.col("cost") > work)
        small, n_hot = sizes.agg(F.sum(F.when(~hot, F.col("cost"))), F.sum(hot.cast("int"))).first()
        done.append(rows.join(sizes.filter(~hot).select("grp"), "grp"))
        total += small or 0
        if not n_hot:
            return reduce(DataFrame.unionByName, done), total
        rows = rows.join(sizes.filter(hot).select("grp"), "grp").drop("grp")


def matrix(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, a row each, padded with zeros."""
    out = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    top = int(out.max(initial=0))
    return out.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row of `left` and each of `right`, how many leading columns agree."""
    kind = np.uint8 if left.shape[1] < 1 << 8 else np.int32
    n, same = np.zeros((len(left), len(right)), kind), np.ones((len(left), len(right)), bool)
    for c in range(left.shape[1]):
        same &= left[:, c, None] == right[None, :, c]
        if c % 8 == 7 and not same.any():
            break
        n += same
    return n


def near_words(words: list[str], longer: np.ndarray, cls: int, a: int = 0, b: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each word how many are near to it, and the first of them (-1: none).

    The words are distinct, of `cls` code points or (`longer`) one more. Pairs count whose common prefix has `a` code points and,
    unless b is 0, less than cls - b. Two longer words are not compared: they are of the next class.
    """
    def block(at):
        return matrix([words[i] for i in at], cls + 1), matrix([words[i][::-1] for i in at], cls + 1)

    n, first = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    side = max(int(math.sqrt(TILE_CELLS / max(1, (cls + 1) / 64))), 1)
    base, more = np.flatnonzero(~longer), np.flatnonzero(longer)
    for at in range(0, len(base), side):
        rows = base[at : at + side]
        heads, tails = block(rows)
        others = [(base[k : k + side], cls - 1) for k in range(at, len(base), side)] + [(more[k : k + side], cls) for k in range(0, len(more), side)]
        for columns, reach in others:
            other_heads, other_tails = block(columns)
            prefix = _shared(heads, other_heads).astype(np.int32)
            near = prefix + _shared(tails, other_tails) >= reach
            near &= prefix >= a
            if b:
                near &= prefix < cls - b
            if columns[0] == rows[0]:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            for one, other in ((rows[i], columns[j]), (columns[j], rows[i])):
                np.add.at(n, one, 1)
                np.minimum.at(first, one, other)
    return n, np.where(n > 0, first, -1)


def _compared(table: pa.Table) -> pa.Table:
    grp = table.column("grp").to_numpy()
    word, n = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
    # In each group the most frequent word comes first, ties in code-point order, so the first near word is the best.
    order = np.lexsort((word.astype(str) if len(word) else word, -n, grp))
    grp, word, n = grp[order], word[order], n[order]
    cls, a, b, longer = (table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("cls", "a", "b", "longer"))
    cuts = np.concatenate([[0], np.flatnonzero(grp[1:] != grp[:-1]) + 1, [len(grp)]])
    out = []
    for low, high in zip(cuts.tolist(), cuts[1:].tolist()):
        count, first = near_words(word[low:high].tolist(), longer[low:high], int(cls[low]), int(a[low]), int(b[low]))
        some = np.flatnonzero(count)
        if len(some):
            best = low + first[some]
            out.append((word[low + some], count[some], n[best], word[best]))
    columns = [np.concatenate(c) if out else [] for c in (zip(*out) if out else [()] * 4)]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(_NEAR.split(", "), columns, kinds)})


def with_forms(words: DataFrame, ratio: float = RATIO, work: int = GROUP_WORK) -> DataFrame:
    """word, n and, of its near words, n_near, and form and form_n of the leading one (null: none has `ratio` times n)."""
    groups, total = _groups(words, work)
    buckets = max(math.ceil(groups.count() / BUCKET_ROWS), math.ceil(total / BUCKET_WORK), 1)
    # The number of tasks follows the work: by bytes these tables are small.
    dealt = groups.withColumn("_bucket", F.pmod("grp", F.lit(buckets))).repartition(buckets, "_bucket")
    near = dealt.groupBy("_bucket").applyInArrow(_compared, _NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("least"), "form"))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    leads = -F.col("_best.least") >= ratio * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, F.col("_best.form")).alias("form"), F.when(leads, -F.col("_best.least")).alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root of every word with a form, each round twice as far along."""
    links = settle(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further = settle(links.join(on, links["root"] == on["_w"], "left"))
        if further.filter("_w is not null").isEmpty():
            return links
        links = further.select("word", F.coalesce("_r", "root").alias("root"))


def grouped(words: DataFrame, ratio: float = RATIO, work: int = GROUP_WORK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the table (word, n) of distinct words.

    `root` is the last of the word's forms, the word itself if it has none.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their variants")
    formed = settle(with_forms(words.select("word", "n"), ratio, work))
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
