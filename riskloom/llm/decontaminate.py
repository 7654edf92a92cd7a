"""Benchmark passages in training texts, found by spaced seeds and verified word by word.

A seed is a fixed mask over neighbouring words: words under a 1 are hashed, words under a 0 are ignored,
so a seed still matches when an ignored word was replaced. The two masks are chosen such that in
`LENGTH` aligned words with up to `CHANGES` replaced, wherever these are, one mask fits at some place. Items of `SHORT`
words and more but under `LENGTH` have four shorter masks that find any one replaced word in the item as a whole
(a test tries all cases). Seeds of texts and of benchmark items are joined by hash; a join gives a pair
and an offset between the two, and there the words are compared: a text holds an item's passage if
in `LENGTH` aligned words at most `CHANGES` differ, or one of all words of an item that has `SHORT` and more.

Before the join, seeds of the texts pass a bit table made from the benchmark's seeds. Its size is
bounded (8 MB); for a benchmark of any size it only lets more seeds through, never fewer.

Words are runs of letters, marks and digits in lower case; in scripts that put no spaces between words every
character is one. An item of fewer than `SHORT` words is looked for as it is, without replacements, down to
a single word. Items of the same words count once, under their smallest id; one without an id is looked for too.

Cases: null and empty texts hold nothing; repeated rows and ids each hold what their texts hold, a
null id included; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from . import bytewise as B
from .common import UNSPACED, restored, sheltered, text_of

MASKS = ("111001011", "1101010011")
LENGTH = 13
CHANGES = 2
SHORT_MASKS = ("1111", "10111", "11011", "11101")
SHORT = 5
SHORTEST = 1
BASE = 0xD6E8FEB86659FD93
BITS = (16, 26)
_MARKS = B.separators("marks")


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words at every place where the mask fits."""
    n = max(len(words) - len(mask) + 1, 0)
    with np.errstate(over="ignore"):
        out = np.full(n, len(mask), np.uint64)
        for at in (i for i, c in enumerate(mask) if c == "1"):
            out = out * np.uint64(BASE) + words[at : at + n]
        return B.mixed(out)


def _seeds(batches, masks: tuple[str, ...], bits: np.ndarray | None, whole: bool):
    """(id, h, at) of the seeds that the bit table lets through; `whole`: only items as a whole."""
    for batch in batches:
        for first, _, data, offsets in B.blocks(batch.column("text")):
            words = B.words_of(data, offsets, _MARKS)
            hashes = words.hashes()
            for mask in masks:
                h = seed_hashes(hashes, mask)
                n = len(h)
                if not n:
                    continue
                good = words.doc[:n] == words.doc[len(mask) - 1 :]
                if bits is not None:
                    slot = h & np.uint64(len(bits) * 64 - 1)
                    good &= (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                if whole:
                    good &= np.diff(words.bounds)[words.doc[:n]] == len(mask)
                at = np.flatnonzero(good)
                doc = words.doc[at]
                if bits is not None and mask in _wholes(range(SHORT - 1)):
                    # A whole item is found once; its first place in a text is enough.
                    _, one = np.unique(np.stack([doc, h[at].view(np.int64)]), axis=1, return_index=True)
                    at, doc = at[np.sort(one)], doc[np.sort(one)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(doc + first)), pa.array(h[at].view(np.int64)), pa.array(at - words.bounds[doc])],
                    names=["id", "h", "at"])


def _wholes(lengths) -> tuple[str, ...]:
    return tuple("1" * n for n in lengths if n)


def allowed(n: int) -> int:
    """Words that may be replaced in a passage of an item of n words."""
    return CHANGES if n >= LENGTH else int(n >= SHORT)


def seeds(rows: DataFrame, masks: tuple[str, ...], bits: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(lambda b: _seeds(b, masks, bits, whole), f"id {kind}, h long, at long")


def plain(text: Column) -> Column:
    """Lower case, with ASCII between words wherever one ends; ASCII texts are so already."""
    parted = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "), f"([{UNSPACED}])", " $1 ")
    return F.when(text.rlike(r"[^\x00-\x7F]"), parted).otherwise(F.lower(text))


def bit_table(keys: DataFrame, n: int) -> np.ndarray:
    """One bit for each value of h modulo the size, 64 times as many as there are keys within the bounds."""
    size = 1 << min(max(int(64 * max(n, 1) - 1).bit_length(), BITS[0]), BITS[1])
    slot = F.col("h").bitwiseAND(F.lit(size - 1))
    words = keys.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    out = np.zeros(size // 64, np.uint64)
    for row in words.toLocalIterator():
        out[row["word"]] = np.uint64(row["bits"] & (1 << 64) - 1)
    return out


def aligned(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(first word in the text, words, equal words) of the passage at this offset; no words if there is none.

    `shift` is the place in the text where the item would begin. The passage joins all windows that
    pass the test and touch the longest run of such windows.
    """
    low, high = max(0, -shift), min(len(item), len(text) - shift)
    length = min(LENGTH, len(item))
    if high - low < length:
        return 0, 0, 0
    same = (text[shift + low : shift + high] == item[low:high]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(same)])
    good = sums[length:] - sums[:-length] >= length - allowed(len(item))
    if not good.any():
        return 0, 0, 0
    edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    best = int(np.argmax(ends - starts))
    first, last = int(starts[best]), int(ends[best]) - 1 + length
    return shift + low + first, last - first, int(sums[last] - sums[first])


def _word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return B.words_of(data, np.array([0, len(data)]), _MARKS).hashes()


def _verify(batches):
    for batch in batches:
        out = [[], [], [], [], []]
        for i in range(batch.num_rows):
            text, found = _word_hashes(batch.column("text")[i].as_py()), {}
            for hit in batch.column("hits")[i].as_py():
                start, words, equal = aligned(text, _word_hashes(hit["item"]), hit["shift"])
                item = hit["item_id"], hit["item"]
                if words and words > found.get(item, (0, 0, 0))[1]:
                    found[item] = (start, words, equal)
            for item in sorted(found, key=lambda k: (k[0] is None, k[0] or 0, k[1])):
                for column, value in zip(out, (i, item[0], *found[item])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(out[0], pa.int64())) for c in ("id", "doc_id")), *(pa.array(c, pa.int64()) for c in out[1:])],
            names=["id", "doc_id", "item_id", "start", "words", "equal"])


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, words, equal: the longest passage of each item in each text that holds one.

    docs(doc_id, text), benchmark(item_id, text). Positions count words of the text.
    """
    return _passages(docs, benchmark).drop("id")


def _passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As `passages`, with id: the hash of doc_id and text by which rows are told apart."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("id"), "doc_id", plain(text_of()).alias("text"))
    bare = F.trim(F.regexp_replace(plain(text_of()), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    items = benchmark.select("item_id", bare.alias("text")).filter("text <> ''").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    items = settle(items.withColumn("id", F.xxhash64("text")).withColumn("n", F.size(F.split("text", " "))).filter(F.col("n") >= SHORTEST))
    short = [r["n"] for r in items.filter(F.col("n") < LENGTH).select("n").distinct().orderBy("n").collect()]
    n = F.col("n")
    keys, masks = seeds(items.filter(n >= LENGTH), MASKS), MASKS
    if any(k >= SHORT for k in short):
        keys, masks = keys.unionByName(seeds(items.filter((n >= SHORT) & (n < LENGTH)), SHORT_MASKS)), masks + SHORT_MASKS
    wholes = _wholes(k for k in short if k < SHORT)
    if wholes:
        keys = keys.unionByName(seeds(items.filter(n < SHORT), wholes, whole=True))
    keys = settle(keys)
    near = seeds(rows, tuple(dict.fromkeys(masks + wholes)), bit_table(keys, keys.count()))
    hits = near.join(keys.withColumnsRenamed({"id": "item", "at": "item_at"}), "h")
    places = hits.select("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    places = places.join(items.select(F.col("id").alias("item"), "item_id", F.col("text").alias("words")), "item")
    lists = places.groupBy("id").agg(F.collect_list(F.struct("item_id", "shift", F.col("words").alias("item"))).alias("hits"))
    lists = lists.withColumnRenamed("id", "own")
    both = rows.join(lists, rows["id"] == F.col("own")).select("id", "doc_id", "text", "hits")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_verify, f"id long, doc_id {kind}, item_id long, start long, words long, equal long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the texts that hold a passage of the benchmark.

    Rows are told apart by id and text, so a repeated id loses only the rows that hold one.
    """
    found = _passages(docs, benchmark).select(F.col("id").alias("_found")).distinct()
    tagged = sheltered(docs, ["doc_id", "text"]).withColumn("_tag", F.xxhash64("doc_id", "text"))
    return restored(tagged.join(found, F.col("_tag") == F.col("_found"), "left_anti"), docs, ["doc_id", "text"])
