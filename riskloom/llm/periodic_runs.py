"""Periodic runs of words, found by uniting suffixes in order of falling common prefix.

A run is a stretch of words whose smallest period is q, at least `words` long and `times` periods long, that
neither neighbour extends. The suffixes of a text are sorted by prefix doubling; their neighbours are
united, longest common prefix first, in a union-find whose sets keep their positions in order, the smaller set moving
into the larger. Two positions i < j that become neighbours in a set while the common prefix is t,
with j - i <= t, seed a repetition with period j - i that ends at j + t; it is a run if the word before i differs
from the word before j. (A smaller period d would have put i + d, whose common prefix with i is longer,
between them before.) So every run has one seed, the pair of its start and its second period.

A run of period p shares max(words - p, (times - 1) * p) words with itself one period on, hence at
least `_shared` words whatever p is. Only texts in which a stretch of that many words occurs twice are sorted; this
is seen from Rabin-Karp hashes of whole Arrow batches, and equal stretches have equal hashes, so nothing is lost.

Each text is worked on where it is read; nothing is exchanged, and memory follows the longest text.

Cases: words are runs of anything but space and \\x09-\\x0D; a null or empty text has no words and no runs; runs may
overlap and each one counts; repeated rows and rows without an id are rows like any other; of other columns only
those named in `keep` are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import bytewise as B
from .common import text_of

WORDS = 24
TIMES = 3
_SPACES = B.separators("spaces")
_FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _shared(words: int, times: int) -> int:
    """Words that any run has in common with itself one period on, at least."""
    near = range(max(words // times - 1, 1), words // times + 3)
    return min(max(words - p, (times - 1) * p) for p in near)


def sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the next."""
    n = len(ids)
    ranks, rank, step = [], np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while True:
        ranks.append(np.append(rank, -1).astype(np.int32))
        key = rank * (n + 1)
        if step < n:
            key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    low, high = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        # Equal ranks of different positions mean 2 ** level equal words; a shorter rest equals nothing.
        same = (ranks[level][low] == ranks[level][high]) & (low < n) & (high < n)
        for at in (low, high, shared):
            at[same] += 1 << level
    return order, shared


def _neighbours(large: list, small: list):
    """Pairs of positions from both sorted lists that are neighbours in the merged list."""
    for at, x in enumerate(small):
        k = bisect(large, x)
        if k and (not at or small[at - 1] < large[k - 1]):
            yield large[k - 1], x
        if k < len(large) and (at + 1 == len(small) or small[at + 1] > large[k]):
            yield x, large[k]


def _merged(large: list, small: list) -> None:
    if len(small) * 16 < len(large):
        for x in small:
            insort(large, x)
    else:
        large += small
        large.sort()


def runs_of(ids: np.ndarray, words: int = WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start and period."""
    if len(ids) < max(words, times):
        return []
    order, shared = sorted_suffixes(ids)
    near = np.flatnonzero(shared >= _shared(words, times))
    near = near[np.argsort(-shared[near], kind="stable")]
    order, ids = order.tolist(), ids.tolist()
    parent: dict[int, int] = {}
    sets: dict[int, list] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    out = []
    for at, t in zip(near.tolist(), shared[near].tolist()):
        a, b = root(at), root(at + 1)
        large, small = sets.pop(a, None) or [order[a]], sets.pop(b, None) or [order[b]]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        for i, j in _neighbours(large, small):
            p = j - i
            if p <= t and p + t >= max(words, times * p) and (not i or ids[i - 1] != ids[j - 1]):
                out.append((i, p + t, p))
        _merged(large, small)
        parent[b], sets[a] = a, large
    return sorted(out, key=lambda run: (run[0], run[2]))


def _suspects(data, offsets, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the texts that hold some stretch of `shared` words twice."""
    words = B.words_of(data, offsets, _SPACES)
    hashes = B.rolled(words.hashes(), shared)
    n = len(hashes)
    doc = words.doc[:n]
    inside = doc == words.doc[shared - 1 :] if n else np.zeros(0, bool)
    doc, hashes = doc[inside], hashes[inside]
    with np.errstate(over="ignore"):
        hashes = hashes + B.stream(len(offsets) - 1, 5)[doc]
    order = np.argsort(hashes, kind="stable")
    again = hashes[order][1:] == hashes[order][:-1]
    again &= doc[order][1:] == doc[order][:-1]
    return np.diff(words.bounds), np.unique(doc[order][1:][again])


def _searched(words: int, times: int, keep: list[str], schema: pa.Schema):
    shared = _shared(words, times)

    def of_text(text: bytes) -> tuple[list, bytes]:
        own, numbers = text.split(), {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64)
        runs = runs_of(ids, words, times)
        if not runs:
            return [], b" ".join(own)
        depth = np.zeros(len(own) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        stays = np.cumsum(depth[:-1]) == 0
        listed = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        return listed, b" ".join(w for w, x in zip(own, stays.tolist()) if x)

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in B.blocks(batch.column("text")):
                n_words, suspects = _suspects(data, offsets, shared)
                suspects, runs, collapsed = set(suspects.tolist()), [], []
                for i in range(last - first):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    found, rest = of_text(text) if i in suspects else ([], b" ".join(text.split()))
                    runs.append(found)
                    collapsed.append(rest)
                columns = [batch.column(c).slice(first, last - first) for c in keep]
                columns += [pa.array(n_words, pa.int64()), pa.array(runs, schema.field("runs").type), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def runs(docs: DataFrame, words: int = WORDS, times: int = TIMES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: the columns `keep`, n_words, runs (start, length, period; by start, then period), collapsed.

    `collapsed` is the text without what any run repeats after its first period, words joined by one space.
    """
    if words < 1 or times < 2:
        raise ValueError("a run has a word and two periods at least")
    names = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), text_of().alias("text"))
    schema = StructType([*rows.select(*names).schema, *StructType.fromDDL(_FOUND)])
    out = rows.mapInArrow(_searched(words, times, names, to_arrow_schema(schema)), schema)
    return out.withColumnsRenamed(dict(zip(names, keep)))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first. Null without runs."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # The array is in order of start and period, so only a greater exponent replaces what is held.
    stronger = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(stronger(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    """`start,length,period` of every run, a line each."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
