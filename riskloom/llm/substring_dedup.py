"""Removal of passages that occur more than once, word windows of a fixed length at a time.

Every window of `window` words gets a Rabin-Karp hash. Windows are counted across the whole corpus;
each word under a repeated window goes, and overlapping windows merge into maximal intervals.

Counting moves hashes of 80 bits only: 64 of one polynomial, which are sorted, and 16 of another. A task sorts some four million
windows at a time, folds repeats, and packs them by bucket of hashes as differences of sorted numbers,
each with the shard of its document, so a pack holds windows of all shards and its bytes a window do not grow with the
table. A bucket is small enough for one task, which finds the windows that its packs share; they go back to
the shards that hold them, where the texts are read again and marked. Texts are exchanged once. Windows that very many documents share
are found first in a bounded sample (a window seen twice there is repeated for certain) and are then
never packed, so no bucket fills with one window; which windows the sample holds changes the work, not the result.

Two different windows are taken for equal with a chance of n^2 / 2^81 in a corpus of n windows: 1 in 100,000 at five
thousand million windows, some 30 GB of files.

Rows that agree in `keep` and text share a shard; a batch of rows is folded before it is exchanged, so a row that is there
a million times moves once from each batch.

Cases: words are runs of anything but space and \\x09-\\x0D; a null text has no words; texts shorter than a
window lose nothing; windows overlap freely inside one text and count there too; repeated rows are
rows like any other, so both lose what they share; rows without an id are kept; other columns are
ignored unless named in `keep`; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from . import bytewise as B
from .common import text_of, uniform

WINDOW = 35
SHARD_BYTES = 8 << 20
BUCKET_WINDOWS = 1 << 20
#: Beyond so many buckets they grow instead, up to BUCKET_MOST windows, so packs do not get short.
BUCKETS = 1 << 15
BUCKET_MOST = 1 << 23
EMIT_WINDOWS = 1 << 22
_SPACES = B.separators("spaces")
_SECOND = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, the first bytes of all, then the second; equal planes compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unplaned(data: memoryview, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def packed(first: np.ndarray, second: np.ndarray, mark: np.ndarray | None = None) -> bytes:
    """Windows in order of `first`, which is kept as differences, and with `mark` a number for each."""
    steps = first.copy()
    steps[1:] -= first[:-1]
    return planes(steps) + planes(second) + (planes(mark) if mark is not None else b"")


def unpacked(data: bytes, marked: bool = False) -> tuple[np.ndarray, ...]:
    data = memoryview(data)
    n = len(data) // (14 if marked else 10)
    with np.errstate(over="ignore"):
        first = np.cumsum(unplaned(data, np.uint64, n), dtype=np.uint64)
    second = unplaned(data[8 * n :], np.uint16, n)
    return (first, second, unplaned(data[10 * n :], np.uint32, n)) if marked else (first, second)


def _joined(parts) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*parts))


def found_in(first: np.ndarray, second: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which windows are in the table, which is sorted by its first numbers."""
    out = np.zeros(len(first), bool)
    at, left = np.searchsorted(table[0], first), np.arange(len(first))
    # More than one step only where windows of the table agree in their first number.
    while len(left):
        left = left[at[left] < len(table[0])]
        left = left[table[0][at[left]] == first[left]]
        out[left] |= table[1][at[left]] == second[left]
        at[left] += 1
    return out


def _ordered(first: np.ndarray, second: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The order by first, second and mark. Most windows differ in the first number, so only ties are sorted by all three."""
    order = np.argsort(first)
    at = first[order]
    tied = np.zeros(len(at), bool)
    tied[1:] = at[1:] == at[:-1]
    tied[:-1] |= tied[1:].copy()
    some = order[tied]
    order[tied] = some[np.lexsort((mark[some], second[some], first[some]))]
    return order


def _windows(data, offsets, window):
    """Words, both numbers of each window, and for each window the text it lies in (-1: it crosses a border)."""
    words = B.words_of(data, offsets, _SPACES)
    own = words.hashes()
    first = B.rolled(own, window)
    second = (B.mixed(B.rolled(B.mixed(own ^ np.uint64(_SECOND[0])), window, _SECOND[1])) >> np.uint64(48)).astype(np.uint16)
    n = len(first)
    doc = np.where(words.doc[:n] == words.doc[window - 1 :], words.doc[:n], -1) if n else np.zeros(0, np.int64)
    return words, first, second, doc


def _frequent(window: int):
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in B.blocks(batch.column("text")):
                _, first, second, doc = _windows(data, offsets, window)
                first, second = first[doc >= 0], second[doc >= 0]
                order = _ordered(first, second, second)
                first, second = first[order], second[order]
                new = np.ones(len(first), bool)
                new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                counts = np.diff(np.append(np.flatnonzero(new), len(first)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[new].view(np.int64)), pa.array(second[new].astype(np.int32)), pa.array(counts.astype(np.int64))], names=["h", "g", "n"])
    return run


def packs_of(first: np.ndarray, second: np.ndarray, shards: np.ndarray, buckets: int, known) -> list[tuple[int, bytes]]:
    """(bucket, windows with twice their shard, one more if they repeat there) of some windows."""
    order = _ordered(first, second, shards)
    first, second, shards = first[order], second[order], shards[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (shards[1:] != shards[:-1])
    again = np.zeros(int(new.sum()), np.uint32)
    again[np.cumsum(new)[~new] - 1] = 1
    first, second, mark = first[new], second[new], shards[new].astype(np.uint32) * np.uint32(2) + again
    free = ~found_in(first, second, known)
    first, second, mark = first[free], second[free], mark[free]
    bucket = ((first >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(first)]]).tolist() if len(first) else []
    return [(int(bucket[a]), packed(first[a:b], second[a:b], mark[a:b])) for a, b in zip(edges, edges[1:])]


def _packs(window: int, buckets: int, known):
    def emit(parts):
        rows = packs_of(*_joined(parts), buckets, known)
        for at in range(0, len(rows), 4096):
            some = list(zip(*rows[at : at + 4096]))
            yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64()), pa.array(some[1], pa.binary())], names=["bucket", "windows"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            of = batch.column("shard").to_numpy()
            for at, _, data, offsets in B.blocks(batch.column("text")):
                _, first, second, doc = _windows(data, offsets, window)
                inside = doc >= 0
                parts.append((first[inside], second[inside], of[doc[inside] + at].astype(np.uint32)))
                held += len(parts[-1][0])
                if held >= EMIT_WINDOWS:
                    yield from emit(parts)
                    parts, held = [], 0
        if held:
            yield from emit(parts)

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """Of one bucket: for each shard its windows that are repeated anywhere."""
    first, second, mark = _joined([unpacked(x.as_buffer(), True) for x in group.column("windows")])
    order = _ordered(first, second, mark)
    first, second, mark = first[order], second[order], mark[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    number = np.cumsum(new) - 1
    some = (np.bincount(number) > 1) | (np.bincount(number, mark & np.uint32(1)) > 0)
    stays = some[number]
    first, second, shard = first[stays], second[stays], (mark[stays] >> np.uint32(1)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    first, second, shard = first[order], second[order], shard[order]
    edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]).tolist() if len(shard) else []
    out = [(int(shard[a]), packed(first[a:b], second[a:b])) for a, b in zip(edges, edges[1:])]
    return pa.table({"shard": pa.array([x for x, _ in out], pa.int64()), "windows": pa.array([x for _, x in out], pa.binary())})


def _folded(names: list[str], schema: pa.Schema):
    """Rows of a batch that agree in all they keep and in text as one, with their number."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in (*names, "key", "text")]
            n = np.ones(len(batch), np.int64)
            if len(batch.column("key").unique()) < len(batch):
                place, first = {}, []
                for at, key in enumerate(zip(*(c.to_pylist() for c in columns))):
                    key = repr(key[:-1]), key[-1]
                    if key in place:
                        n[place[key]] += 1
                    else:
                        place[key] = at
                        first.append(at)
                columns, n = [c.take(pa.array(first)) for c in columns], n[first]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], schema=schema)

    return run


def _marked(window: int, known, keep: list[str], schema: pa.Schema):
    """Texts of one shard without the words under repeated windows."""

    def run(texts: pa.Table, windows: pa.Table) -> pa.Table:
        table = _joined([known, *(unpacked(x.as_buffer()) for x in windows.column("windows"))])
        order = np.argsort(table[0])
        table = table[0][order], table[1][order]
        n_words, n_removed, kept, spans = [], [], [], []
        for _, _, data, offsets in B.blocks(texts.column("text")):
            words, first, second, doc = _windows(data, offsets, window)
            hit = np.flatnonzero((doc >= 0) & found_in(first, second, table))
            depth = np.zeros(len(words.start) + 1, np.int32)
            depth[hit] += 1
            np.subtract.at(depth, hit + window, 1)
            gone = np.cumsum(depth[:-1]) > 0
            for i in range(len(offsets) - 1):
                a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                mine, own_words = gone[a:b], data[offsets[i] : offsets[i + 1]].tobytes().split()
                n_words.append(b - a)
                n_removed.append(int(mine.sum()))
                if n_removed[-1]:
                    own_words = [w for w, x in zip(own_words, mine.tolist()) if not x]
                    edge = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
                else:
                    spans.append([])
                kept.append(b" ".join(own_words))
        columns = [texts.column(c) for c in (*keep, "_n")]
        columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, schema.field("removed").type)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    return run


def common_windows(docs: DataFrame, window: int = WINDOW, sample: int = 4000, seen: int = 4, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Both numbers of windows that occur `seen` times in about `sample` documents; `most` at the utmost."""
    n = docs.count()
    some = docs.filter(uniform(F.col("doc_id"), F.col("text")) < min(1.0, sample / max(n, 1))).select(text_of().alias("text"))
    found = some.mapInArrow(_frequent(window), "h long, g int, n long").groupBy("h", "g").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= max(seen, 2)).orderBy(F.desc("n"), "h", "g").limit(most).collect()
    first, second = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["g"] for r in rows], np.uint16)
    order = np.argsort(first, kind="stable")
    return first[order], second[order]


def buckets_of(windows: int) -> int:
    return max(min(math.ceil(windows / BUCKET_WINDOWS), BUCKETS), math.ceil(windows / BUCKET_MOST), 1)


def without_repeats(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: the columns `keep`, n_words, n_removed, kept (words joined by one space), removed.

    `removed` lists the maximal removal intervals as word numbers, end exclusive.
    """
    if window < 1:
        raise ValueError("a window has a word at least")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = math.ceil(max(size, 1) / SHARD_BYTES), buckets_of(math.ceil(size / 6))
    known = common_windows(docs, window)
    names = [f"_{i}" for i in range(len(keep))]
    own = [F.col(c).alias(n) for c, n in zip(keep, names)]
    rows = docs.select(*own, F.xxhash64(*keep, "text").alias("key"), text_of().alias("text"))
    shard = F.pmod("key", F.lit(shards)).alias("shard")
    packs = rows.select(shard, "text").mapInArrow(_packs(window, buckets, known), "bucket long, windows binary")
    found = packs.groupBy("bucket").applyInArrow(_repeated, "shard long, windows binary")
    texts = StructType([*rows.schema, StructField("_n", LongType())])
    rows = rows.mapInArrow(_folded(names, to_arrow_schema(texts)), texts).select(*names, "_n", shard, "text")
    schema = StructType([*rows.select(*names, "_n").schema, *StructType.fromDDL("n_words long, n_removed long, kept string, removed array<struct<start: long, end: long>>")])
    out = rows.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(_marked(window, known, [*names], to_arrow_schema(schema)), schema)
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))))
    return out.drop("_n", "_copy").withColumnsRenamed(dict(zip(names, keep)))
