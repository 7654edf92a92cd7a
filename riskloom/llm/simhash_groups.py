"""SimHash near-duplicates, found through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of at most four differing bits the
two best segments together hold at most two, so some pair of segments differs in at most two bits.
The (23, 12) Golay code is perfect: every 23-bit word decodes to one codeword. A segment's keys are
the codeword indices of itself and of all words one bit away, one to six in number; two segments that
differ in at most two bits have such a word in common, and so a key. Keys of two segments together
form a join key. Fingerprints that meet under a key are verified by counting bits.

Only distinct fingerprints take part, so exact copies cost nothing. Inside a key only a spanning
forest of the verified links is kept, never all pairs: components stay the same and a group of
thousands of near copies gives as many rows. A key with more than `most` fingerprints is worked
through in rounds of `most` against all that follow, so memory is bounded and no link is lost.

Cases: a null text counts as empty; texts without a word have fingerprint zero and link like any
other; repeated rows and repeated ids keep all their rows; rows without an id never give their group
its name (a group of none but such rows is named null); an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import restored, sheltered, text_of

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Fingerprints of a key that are compared at a time; what a key has beyond goes into another round.
MOST = 1 << 16
SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


# ------------------------------------------------------------------ fingerprints

def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(flat, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: len(words) - k]]
    return [digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of hashes the 64-bit words whose bits are set in over half of the run.

    Bits are added in byte lanes, 255 hashes at a time, so no matrix of bits is made.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first = (np.cumsum(sizes) - sizes)[full]
    pieces = (sizes[full] + 254) // 255
    of = np.repeat(np.arange(len(full)), pieces)
    cut = first[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    heads, lanes = np.cumsum(pieces) - pieces, np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, cut)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        over = 2 * counts > sizes[full][:, None]
        for lane in range(8):
            out[full] |= over[:, lane].astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, flat, sizes = batch.column("text"), [], []
        marks = []
        for text in texts:
            own = shingle_hashes(text.as_py().encode())
            flat += own
            sizes.append(len(own))
            if len(flat) >= 1 << 18:
                marks.append(majority(np.array(flat, np.uint64), np.array(sizes)))
                flat, sizes = [], []
        marks.append(majority(np.array(flat, np.uint64), np.array(sizes, np.int64)))
        prints = pa.array(np.concatenate(marks).view(np.int64))
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), prints], names=[*keep, "fp"])


def fingerprints(docs: DataFrame, *keep) -> DataFrame:
    """doc_id, the columns `keep`, and fp: the fingerprint as a signed 64-bit number."""
    rows = docs.select("doc_id", *keep, text_of().alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_fingerprint_batches, f"{kinds}, fp long")


# ------------------------------------------------------------------ Golay keys

def _remainders(bits: int, shift: int) -> np.ndarray:
    """Remainder modulo the generator polynomial of every `bits`-bit number times x^shift."""
    single = []
    for place in range(shift, shift + bits):
        value = 1 << place
        for top in range(place, 10, -1):
            if value >> top & 1:
                value ^= GENERATOR << (top - 11)
        single.append(value)
    out = np.zeros(1, np.uint32)
    for value in single:
        out = np.concatenate([out, out ^ np.uint32(value)])
    return out


_LOW, _HIGH = _remainders(12, 0), _remainders(11, 12)


def syndrome(words: np.ndarray) -> np.ndarray:
    return _LOW[words & np.uint32(0xFFF)] ^ _HIGH[words >> np.uint32(12)]


def _errors() -> np.ndarray:
    """For every syndrome the one error pattern of at most three bits that has it."""
    ones = np.uint32(1) << np.arange(23, dtype=np.uint32)
    two = np.unique((ones[:, None] | ones[None, :]).ravel())
    three = np.unique((two[:, None] | ones[None, :]).ravel())
    patterns = np.unique(np.concatenate([np.zeros(1, np.uint32), three]))
    out = np.zeros(2048, np.uint32)
    out[syndrome(patterns)] = patterns
    return out


_ERRORS = _errors()


def decoded(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ _ERRORS[syndrome(words)]) >> np.uint32(11)


def segment_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, up to 6) codeword indices of each word and of its neighbours, and which of them are new."""
    flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)])
    keys = np.sort(decoded(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    order = np.argsort(~new, axis=1, kind="stable")[:, : int(new.sum(axis=1).max(initial=1))]
    return np.take_along_axis(keys, order, 1), np.take_along_axis(new, order, 1)


def join_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every join key of the fingerprints."""
    parts = []
    for start, bits in SEGMENTS:
        word = (prints >> np.uint64(start)).astype(np.uint32) & np.uint32((1 << bits) - 1)
        parts.append(segment_keys(word, bits))
    rows, keys = [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ka, na), (kb, nb) = parts[a], parts[b]
        both = na[:, :, None] & nb[:, None, :]
        key = (ka.astype(np.int64)[:, :, None] << 12) | kb.astype(np.int64)[:, None, :] | (number << 24)
        rows.append(np.nonzero(both)[0])
        keys.append(key[both])
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            rows, keys = join_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["key", "fp"])


# ------------------------------------------------------------------ links inside a key

def forest(points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first member of each component of the points to its other members."""
    left = np.arange(len(points))
    heads, members = [], []
    while len(left) > 1:
        head, left, waiting = left[0], left[1:], [left[0]]
        while waiting and len(left):
            near = np.bitwise_count(points[left] ^ points[waiting.pop()]) <= distance
            if near.any():
                found, left = left[near], left[~near]
                waiting.extend(found.tolist())
                heads.append(np.full(len(found), head))
                members.append(found)
    if not heads:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return points[np.concatenate(heads)], points[np.concatenate(members)]


def _finer(points: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """`forest` of many points: only those meet that agree in one of distance + 1 stretches of bits."""
    if len(points) <= 64:
        return [forest(points, distance)]
    edges = np.linspace(0, 64, distance + 2).astype(int)
    out = []
    for low, high in zip(edges, edges[1:]):
        part = (points >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        out += [forest(points[run], distance) for run in np.split(order, cuts) if len(run) > 1]
    return out


def _link_batches(distance: int, most: int):
    """Over rows sorted by key: (a, b) links, and (key, fp) rows of overlong keys for the next round."""

    def small(keys, prints):
        a, b = [], []
        for gap in range(1, 8):
            hit = keys[gap:] == keys[:-gap]
            if not hit.any():
                break
            hit &= np.bitwise_count(prints[gap:] ^ prints[:-gap]) <= distance
            a.append(prints[:-gap][hit])
            b.append(prints[gap:][hit])
        return a, b

    def rows(a, b, key=None):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, -1) if key is None else np.full(n, key)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
            names=["key", "a", "b"])

    def run(batches):
        held_key, held, closed = None, [], False  # the key that may go on in the next batch

        def flush():
            if held_key is not None and not closed:
                points = np.unique(np.concatenate(held))
                for a, b in _finer(points, distance):
                    if len(a):
                        yield rows(a, b)

        for batch in batches:
            keys, prints = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            first = 0
            if keys[0] == held_key:
                own = prints[: ends[0]]
                if closed:
                    yield from later(own, held_key, block)
                else:
                    held.append(own)
                first = 1
            if first < len(starts):
                yield from flush()
                held_key, held, closed = int(keys[-1]), [prints[starts[-1] :]], False
                sizes = (ends - starts)[first:-1]
                few = np.repeat((sizes > 1) & (sizes <= 8), sizes)
                inner = slice(starts[first], starts[-1])
                a, b = small(keys[inner][few], prints[inner][few])
                if a:
                    yield rows(np.concatenate(a), np.concatenate(b))
                for at in np.flatnonzero(sizes > 8) + first:
                    for a, b in _finer(np.unique(prints[starts[at] : ends[at]]), distance):
                        if len(a):
                            yield rows(a, b)
            if not closed and sum(map(len, held)) > most:
                every = np.concatenate(held)
                held = [every[:most]]
                yield from flush()
                block, closed = every[:most], True
                yield from later(every[most:], held_key, block)
        yield from flush()

    def later(points, key, block):
        """Rows after the first `most` of a key: their links into that block, and themselves again."""
        heads = _labels(block, distance)
        for i, j in _near(points, block, distance):
            pairs = np.unique(np.stack([points[i], heads[j]]), axis=1)
            yield rows(np.ascontiguousarray(pairs[1]), np.ascontiguousarray(pairs[0]))
        yield rows(points, points, key)

    return run


def _near(points: np.ndarray, block: np.ndarray, distance: int, cells: int = 1 << 20):
    """Places (in points, in block) of all that differ in `distance` bits at most, a bounded number at a time.

    Only those are compared that agree in one of distance + 1 stretches of bits.
    """
    edges = np.linspace(0, 64, distance + 2).astype(int)
    for low, high in zip(edges, edges[1:]):
        stretch = lambda x: (x >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)  # noqa: B023, E731
        order = np.argsort(stretch(block), kind="stable")
        held, own = stretch(block)[order], stretch(points)
        first, last = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
        ends = np.cumsum(last - first)
        at = 0
        while at < len(points):
            stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + cells, "right")), at + 1)
            n = (last - first)[at:stop]
            i = np.repeat(np.arange(at, stop), n)
            j = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n)]
            near = np.bitwise_count(points[i] ^ block[j]) <= distance
            if near.any():
                yield i[near], j[near]
            at = stop


def _labels(block: np.ndarray, distance: int) -> np.ndarray:
    """A member of its component inside the block for each point."""
    points, number = np.unique(block, return_inverse=True)
    up = list(range(len(points)))

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in _finer(points, distance):
        for x, y in zip(np.searchsorted(points, a).tolist(), np.searchsorted(points, b).tolist()):
            up[root(x)] = root(y)
    return points[[root(x) for x in range(len(points))]][number]


def links(prints: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """a, b: enough links between distinct fingerprints of `prints` (fp) to connect all that link."""
    if not 0 <= distance <= 4:
        raise ValueError("the keys find differences of up to four bits")
    rows, out = prints.mapInArrow(_key_batches, "key long, fp long"), None
    while True:
        done = settle(rows.repartition("key").sortWithinPartitions("key")
                      .mapInArrow(_link_batches(distance, most), "key long, a long, b long"))
        found = done.filter("key = -1").select("a", "b")
        out = found if out is None else out.unionByName(found)
        rows = done.filter("key <> -1").select("key", F.col("a").alias("fp"))
        if rows.isEmpty():
            return out.distinct()


# ------------------------------------------------------------------ components

def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) reaches.

    Alternates large-star and small-star steps; every step is one grouping and one join, written down,
    until nothing changes.
    """
    edges, before = settle(edges.filter("a <> b")), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        low = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = settle(low.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def grouped(rows: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """`rows` (doc_id, fp, ...) with component_id: the smallest doc_id that each row reaches."""
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints.select("fp"), distance, most)).withColumnRenamed("node", "fp")
    named = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = settle(named.join(smallest, "root").select("fp", "component_id"))
    return rows.join(names, "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs(doc_id, text)."""
    out = grouped(settle(fingerprints(docs)), distance)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`docs` with one row of each group: the one whose doc_id names the group.

    Rows that repeat both the id and the text of the row that stays go too.
    """
    kept = grouped(settle(fingerprints(docs, F.xxhash64("text").alias("_text"))), distance)
    kept = kept.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), "_text").distinct()
    own = sheltered(docs, ["doc_id", "text"]).withColumn("_text", F.xxhash64("text"))
    both = own.join(kept.withColumnRenamed("_text", "_kept"), own["_text"].eqNullSafe(F.col("_kept")) & own["doc_id"].eqNullSafe(F.col("_id")))
    return restored(both.dropDuplicates(["doc_id", "_text"]), docs, ["doc_id", "text"])
