"""Best-fit packing of texts into training sequences, with conflicts.

A bin holds `capacity` words. Two pieces conflict if they come from the same source or from the same
cluster of duplicates; a bin carries the sources and clusters it holds as bitmaps. Bins are ordered by what
is left in them. A piece looks up the first bin with enough room and goes on to its successors
until one is compatible, which is the tightest; if there is none it opens a bin.

A text longer than a bin is cut: full bins first, then the rest as a piece to pack. Pieces are dealt
evenly into shards of at most about `shard_rows`, each packed by one task, longest first, so shards
bound memory and a source or cluster of any size is spread over all. Only ids and lengths are exchanged.

Cases: null and empty texts have no words and no bin (bin null); ties go by id, then piece; repeated rows are pieces
of one cluster and so never share a bin; rows without a source conflict with each other like those of one source;
rows without an id are packed; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import text_of

CAPACITY = 2048
SHARD_ROWS = 2000
SPACES = r"[\x20\x09-\x0D]+"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin number of each piece, in the order given.

    `sources` and `clusters` are small numbers, each one bit of a bin's bitmap.
    """
    order: list[tuple[int, int]] = []  # (what is left, bin)
    held_sources, held_clusters, out = [], [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        source_bit, cluster_bit = 1 << source, 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order):
            number = order[at][1]
            if not (held_sources[number] & source_bit or held_clusters[number] & cluster_bit):
                break
            at += 1
        if at < len(order):
            left, number = order.pop(at)
            held_sources[number] |= source_bit
            held_clusters[number] |= cluster_bit
        else:
            left, number = capacity, len(held_sources)
            held_sources.append(source_bit)
            held_clusters.append(cluster_bit)
        if left > size:
            insort(order, (left - size, number))
        out.append(number)
    return out


def _numbered(values: list) -> list[int]:
    """Each distinct value as a small number; values that occur once share no bit with others."""
    seen: dict = {}
    return [seen.setdefault(v, len(seen)) for v in values]


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        sizes, clusters = group.column("size").to_pylist(), group.column("cluster").to_pylist()
        numbers = best_fit(sizes, _numbered(group.column("source").to_pylist()), _numbered(clusters), capacity)
        filled: dict[int, int] = {}
        starts = []
        for number, size in zip(numbers, sizes):
            starts.append(filled.get(number, 0))
            filled[number] = starts[-1] + size
        return pa.table({
            "row": group.column("row"), "doc_id": group.column("doc_id"), "piece": group.column("piece"), "word_start": group.column("word_start"),
            "size": group.column("size"), "source": group.column("source"), "cluster": group.column("cluster"),
            "shard": group.column("shard"), "number": pa.array(numbers, pa.int64()), "bin_start": pa.array(starts, pa.int64())})

    return run


def items(docs: DataFrame) -> DataFrame:
    """doc_id, source, words and the cluster of equal texts (case and white space aside) of each row."""
    text = F.trim(F.regexp_replace(text_of(), SPACES, " "))
    flat = docs.select("doc_id", "source", text.alias("t"))
    words = F.when(F.col("t") == "", 0).otherwise(F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1)
    return flat.select("doc_id", "source", words.cast("long").alias("words"), F.xxhash64(F.lower("t")).alias("cluster"))


def packed(rows: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows(doc_id, source, words, cluster) as pieces: doc_id, piece, word_start, n_words, source, cluster, bin, bin_start.

    `bin` names a bin as shard-number; full pieces of cut texts have bins of their own.
    """
    if capacity < 1 or shard_rows < 1:
        raise ValueError("a bin has room for a word, a shard for a row")
    # Written once, so that row numbers stay what they are if a task is repeated.
    rows = settle(rows.select("doc_id", "source", "words", "cluster", F.monotonically_increasing_id().alias("row")))
    whole = F.floor(F.col("words") / capacity)
    rest = rows.filter("words > 0").withColumn("piece", whole).withColumn("word_start", whole * capacity) \
        .withColumn("size", F.col("words") - whole * capacity).filter("size > 0")
    shards = math.ceil(max(rest.count(), 1) / shard_rows)
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    same = f"row long, doc_id {kinds['doc_id']}, piece long, word_start long, size long, source {kinds['source']}, cluster {kinds['cluster']}, shard long"
    tail = dealt.select("row", "doc_id", "piece", "word_start", "size", "source", "cluster", "shard") \
        .groupBy("shard").applyInArrow(_pack(capacity), f"{same}, number long, bin_start long")
    own = ["doc_id", "piece", "word_start", F.col("size").alias("n_words"), "source", "cluster"]
    tail = tail.select(*own, F.concat_ws("-", "shard", "number").alias("bin"), "bin_start")
    full = rows.filter(F.col("words") >= capacity).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)))
    full = full.withColumn("word_start", F.col("piece") * capacity).withColumn("size", F.lit(capacity).cast("long"))
    full = full.select(*own, F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin"), F.lit(0).cast("long").alias("bin_start"))
    none = rows.filter("words = 0").select(
        "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("word_start"), F.lit(0).cast("long").alias("n_words"),
        "source", "cluster", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("bin_start"))
    return full.unionByName(tail).unionByName(none)
