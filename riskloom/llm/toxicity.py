"""A convolutional text classifier for toxicity, trained in numpy inside Spark's tasks on all labelled texts.

A word is the sum of four hashed embeddings: of the word, of its first four and five bytes, and of its
last four. Filters of one, two and three words slide over the text, each keeps its maximum (at
least 0), and a logistic layer reads these. Embeddings start from the shrunken log odds of their
bucket, so filters begin near useful words; training then moves all weights (Adagrad).

Every labelled text is learned from, whole. Counts of buckets are sums over all tasks. In a round each task trains on
its own texts, from the weights that the round before left; the changes are averaged, those of a bucket by how often
each task moved it. What a task or the driver holds is the size of the weights, whatever the number of texts.

Texts meet their labels where they are read: ids, not texts, are joined with the labels, and what that gives goes to all tasks as a
table of bits of bounded size (`_labelled`). Only texts whose bit another id shares, with another label or none, are exchanged.

Thresholds are calibrated by language: one labelled text in five is kept out of training, its texts are split
by the language that the text itself looks like (a word-start model learned from all labelled texts), and
the score of a language is shifted so that its best threshold is 0.5. Thresholds lie between scores that are counted
in steps of 1 / 256 (of the logit).

Scoring reads every text whole; for that, embeddings and filters are multiplied out beforehand, so a word costs a few
table rows.

Cases: null and empty texts are scored like texts without words; labels without a document, with a null label
or a null id are not learned from; several labels of one id count as toxic if one is; without toxic labels
every score is 0, without others every score is 1, without any labels 0; repeated rows score alike;
columns of any name pass through. Where a class is missing among the texts kept out, or among the others, all texts serve.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from . import bytewise as B
from .common import text_of, uniform

#: Hash buckets of: the word, its first 4 bytes, its first 5 bytes, its last 4 bytes.
CHANNELS = ((None, False, 17), (4, False, 15), (5, False, 15), (4, True, 15))
STARTS = 1
DIM = 8
FILTERS = {1: 4, 2: 2, 3: 2}
#: Rounds over all texts: as many as show some 52,000 texts, within these bounds.
LEAST, MOST, SHOWN = 4, 8, 52_000
#: Texts and bytes that a task trains on at least, where there are as many.
TEXTS, BYTES = 2000, 16 << 20
BATCH = 64
#: Steps of the logit between which thresholds lie.
STEPS = 256
_MARKS = B.separators("marks")
_BASES = np.cumsum([0, *(1 << bits for _, _, bits in CHANNELS)])
_SIZE = int(_BASES[-1])
#: Changes are added up as whole numbers of this unit, so that their order does not matter.
_UNIT = float(1 << 20)
#: Ids are told apart by 2 ** SLOTS slots, 64 to a row of a broadcast table; that has 524,288 rows at most (38 MB as Spark holds them).
SLOTS = 25
_CHANGES = ["key", "n", "seen", *(f"v{i}" for i in range(DIM))]


def buckets(words: B.Words) -> np.ndarray:
    """(words, channels) rows of the embedding table."""
    out = np.empty((len(words.start), len(CHANNELS)), np.int32)
    for i, (longest, last, bits) in enumerate(CHANNELS):
        out[:, i] = (words.hashes(longest, last) >> np.uint64(64 - bits)).astype(np.int32) + _BASES[i]
    return out


def _tokens(column, size: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of a column of texts, and where each text begins; worked out in small blocks."""
    parts, bounds = [np.zeros((0, len(CHANNELS)), np.int32)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in B.blocks(column, size):
        words = B.words_of(data, offsets, _MARKS)
        parts.append(buckets(words))
        bounds.append(words.bounds[1:] + bounds[-1][-1])
    return np.concatenate(parts), np.concatenate(bounds)


def _by_text(values: np.ndarray, bounds: np.ndarray, how, empty: float = 0.0) -> np.ndarray:
    """`how`.reduceat over the rows of each text; texts without rows get `empty`."""
    out = np.full((len(bounds) - 1, values.shape[1]), empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = how.reduceat(values, bounds[:-1][full], axis=0)
    return out


@dataclass
class Model:
    fixed: float | None = None
    table: np.ndarray | None = None  # per bucket: the filters' responses, one column for each place of each filter
    filter_bias: np.ndarray | None = None
    out: np.ndarray | None = None
    bias: float = 0.0
    languages: list[str] = field(default_factory=list)
    starts: np.ndarray | None = None  # per bucket of the first bytes: log probability by language
    shift: np.ndarray | None = None  # by language

    def responses(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Pooled filters of each text."""
        rows = self.table[tokens[:, 0]]
        for channel in range(1, tokens.shape[1]):
            rows += self.table[tokens[:, channel]]
        pooled, column = [], 0
        for width, n in FILTERS.items():
            sums = rows[:, column : column + n].copy()
            for place in range(1, width):
                sums[:-place] += rows[place:, column + place * n : column + (place + 1) * n]
            for back in range(1, width):  # places where the filter would leave its text
                ends = bounds[1:][np.diff(bounds) >= back] - back
                sums[ends] = -np.inf
            pooled.append(_by_text(sums, bounds, np.maximum, -np.inf))
            column += width * n
        return np.maximum(np.concatenate(pooled, axis=1) + self.filter_bias, 0)

    def logits(self, tokens, bounds) -> np.ndarray:
        return self.responses(tokens, bounds).astype(np.float64) @ self.out + self.bias

    def language(self, tokens, bounds) -> np.ndarray:
        return _by_text(self.starts[tokens[:, STARTS] - _BASES[STARTS]], bounds, np.add).argmax(axis=1)

    def scores(self, tokens, bounds) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(bounds) - 1, self.fixed)
        return _sigmoid(self.logits(tokens, bounds) - self.shift[self.language(tokens, bounds)])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# ------------------------------------------------------------------ training

def _held(tokens, bounds, labels) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket: how many texts hold it, and how many toxic ones."""
    doc = np.repeat(np.arange(len(labels)), np.diff(bounds))
    pairs = np.unique(doc[:, None] * _SIZE + tokens)
    bucket = pairs % _SIZE
    return np.bincount(bucket, minlength=_SIZE), np.bincount(bucket, labels[pairs // _SIZE], _SIZE).astype(np.int64)


def _log_odds(held, toxic, rate, shrink=10.0) -> np.ndarray:
    """Per bucket: how much likelier a text that holds it is toxic; rare buckets stay near 0."""
    share = (toxic + shrink * rate) / (held + shrink)
    return np.log(share / (1 - share)) - np.log(rate / (1 - rate))


def _picked(tokens, bounds, rows):
    """Tokens and bounds of some of the texts."""
    sizes = np.diff(bounds)[rows]
    at = np.repeat(bounds[:-1][rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return tokens[at], np.concatenate([[0], np.cumsum(sizes)])


class _Trainer:
    """Embeddings and filters as they are trained, before they are multiplied out."""

    def __init__(self, tokens, bounds, labels, rng):
        self._start(*_held(tokens, bounds, labels), labels.mean(), rng)

    @classmethod
    def of_counts(cls, held, toxic, rate, rng) -> _Trainer:
        net = cls.__new__(cls)
        net._start(held, toxic, rate, rng)
        return net

    def _start(self, held, toxic, rate, rng):
        self.embed = rng.normal(0, 0.05, (_SIZE, DIM)).astype(np.float32)
        self.embed[:, 0] = _log_odds(held, toxic, rate) / len(CHANNELS)
        self.filters = {w: rng.normal(0, 0.1, (w, DIM, n)).astype(np.float32) for w, n in FILTERS.items()}
        for w, f in self.filters.items():
            f[:, 0, :] += 1 / w
        total = sum(FILTERS.values())
        self.filter_bias, self.out = np.zeros(total, np.float32), np.full(total, 1 / total, np.float32)
        self.bias = np.array([np.log(rate / (1 - rate))], np.float32)
        self.seen = {k: np.full_like(getattr(self, k), 1e-3) for k in ("filter_bias", "out", "bias")}
        self.seen["embed"] = np.full(_SIZE, 1e-3, np.float32)
        self.seen_filters = {w: np.full_like(f, 1e-3) for w, f in self.filters.items()}
        self.moved = np.zeros(_SIZE, np.int32)  # batches that moved a bucket

    def _small(self) -> list[np.ndarray]:
        """All weights but the embeddings."""
        return [*self.filters.values(), self.filter_bias, self.out, self.bias, *self.seen_filters.values(),
                *(self.seen[k] for k in ("filter_bias", "out", "bias"))]

    def changes(self, before: _Trainer, n: int) -> pa.RecordBatch:
        """What n texts changed, times its weight: rows of moved buckets, then all other weights in rows of the same width."""
        key = np.flatnonzero(self.moved)
        small = np.concatenate([(a - b).ravel() for a, b in zip(self._small(), before._small())])
        small = np.pad(small, (0, -len(small) % DIM)).reshape(-1, DIM)
        values = np.concatenate([self.embed[key] - before.embed[key], small]).astype(np.float64)
        seen = np.concatenate([self.seen["embed"][key] - before.seen["embed"][key], np.zeros(len(small))]).astype(np.float64)
        weight = np.concatenate([self.moved[key], np.full(len(small), n)]).astype(np.int64)
        whole = lambda x: pa.array(np.rint(x * weight * _UNIT).astype(np.int64))
        key = np.concatenate([key, _SIZE + np.arange(len(small))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(weight), whole(seen), *map(whole, values.T)], names=_CHANGES)

    def add(self, key, seen, values):
        """Averaged changes, as rows of `changes`."""
        order = np.argsort(key)
        key, seen, values = key[order], seen[order], values[order]
        big = key < _SIZE
        self.embed[key[big]] += values[big]
        self.seen["embed"][key[big]] += seen[big]
        small, at = values[~big].ravel(), 0
        for part in self._small():
            part += small[at : at + part.size].reshape(part.shape)
            at += part.size

    def step(self, tokens, bounds, labels, rate=0.05):
        """One batch; only the word that won a filter in a text gets a gradient from it."""
        x = self.embed[tokens[:, 0]]
        for channel in range(1, tokens.shape[1]):
            x += self.embed[tokens[:, channel]]
        n, wins, pooled = len(labels), {}, []
        for w, f in self.filters.items():
            best = np.full((n, f.shape[2]), -np.inf, np.float32)
            place = np.zeros((n, f.shape[2]), np.int64)
            parts = [x @ f[j] for j in range(w)]
            for i in range(n):
                a, b = bounds[i], bounds[i + 1]
                if b - a >= w:
                    r = parts[0][a : b - w + 1].copy()
                    for j in range(1, w):
                        r += parts[j][a + j : b - w + 1 + j]
                    top = r.argmax(axis=0)
                    place[i], best[i] = a + top, r[top, np.arange(r.shape[1])]
            wins[w] = place
            pooled.append(best)
        raw = np.concatenate(pooled, axis=1) + self.filter_bias
        act = np.maximum(raw, 0)
        off = (_sigmoid(act @ self.out + self.bias) - labels).astype(np.float32) / n
        back = off[:, None] * self.out[None, :] * (raw > 0)
        grads = {"out": act.T @ off, "filter_bias": back.sum(axis=0)}
        rows, moves, column = [], [], 0
        for w, f in self.filters.items():
            g = back[:, column : column + f.shape[2]]
            column += f.shape[2]
            i, k = np.nonzero(g)
            at, change = wins[w][i, k], np.zeros_like(f)
            for j in range(w):
                np.add.at(change[j].T, k, g[i, k][:, None] * x[at + j])
                rows.append(tokens[at + j])
                moves.append(np.repeat((g[i, k][:, None] * f[j][:, k].T)[:, None, :], len(CHANNELS), axis=1))
            self.seen_filters[w] += change**2
            f -= rate * change / np.sqrt(self.seen_filters[w])
        for name, g in grads.items():
            self.seen[name] += g**2
            getattr(self, name)[...] -= rate * g / np.sqrt(self.seen[name])
        self.seen["bias"] += off.sum() ** 2
        self.bias -= rate * off.sum() / np.sqrt(self.seen["bias"])
        if rows:
            row, back_to = np.unique(np.concatenate(rows).ravel(), return_inverse=True)
            move = np.zeros((len(row), DIM), np.float32)
            np.add.at(move, back_to, np.concatenate(moves).reshape(-1, DIM))
            self.seen["embed"][row] += (move**2).mean(axis=1)
            self.embed[row] -= rate * move / np.sqrt(self.seen["embed"][row])[:, None]
            self.moved[row] += 1

    def model(self) -> Model:
        columns = [self.embed @ f[j] for f in self.filters.values() for j in range(f.shape[0])]
        return Model(table=np.ascontiguousarray(np.concatenate(columns, axis=1)), filter_bias=self.filter_bias,
                     out=self.out.astype(np.float64), bias=float(self.bias[0]))


def _cut(low, high, toxic, others, care: float = 3.0) -> float:
    """The middle of the best gap between ascending steps: most toxic texts above, few others; a wrong rejection weighs `care` times.

    `low` and `high` are the least and largest logit of a step. Of equally good gaps the highest.
    """
    gain = np.concatenate([[0], np.cumsum(care * others / others.sum() - toxic / toxic.sum())])
    best = np.flatnonzero(gain >= gain.max() - 1e-9)[-1]
    below, above = np.concatenate([[low[0] - 1], high]), np.concatenate([low, [high[-1] + 1]])
    return float((below[best] + above[best]) / 2)


def _threshold(logits: np.ndarray, labels: np.ndarray, care: float = 3.0) -> float:
    """`_cut` where every logit is a step."""
    order = np.argsort(logits)
    z, y = logits[order], labels[order] == 1
    return _cut(z, z, y.astype(float), (~y).astype(float), care)


def _counted(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all rows: texts of training that hold a bucket, toxic ones of them; words by start bucket and language."""

    where = {g: i for i, g in enumerate(names)}

    def run(batches):
        held, toxic, starts = np.zeros(_SIZE, np.int64), np.zeros(_SIZE, np.int64), {}

        def out(group, n, of):
            at = np.flatnonzero(n).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([group] * len(at), pa.int32()), pa.array(at), pa.array(n[at]), pa.array(of[at])], names=["lang", "bucket", "n", "toxic"])

        for batch in batches:
            labels, train = batch.column("toxic").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            langs = np.array([where.get(g, -1) for g in batch.column("lang").to_pylist()])
            for first, last, data, offsets in B.blocks(batch.column("text"), 1 << 19):
                words = B.words_of(data, offsets, _MARKS)
                tokens, own = buckets(words), np.flatnonzero(train[first:last])
                for total, more in zip((held, toxic), _held(*_picked(tokens, words.bounds, own), labels[first:last][own])):
                    total += more
                lang = langs[first:last][words.doc]
                for g in np.unique(lang[lang >= 0]):
                    n = np.bincount(tokens[lang == g, STARTS] - _BASES[STARTS], minlength=1 << CHANNELS[STARTS][2])
                    starts[g] = starts.get(g, 0) + n
                if len(starts) > 64:  # many languages: what is held stays small
                    yield from (out(int(g), n, np.zeros_like(n)) for g, n in starts.items())
                    starts = {}
        yield from (out(int(g), n, np.zeros_like(n)) for g, n in starts.items())
        yield out(-1, held, toxic)

    counts = rows.mapInArrow(run, "lang int, bucket int, n long, toxic long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    lang, bucket, n, of = (counts.column(c).to_numpy() for c in counts.column_names)
    held, toxic = np.zeros(_SIZE, np.int64), np.zeros(_SIZE, np.int64)
    starts = np.full((1 << CHANNELS[STARTS][2], len(names)), 0.01)
    held[bucket[lang < 0]], toxic[bucket[lang < 0]] = n[lang < 0], of[lang < 0]
    starts[bucket[lang >= 0], lang[lang >= 0]] += n[lang >= 0]
    return held, toxic, starts


def _trained(rows: DataFrame, net: _Trainer, number: int, seed: int) -> None:
    """One round: every task trains on its rows from the same weights, the averaged changes are added to them."""
    start = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        own, n = copy.deepcopy(start.value), 0
        rng = np.random.default_rng([seed, number, TaskContext.get().partitionId()])
        for batch in batches:
            labels = batch.column("toxic").to_numpy().astype(np.float32)
            for first, last, data, offsets in B.blocks(batch.column("text")):
                words = B.words_of(data, offsets, _MARKS)
                tokens = buckets(words)
                for some in np.array_split(rng.permutation(last - first), max(1, (last - first) // BATCH)):
                    own.step(*_picked(tokens, words.bounds, some), labels[first:last][some])
                n += last - first
        if n:
            yield own.changes(start.value, n)

    changes = rows.select("text", "toxic").mapInArrow(run, ", ".join(f"{c} {'int' if c == 'key' else 'long'}" for c in _CHANGES))
    sums = changes.groupBy("key").agg(*(F.sum(c).alias(c) for c in _CHANGES[1:]))
    mean = sums.select("key", *((F.col(c) / (F.col("n") * F.lit(_UNIT))).cast("float").alias(c) for c in _CHANGES[2:])).toArrow()
    net.add(mean.column(0).to_numpy(), mean.column(1).to_numpy(), np.stack([mean.column(c).to_numpy() for c in _CHANGES[3:]], axis=1))
    start.destroy()


def _calibrated(rows: DataFrame, model: Model) -> np.ndarray:
    """By language, the logit that parts toxic texts best; where a class has under 10 texts of a language, that of all languages."""

    def run(batches):
        for batch in batches:
            labels = batch.column("toxic").to_numpy()
            for first, last, data, offsets in B.blocks(batch.column("text")):
                words = B.words_of(data, offsets, _MARKS)
                tokens = buckets(words)
                logits = model.logits(tokens, words.bounds)
                columns = model.language(tokens, words.bounds).astype(np.int32), np.floor(logits * STEPS).astype(np.int64), labels[first:last], logits
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "step", "toxic", "logit"])

    looks = rows.select("text", "toxic").mapInArrow(run, "lang int, step long, toxic int, logit double")
    is_toxic = F.col("toxic") == 1
    steps = looks.groupBy("lang", "step").agg(
        F.count_if(is_toxic).alias("toxic"), F.count_if(~is_toxic).alias("others"), F.min("logit").alias("low"), F.max("logit").alias("high")).toArrow()
    lang, step, toxic, others, low, high = (steps.column(c).to_numpy() for c in steps.column_names)
    order = np.lexsort((lang, step))
    lang, step, toxic, others, low, high = (x[order] for x in (lang, step, toxic, others, low, high))
    first = np.flatnonzero(np.diff(step, prepend=step[0] - 1))
    common = _cut(np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.add.reduceat(toxic, first), np.add.reduceat(others, first))
    shift = np.full(len(model.languages), common)
    for g in np.unique(lang):
        own = lang == g
        if min(toxic[own].sum(), others[own].sum()) >= 10:
            shift[g] = _cut(low[own], high[own], toxic[own], others[own])
    return shift


def _labelled(docs: DataFrame, known: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows of docs(doc_id, ...) that known(doc_id, toxic) has, one for an id, with their label; as a join by id gives them.

    An id belongs to one of 2 ** slots slots. Where all ids that docs has in a slot have the same label, a bit says so, and their rows get it in
    the task that reads them. Rows of slots that several labels, or a label and none, share are joined by id.
    """
    docs, columns = docs.filter("doc_id is not null"), docs.columns
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << slots))
    word, at = F.shiftright(slot, 6), (slot % 64).cast("int")
    some = lambda which: F.coalesce(F.bit_or(F.when(which, F.call_function("shiftleft", F.lit(1).cast("long"), at))), F.lit(0))
    ids, toxic = docs.select("doc_id").join(known, "doc_id", "left"), F.col("toxic")
    words = ids.groupBy(word.alias("_word")).agg(some(toxic.isNull()).alias("none"), some(toxic == 0).alias("other"), some(toxic == 1).alias("toxic"))
    words = words.filter("(other | toxic) != 0").withColumn("sure", F.expr("(other ^ toxic) & ~none"))
    words = settle(words.select("_word", "sure", "toxic", F.expr("(other | toxic) & ~sure").alias("shared")))
    docs = docs.withColumn("_word", word)
    of = lambda name: docs.join(F.broadcast(words.filter(F.col(name) != 0)), "_word").filter(F.bit_get(name, at) == 1)
    return of("sure").select(*columns, F.bit_get("toxic", at).cast("int").alias("toxic")).unionByName(of("shared").select(*columns).join(known, "doc_id"))


def learned(docs: DataFrame, labels: DataFrame, usable: Column | None = None, seed: int = 7) -> Model:
    """A model from all labels(doc_id, toxic) of docs(doc_id, text, lang); `usable` says which rows may be learned from."""
    known = labels.filter("toxic is not null and doc_id is not null")
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("doc_id").agg((F.max("toxic").cast("int") == 1).cast("int").alias("toxic"))
    own = docs.select("doc_id", F.lower(text_of()).alias("text"), "lang")
    rows = _labelled(own, known).select("text", "lang", "toxic", (uniform(F.col("doc_id"), F.lit(seed)) < 0.2).alias("aside"))
    rows = settle(rows)
    sums = F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")
    parts = {r["aside"]: (r["n"], r["toxic"], r["size"]) for r in rows.groupBy("aside").agg(*sums).collect()}
    nothing = (0, 0, 0)
    n, n_toxic, size = (sum(x) for x in zip(nothing, *parts.values()))
    if n_toxic in (0, n):
        return Model(fixed=float(n_toxic > 0))
    least = {side: min(t, all_ - t) for side, (all_, t, _) in parts.items()}
    train = F.lit(True) if not least.get(False) else ~F.col("aside")
    sure = F.col("aside") if least.get(True, 0) >= 10 else F.lit(True)
    n_train, train_toxic, _ = parts[False] if least.get(False) else (n, n_toxic, size)

    langs = rows.filter("lang is not null").groupBy("lang").count().collect()
    names = [r["lang"] for r in sorted(langs, key=lambda r: (-r["count"], r["lang"]))] or [""]
    held, toxic, starts = _counted(rows.withColumn("train", train), names)
    rng = np.random.default_rng(seed)
    net = _Trainer.of_counts(held, toxic, train_toxic / n_train, rng)
    dealt = rows.filter(train).coalesce(max(1, n // TEXTS, size // BYTES))
    for number in range(min(MOST, max(LEAST, SHOWN // n_train))):
        _trained(dealt, net, number, seed)
    model = net.model()
    model.languages = [str(x) for x in names]
    model.starts = np.log(starts / starts.sum(axis=0)).astype(np.float32)
    model.shift = _calibrated(rows.filter(sure), model)
    pa.default_memory_pool().release_unused()
    return model


# ------------------------------------------------------------------ scoring

def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 in column `name`."""
    own = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)), F.lower(text_of()).alias("_low"))
    keep = [f"_{i}" for i in range(len(docs.columns))]

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in B.blocks(batch.column("_low")):
                words = B.words_of(data, offsets, _MARKS)
                scores.append(model.scores(buckets(words), words.bounds))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(scores))], names=[*keep, "_score"])

    kinds = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(keep, docs.schema))
    return own.mapInArrow(run, f"{kinds}, _score double").toDF(*docs.columns, name)
