"""Language of a text in two steps: first the family, then the language inside it.

Features are hashed runs of two, three and four bytes of the lower-cased text, everything but letters
folded to single spaces, as shares of the whole text. Linear support vector machines (squared
hinge, trained in numpy) tell the families apart, one against the rest; inside a family one machine
for each pair of languages votes. A text's margins are sums of table rows over its bytes, so a
whole batch is scored with a few numpy passes.

Every language that occurs is learned. The sample is bounded: about `per_language` texts of each, fewer where that makes more than
`most` in all (but `LEAST` of each), of up to `longest` characters; of a text only its shares, 12 kB, reach
the driver. Prediction reads every text whole.

Cases: a null text and one without a letter are `und` with score 0; so is every text when nothing
could be learned; with one language learned, all others are that language with score 1; rows with a
null language are not learned from; repeated rows are predicted alike; columns of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bytewise as B
from .common import text_of, uniform

#: Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi lb fy".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky".split(),
    "indic": "hi bn ur pa gu mr ne si".split(),
    "semitic": "ar he mt".split(),
}
RUNS, BITS = (2, 3, 4), 11
SIZE = len(RUNS) << BITS
PER_LANGUAGE, LONGEST, MOST, LEAST = 800, 200_000, 6400, 20
_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def family(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, langs in FAMILIES.items() if base in langs), lang)


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with runs of non-letters as one space; each text begins and ends with a space."""
    low, n = int(offsets[0]), len(offsets) - 1
    body = _FOLD[data[low : int(offsets[-1])]]
    at = np.arange(len(body)) + np.repeat(2 * np.arange(n), np.diff(offsets)) + 1
    out = np.full(len(body) + 2 * n, 32, np.uint8)
    out[at] = body
    starts = offsets - low + 2 * np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[starts[:-1]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def features(data: np.ndarray, offsets: np.ndarray):
    """For each run length: the bucket at every byte where the run stays inside its text, and the text."""
    body, starts = _folded(data, offsets)
    wide = body.astype(np.uint32)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = wide
    for k in range(2, RUNS[-1] + 1):
        key = (key[:-1] << np.uint32(8)) | wide[k - 1 :]
        if k in RUNS:
            inside = doc[: len(key)] == doc[k - 1 :]
            bucket = ((key[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32) + (RUNS.index(k) << BITS)
            yield bucket, doc[: len(key)][inside]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    table: np.ndarray | None = None  # (buckets, machines): families first, then pairs
    bias: np.ndarray | None = None

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, self.table.shape[1]))
        runs = np.zeros(len(offsets) - 1)
        for bucket, doc in features(data, offsets):
            if len(bucket):
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                out[doc[first]] += np.add.reduceat(self.table[bucket], first, axis=0)
                runs[doc[first]] += np.diff(np.append(first, len(doc)))
        return out / np.maximum(runs, 1)[:, None] + self.bias

    def predicted(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text, and a score from 0 to 1."""
        n = len(offsets) - 1
        if len(self.languages) == 1:
            return np.zeros(n, int), np.ones(n)
        m, of = self.margins(data, offsets), np.array([self.families.index(family(g)) for g in self.languages])
        rank = m[:, : len(self.families)] if len(self.families) > 1 else np.zeros((n, 1))
        chosen = rank.argmax(axis=1)
        score = _sigmoid(2 * rank[np.arange(n), chosen]) if len(self.families) > 1 else np.ones(n)
        votes, least = np.zeros((n, len(self.languages))), np.full((n, len(self.languages)), np.inf)
        for i, (a, b) in enumerate(self.pairs):
            x = m[:, len(self.families) + i]
            for g, y in ((a, x), (b, -x)):
                votes[:, g] += (y > 0) + 1e-3 * np.tanh(y)
                least[:, g] = np.minimum(least[:, g], y)
        best = np.where(of[None, :] == chosen[:, None], votes, -np.inf).argmax(axis=1)
        inner = least[np.arange(n), best]
        return best, score * np.where(np.isfinite(inner), _sigmoid(2 * inner), 1.0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def machine(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine for y of -1 and 1; both sides weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b, ahead, ahead_b, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 1.0
    rate = 0.5 / (float((weight * (x**2).sum(axis=1)).sum()) + 1 + decay)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead + ahead_b)).astype(np.float32) * weight * y
        new, new_b = ahead + rate * (2 * (slack @ x) - decay * ahead), ahead_b + rate * 2 * float(slack.sum())
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / nxt * (new - w), new_b + (t - 1) / nxt * (new_b - b)
        w, b, t = new, new_b, nxt
    return w, b


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """A model from (texts, buckets) shares, which are changed in place, and the language of each."""
    model = Model(languages=sorted(set(langs)))
    if len(model.languages) < 2:
        return model
    number = np.array([model.languages.index(g) for g in langs])
    model.families = sorted({family(g) for g in model.languages})
    of = np.array([model.families.index(family(g)) for g in model.languages])
    mean, spread = x.mean(axis=0), np.sqrt(x.var(axis=0).mean()) + 1e-9
    x -= mean
    x /= spread * np.sqrt(x.shape[1])
    found = []
    for f in range(len(model.families)):
        found.append(machine(x, np.where(of[number] == f, 1, -1).astype(np.float32)) if len(model.families) > 1 else (np.zeros(x.shape[1], np.float32), 0.0))
    for a, b in combinations(range(len(model.languages)), 2):
        if of[a] == of[b]:
            rows = (number == a) | (number == b)
            model.pairs.append((a, b))
            found.append(machine(x[rows], np.where(number[rows] == a, 1, -1).astype(np.float32)))
    scale = 1 / (spread * np.sqrt(x.shape[1]))
    model.table = np.stack([w * scale for w, _ in found], axis=1).astype(np.float32)
    model.bias = np.array([b - float(mean @ w) * scale for w, b in found])
    return model


def _shares(batches):
    for batch in batches:
        for first, last, data, offsets in B.blocks(batch.column("text")):
            counts = np.zeros((last - first, SIZE), np.float32)
            for bucket, doc in features(data, offsets):
                np.add.at(counts, (doc, bucket), 1)
            counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1) / 1024
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(first, last - first), pa.array([r.tobytes() for r in counts.astype(np.float16)], pa.binary())],
                names=["lang", "shares"])


def learned(docs: DataFrame, usable: Column | None = None, per_language: int = PER_LANGUAGE, longest: int = LONGEST, most: int = MOST) -> Model:
    """A model from docs(doc_id, text, lang); `usable` says which rows may be learned from."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= longest))
    if usable is not None:
        known = known.filter(usable)
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return Model()
    each = min(per_language, max(most // len(counts), LEAST))
    shares = F.create_map(*(F.lit(x) for row in counts for x in (row["lang"], min(1.0, each / row["n"]))))
    rows = known.filter(uniform(F.col("doc_id"), F.col("text")) < F.element_at(shares, F.col("lang"))).select("lang", F.lower("text").alias("text"))
    # In one order whatever task a row came from; the sample is small, so the driver sorts it.
    rows = rows.mapInArrow(_shares, "lang string, shares binary").toArrow().sort_by([("lang", "ascending"), ("shares", "ascending")])
    x = np.empty((len(rows), SIZE), np.float32)
    for i, v in enumerate(rows.column("shares")):
        x[i] = np.frombuffer(v.as_buffer(), np.float16)
    langs = rows.column("lang").to_pylist()
    del rows
    x /= 1024
    return fit(x, langs)


def predicted(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the predicted language and a score from 0 to 1."""
    lettered = text_of().rlike(r"\p{L}")
    keep = [f"_{i}" for i in range(len(docs.columns))]
    own = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(keep, docs.columns)),
                      F.lower(text_of()).alias("_low"), lettered.alias("_lettered"))

    def run(batches):
        for batch in batches:
            langs, scores = [np.zeros(0, int)], [np.zeros(0)]
            for _, _, data, offsets in B.blocks(batch.column("_low")):
                g, s = model.predicted(data, offsets) if model.languages else (np.zeros(len(offsets) - 1, int), np.zeros(len(offsets) - 1))
                langs.append(g)
                scores.append(s)
            some = batch.column("_lettered").to_numpy(zero_copy_only=False) & bool(model.languages)
            named = np.where(some, np.array(model.languages or ["und"], object)[np.concatenate(langs)], "und")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(named, pa.string()), pa.array(np.where(some, np.concatenate(scores), 0.0))],
                names=[*keep, "_lang", "_score"])

    kinds = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(keep, docs.schema))
    return own.mapInArrow(run, f"{kinds}, _lang string, _score double").toDF(*docs.columns, *names)
