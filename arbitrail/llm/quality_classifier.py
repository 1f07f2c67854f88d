"""Quality classifier learnt from trusted positives and unlabelled text.

Positive-unlabelled learning: with class prior p, the risk of a scorer is p R+(positives) + [R-(unlabelled) - p R-(positives)],
an unbiased estimate that needs no negatives. The bracket estimates the risk on negatives and can't be below 0 in truth; where
it falls below, the step goes the other way, so that the estimate stays non-negative.

The prior is estimated from positives and unlabelled text alone (``estimate_prior``). Trusted positives are a bounded sample of at
most ``sample_rows`` labelled rows. Unlabelled is every training text: features of all are stored once, in half precision; their mean
and spread and the unlabelled risk are sums over all of them. The descent starts with ``rounds`` steps on a sample of
``sample_rows`` unlabelled texts, which only chooses where it starts, and ends with ``last_rounds`` steps on all.

Features come from the text alone, computed in numpy where the texts lie; every row is scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitrail.llm.common import Words, give_back, gram_hashes, map_batches, mix, remove_stored, stored, text_bytes, text_slices

SAMPLE_ROWS = 6000
ROUNDS, LAST_ROUNDS = 400, 10
#: Sums over all texts are added up as whole numbers of this part of one, so that their order doesn't matter.
UNIT = 2.0**-20
FOLDS = 5
THRESHOLD = 0.3
SUMMARY = ["words", "word_length", "symbols", "upper", "digits", "bangs", "repeated_words", "repeated_grams", "repeated_lines"]
N_FEATURES = len(SUMMARY) + 256


def _repeats(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's values equal another one of the text that comes before in sorted order."""
    if not len(values):
        return np.zeros(n)
    keys = mix(values ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    again = np.append(False, keys[order][1:] == keys[order][:-1])
    return np.bincount(doc[order][again], minlength=n)[:n]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text of a slice: shares and lengths, and the share of each byte. All 0 for an empty text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    of_byte = np.repeat(np.arange(n), size)
    share = np.bincount(of_byte * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    words = Words(data, offsets, False)
    doc = words.doc_of_word()
    count = np.diff(words.first)
    per_word = np.maximum(count, 1)
    h = words.hashes()
    grams = gram_hashes(h, 3)
    inside = doc[: len(grams)] == doc[2:] if len(grams) else np.zeros(0, bool)
    lines = np.bincount(of_byte[data == 10], minlength=n) + 1
    letters = share[:, 65:91].sum(1) + share[:, 97:123].sum(1)
    symbols = share[:, np.frombuffer(b"#*$%&|<>", np.uint8)].sum(1)
    columns = [
        np.log1p(count),
        np.bincount(doc, words.ends - words.starts, minlength=n)[:n] / per_word / 10,
        np.minimum(symbols / per_word, 3),
        share[:, 65:91].sum(1) / np.maximum(letters, 1),
        share[:, 48:58].sum(1) / np.maximum(size, 1),
        np.minimum(share[:, 33] / per_word, 3),
        _repeats(h, doc, n) / per_word,
        _repeats(grams[inside], doc[: len(grams)][inside], n) / per_word,
        _line_repeats(data, offsets, n) / lines,
    ]
    return np.hstack([np.stack(columns, 1), np.sqrt(share / np.maximum(size, 1)[:, None])]).astype(np.float32)


def _line_repeats(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    raw = data.tobytes()
    for i in range(n):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


@dataclass(frozen=True)
class Scale:
    """Brings features to one scale and adds how far each lies outside the range of nearly all positives."""

    mean: np.ndarray
    spread: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, positive: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> Scale:
        """mean, spread: of the features of all texts."""
        z = (positive - mean) / (spread + 1e-3)
        return cls(mean, spread + 1e-3, np.quantile(z, 0.005, axis=0), np.quantile(z, 0.995, axis=0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        return np.hstack([np.clip(z, -4, 4), np.clip(z - self.high, 0, 4), np.clip(self.low - z, 0, 4)])


@dataclass(frozen=True)
class Model:
    scale: Scale | None
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + (self.scale(x) @ self.weights if self.scale else np.zeros(len(x)))
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def negative_terms(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Sums over rows taken as negatives: the logistic loss's gradient by weights and bias, the loss, and the number of rows."""
    z = x @ w + b
    s = _sigmoid(z)
    return np.concatenate([x.T @ s, [s.sum(), np.logaddexp(0, z).sum(), len(x)]])


def risk_gradient(positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray, b: float, prior: float, decay: float = 0.0) -> np.ndarray:
    """The direction of a step, by weights and bias. unlabelled: ``negative_terms`` of all unlabelled rows."""
    mine = negative_terms(positive, w, b) / len(positive)
    others = unlabelled / unlabelled[-1]
    as_positive = mine[:-2] - np.append(positive.mean(0), 1)  # of log(1 + e^-z)
    if others[-2] - prior * mine[-2] >= 0:
        out = prior * (as_positive - mine[:-2]) + others[:-2]
    else:  # the risk on negatives can't be below 0: back
        out = prior * mine[:-2] - others[:-2]
    return out + decay * np.append(w, 0)


class Descent:
    """Adam: weights and bias after any number of steps."""

    def __init__(self, n: int, rate: float = 0.05):
        self.at, self.rate, self.steps = np.zeros(n + 1), rate, 0
        self.m, self.v = np.zeros(n + 1), np.zeros(n + 1)

    def step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        self.m, self.v = 0.9 * self.m + 0.1 * gradient, 0.999 * self.v + 0.001 * gradient**2
        self.at = self.at - self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)


def tail_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior by scores of positives and of unlabelled rows that weren't learnt from.

    The share of unlabelled rows above a threshold is at least the prior times that of positives, and about equal where hardly any
    negative scores; of all thresholds that with the least ratio, a margin for chance added (one in ten), is taken.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    above_p = 1 - np.arange(len(p)) / len(p)
    above_u = 1 - np.searchsorted(u, p) / len(u)
    chance = np.sqrt(np.log(40) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((above_u + chance) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 150) -> float | None:
    """The share of positives in unlabelled text, from scaled features of both: a scorer that tells the two samples apart, trained on
    half of the rows, scores the others, and the other way round. None with fewer than 40 rows of either."""
    if min(len(positive), len(unlabelled)) < 40:
        return None
    found = []
    for side in (0, 1):
        p, u = positive[side::2], unlabelled[side::2]
        descent = Descent(p.shape[1])
        for _ in range(rounds):
            w, b = descent.at[:-1], descent.at[-1]
            mine, others = negative_terms(p, w, b) / len(p), negative_terms(u, w, b) / len(u)
            descent.step(mine[:-2] - np.append(p.mean(0), 1) + others[:-2] + 1e-3 * np.append(w, 0))
        found.append(tail_prior(positive[1 - side :: 2] @ descent.at[:-1], unlabelled[1 - side :: 2] @ descent.at[:-1]))
    return sum(found) / 2


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether labels of this id are never learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _summed(rows: DataFrame, length: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of what ``of`` makes of the features of each batch; a number of each place and task travels."""

    def work(batches):
        total = np.zeros(length, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float16).reshape(-1, N_FEATURES).astype(np.float64)
                total += np.rint(of(x) / UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], ["place", "value"])
        give_back()

    found = rows.select("features").mapInArrow(work, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(length)
    for place, value in found:
        out[place] = value * UNIT
    return out


def _matrix(rows: list) -> np.ndarray:
    return np.array([np.frombuffer(r, np.float16) for r in sorted(bytes(r[0]) for r in rows)], np.float64).reshape(-1, N_FEATURES)


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS, default_prior: float = 0.8, rounds: int = ROUNDS, last_rounds: int = LAST_ROUNDS, decay: float = 1e-4,
) -> Model:
    """The model of ``docs``, from the positive ``labels`` outside the held-out fold.

    At most ``sample_rows`` positives, one row of an id, and as many unlabelled rows of features come to the driver; sums over all
    training texts do the rest. An id labelled both ways isn't trusted. Without trusted texts the model answers ``default_prior``, which
    is also taken where there are too few to estimate one. Null and empty texts are texts like others; rows without an id teach nothing.
    """
    ids = F.col(doc_id).cast("long")
    known = labels.select(ids.alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    good = known.where("label = 1").select("id", F.lit(True).alias("trusted")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(ids.alias("id"), text_bytes(text).alias("text")).where("id is not null").where(~held_out(F.col("id")))
    rows = rows.join(F.broadcast(good), "id", "left").select("id", F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")

    def work(batch):
        for a, b, data, offsets in text_slices(batch.column(2)):
            values = pa.array([x.tobytes() for x in features(data, offsets).astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), values], ["id", "trusted", "features"])

    every = stored(map_batches(rows, work, "id long, trusted boolean, features binary"), "features")
    positive = _matrix(every.where("trusted").groupBy("id").agg(F.min("features")).select("min(features)").collect())
    # another order than that of the positives, so that the two samples are independent
    some = _matrix(every.orderBy(F.xxhash64(F.lit("unlabelled"), "id"), "id", "features").limit(sample_rows).select("features").collect())
    if not len(positive):
        remove_stored(every)
        return Model(None, np.zeros(0), float(np.log(default_prior / (1 - default_prior))), default_prior)
    sums = _summed(every, 2 * N_FEATURES + 1, lambda x: np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]]))
    mean, square = (sums[:-1] / sums[-1]).reshape(2, -1)
    scale = Scale.of(positive, mean, np.sqrt(np.maximum(square - mean * mean, 0)))
    p, u = scale(positive), scale(some)
    prior = estimate_prior(p, u) or default_prior
    descent = Descent(p.shape[1])
    for _ in range(rounds):
        w, b = descent.at[:-1], descent.at[-1]
        descent.step(risk_gradient(p, negative_terms(u, w, b), w, b, prior, decay))
    descent.rate /= 5
    for _ in range(last_rounds):
        w, b = descent.at[:-1], descent.at[-1]
        all_terms = _summed(every, len(w) + 3, lambda x, w=w, b=b: negative_terms(scale(x), w, b))
        descent.step(risk_gradient(p, all_terms, w, b, prior, decay))
    remove_stored(every)
    return Model(scale, descent.at[:-1], float(descent.at[-1]), prior)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``. Null and empty texts are scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        for a, b, data, offsets in text_slices(batch.column(2)):
            values = shared.value.score(features(data, offsets))
            predicted = pa.array((values >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(values.astype(np.float64)), predicted], ["doc_id", "held_out", "score", "predicted"])

    ids = F.col(doc_id).cast("long")
    return map_batches(docs.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), text_bytes(text).alias("text")), work, "doc_id long, held_out boolean, score double, predicted int")
