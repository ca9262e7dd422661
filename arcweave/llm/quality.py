"""Quality classifier learned from positive and unlabelled texts.

Trusted good texts and a sample of unlabelled web text are all that the risk is
made of: the positives' loss, weighted by the estimated share of good texts, and
the unlabelled texts' loss as if they were bad, less what the good ones among them
put into it. The latter can't be below zero; where a fit would push it there, the
step goes the other way (the non-negative estimator). With the logistic loss the
minimum is the log odds of a good text, so scores are probabilities.

A text's features are shares of the pairs of neighbouring byte classes, its length
and how much its words and lines repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import held_out

#: Trusted positives, and unlabelled texts, that a model is fitted on at most: those whose ids have the smallest hashes.
SAMPLE = 4000
#: Least score of a text that is predicted to be good.
THRESHOLD = 0.3

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\r\n", b".", b",;:", b"!", b"|", b"?", b"'\"()[]{}<>", b"@#$%^&*_=+~`\\", b"-/"]
_CLASS = np.full(256, len(_GROUPS), np.int64)  # bytes past ASCII, and control bytes, are the last class
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_N = len(_GROUPS) + 1
WIDTH = _N * _N + 7


def features(text: str | None) -> np.ndarray:
    """Of a whole text; an empty or null one has zeros but for the flag of emptiness."""
    out = np.zeros(WIDTH, np.float32)
    data = np.frombuffer((text or "").encode(), np.uint8)
    tail = out[_N * _N :]
    if not len(data):
        tail[0] = 1
        return out
    kinds = _CLASS[data]
    out[: _N * _N] = np.sqrt(np.bincount(kinds[:-1] * _N + kinds[1:], minlength=_N * _N) / len(data))
    words, lines = text.split(), text.split("\n")
    tail[1] = np.log1p(len(data))
    tail[2] = np.log1p(len(words))
    tail[3] = len(set(words)) / max(1, len(words))
    tail[4] = len(set(lines)) / len(lines)
    tail[5] = len(data) / max(1, len(words))
    tail[6] = sum(map(str.__eq__, words, words[1:])) / max(1, len(words))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Minimises the non-negative risk with Adam, in full batches. No positives: everything scores the prior."""
    both = np.concatenate([positive, unlabelled]).astype(np.float32)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), float(np.log(prior / (1 - prior))), prior)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w = np.zeros(WIDTH + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    p, u = (np.hstack([x, np.ones((len(x), 1))]).astype(np.float32) for x in (p, u))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
        bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_bad = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        as_good = prior * (p.T @ (sp - 1)) / len(p)
        grad = as_good + as_bad if bad >= 0 else -as_bad
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> float:
    """Share of good texts among the unlabelled, from these and trusted ones alone.

    The ratio of both densities is the same, one over the prior, wherever only good
    texts are. A balanced logistic model of trusted against unlabelled texts gives
    the ratio; its median over trusted texts that it wasn't fitted on is taken for
    that plateau. With fewer than 20 trusted or unlabelled texts it is a half.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    own = np.arange(len(positive)) % 5 > 0
    both = np.concatenate([positive[own], unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    a, b, u = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive[own], positive[~own], unlabelled))
    w = m = v = np.zeros(WIDTH + 1)
    for t in range(1, steps + 1):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ w, -50, 50))) - 1) / len(a) + u.T @ (1 / (1 + np.exp(-np.clip(u @ w, -50, 50)))) / len(u)
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(np.clip(1 / np.median(np.exp(np.clip(b @ w, -50, 50))), 0.01, 0.99))


def featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(x, pa.binary())], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From texts of documents that aren't held out, of which labels trusts some as good.

    A document with differing labels isn't trusted, nor one whose label is null; that
    a label is bad is used for nothing else. The class prior and the model are fitted
    on at most sample trusted and sample unlabelled texts, taken by the smallest hash
    of their ids; no label of the unlabelled is looked at. Both sides of the join with
    the texts are bounded by that.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    judged = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    by_hash = lambda ids: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    trusted = by_hash(judged.where("quality = 1").select("doc_id")).withColumn("trusted", F.lit(True))
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).select(F.col("doc_id").cast("long").alias("doc_id"))
    some = by_hash(ids.distinct()).withColumn("trusted", F.lit(False))
    wanted = trusted.unionByName(some).groupBy("doc_id").agg(F.max("trusted").alias("positive"), F.min("trusted").alias("only_positive"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")  # at most 2 * sample ids
    rows = sorted(featured(texts).join(F.broadcast(wanted), "doc_id").select("x", "positive", "only_positive").collect())  # in an order of their own
    x = lambda which: np.array([np.frombuffer(r.x, np.float32) for r in rows if which(r)], np.float32).reshape(-1, WIDTH)
    positive, unlabelled = x(lambda r: r.positive), x(lambda r: not r.only_positive)
    mixed = np.random.default_rng(1).permutation(len(positive))
    return fit(positive, unlabelled, class_prior(positive[mixed], unlabelled))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, from its whole text alone.

    Null and empty texts are scored as empty ones. Repeated rows give repeated
    rows. A null doc_id is scored, never learned from. Columns besides doc_id and
    text aren't read. Without labels every text has the same score. A narrow map, a
    very long text whole in its task; only the features of the sample that the model
    is fitted on go to the driver.
    """
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)], np.float32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted to be good, with all their columns.

    Null and empty texts are judged as empty ones; repeated rows are judged alike and
    stay repeated; a null doc_id is judged, never learned from. Of an empty table
    nothing is left. A very long text is held whole in its task.
    """
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            x = np.array([features(t.as_py()) for t in text], np.float32).reshape(-1, WIDTH)
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
