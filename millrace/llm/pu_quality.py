"""Quality classifier learned from trusted positives and unlabelled text (PU learning)."""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import as_bytes, written
from millrace.llm.quality_rules import STOP_WORDS

FOLDS = 5
#: Bounds of the training sample: trusted positives and unlabelled documents.
MAX_POSITIVE, MAX_UNLABELLED = 15_000, 30_000
THRESHOLD = 0.3
_STOPS = frozenset(w.encode() for text in STOP_WORDS.values() for w in text.split())
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>~^_={}[]\\@+`"
_STOPPERS = b".,;:?!\"'()-/"
NAMES = ("words", "word_size", "upper", "digits", "symbols", "stoppers", "exclamations", "stop_words",
         "distinct", "stutter", "repeated_lines", "line_size")


def _share(data: bytes, signs: bytes) -> int:
    return len(data) - len(data.translate(None, signs))


def features(text: bytes | None) -> list[float]:
    """Shape and repetition measures of a whole text; zeros for a null or empty one.

    Signs of junk level off, since a little of it tells as much as a lot.
    """
    data = text or b""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    letters = max(1, _share(data, _LETTERS))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    lower = data.lower().split()
    return [
        math.log1p(n) / 5,
        min(3.0, sum(map(len, words)) / n / 10),
        math.tanh(3 * _share(data, _UPPER) / letters),
        min(1.0, _share(data, _DIGITS) / n),
        math.tanh(3 * _share(data, _SYMBOLS) / n),
        min(2.0, _share(data, _STOPPERS) / n),
        math.tanh(3 * data.count(b"!") / n),
        sum(map(_STOPS.__contains__, lower)) / n,
        min(1.0, len(set(lower)) / n ** 0.8),
        math.tanh(3 * sum(map(operator.eq, lower, lower[1:])) / n),
        1 - len(set(lines)) / len(lines),
        min(3.0, math.log1p(n / len(lines)) / 3),
    ]


def _expand(x: np.ndarray) -> np.ndarray:
    """Each measure and its square root, so that small shares of junk are seen as well."""
    return np.concatenate([x, np.sqrt(x)], axis=1)


@dataclass
class Model:
    """``weights`` of standardised features; None if there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_expand(x) - self.mean) / self.scale, -6, 6)
        return z @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _slope(z: np.ndarray) -> np.ndarray:
    return -1 / (1 + np.exp(np.clip(z, -30, 30)))


def risks(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk of the positive class, unbiased estimate of that of the negative class, and the gradient of each."""
    zp, zu = p @ w, u @ w
    positive = prior * _loss(zp).mean()
    negative = _loss(-zu).mean() - prior * _loss(-zp).mean()
    grad_pos = prior * (p.T @ _slope(zp)) / len(p)
    grad_neg = -(u.T @ _slope(-zu)) / len(u) + prior * (p.T @ _slope(-zp)) / len(p)
    return positive, negative, grad_pos, grad_neg


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600,
             rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk with the logistic loss.

    The risk of the negative class is estimated as the risk of unlabelled rows
    called negative less ``prior`` times that of positives called negative.
    Where that estimate falls below zero, the step goes the other way for it,
    so that the model does not fit noise. Full-batch Adam; deterministic.
    """
    p = np.concatenate([positive, np.ones((len(positive), 1))], axis=1)
    u = np.concatenate([unlabelled, np.ones((len(unlabelled), 1))], axis=1)
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        _, negative, grad_pos, grad_neg = risks(w, p, u, prior)
        grad = (grad_pos + grad_neg if negative >= 0 else -grad_neg) + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        w = w - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from scores of both (best-bin estimate).

    Above any threshold the share of unlabelled rows is at least the prior times
    that of positives; the tightest of these bounds, with a margin for the
    sample sizes, is taken.
    """
    cuts = np.unique(np.quantile(positive, np.linspace(0.0, 0.9, 91)))
    q_p = np.array([(positive >= c).mean() for c in cuts])
    q_u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = math.sqrt(math.log(4 / confidence) / 2 / len(unlabelled)) \
        + math.sqrt(math.log(4 / confidence) / 2 / len(positive))
    best = int(np.argmin((q_u + margin) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> Model:
    """Fit on raw features: rank with a rough prior, estimate the prior on rows left out, fit again.

    The prior is the median over several halvings, which steadies it on small samples.
    """
    width = 2 * len(NAMES)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), None, 0.5)
    whole = np.concatenate([_expand(positive), _expand(unlabelled)])
    mean, scale = whole.mean(axis=0), whole.std(axis=0) + 1e-3
    p, u = (np.clip((_expand(x) - mean) / scale, -6, 6) for x in (positive, unlabelled))
    priors = []
    if min(len(p), len(u)) >= 20:
        rng = np.random.default_rng(seed)
        for _ in range(4):
            in_p, in_u = rng.random(len(p)) < 0.5, rng.random(len(u)) < 0.5
            for half_p, half_u in ((in_p, in_u), (~in_p, ~in_u)):
                rough = fit_nnpu(p[half_p], u[half_u], 0.5, steps=100)
                priors.append(estimate_prior(p[~half_p] @ rough[:-1], u[~half_u] @ rough[:-1]))
    prior = float(np.median(priors)) if priors else 0.5
    return Model(mean, scale, fit_nnpu(p, u, prior), prior)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def _share_of_hash(key: Column, share: float, seed: int) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def learn(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit the classifier on a bounded sample.

    Trusted positives are documents outside the held-out fold whose labels are
    all 1. The unlabelled set is drawn from all documents outside it, whatever
    ``labels`` says of them, so that it holds the same mixture however many are
    labelled; a document may be in both. Both are thinned by a hash of their id
    to about ``max_positive`` and ``max_unlabelled`` rows, whose features alone
    reach the driver. Documents and labels without an id take no part; null
    texts count as empty; rows that repeat an id count each.
    """
    good = labels.select(F.col("doc_id"), F.col("quality")).where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    n_good, n_docs = good.count(), docs.count()
    picked = written(good.where(_share_of_hash(F.col("doc_id"), max_positive / max(1, n_good), 11)).withColumn(
        "trusted", F.lit(True)), "quality-positives")
    if picked.count() <= 2 * max_positive:  # as the thinning makes sure but for odds; texts then stay where they are
        picked = F.broadcast(picked)
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = _share_of_hash(F.col("doc_id"), max_unlabelled / max(1, n_docs), 13)
    sample = texts.join(picked, "doc_id", "left").where(F.col("trusted") | drawn).select(
        "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), drawn.alias("drawn"))

    def measure(batches):
        for batch in batches:
            rows = [np.array(features(t), "<f8").tobytes() for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.binary())],
                                             names=["trusted", "drawn", "x"])

    rows = sample.mapInArrow(measure, "trusted boolean, drawn boolean, x binary").collect()

    def matrix(kind: str) -> np.ndarray:
        kept = sorted(bytes(r["x"]) for r in rows if r[kind])
        return np.frombuffer(b"".join(kept), "<f8").reshape(-1, len(NAMES))

    return fit(matrix("trusted"), matrix("drawn"))


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key, held_out, score and predicted of every row; whole texts, no shuffle.

    A null or empty text has all-zero features and the score the model gives
    those. Repeated rows are scored each on its own; other columns are ignored.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def batches(rows):
        for batch in rows:
            x = np.array([features(t) for t in as_bytes(batch.column(1))]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())],
                                             names=["doc_id", "score"])

    scored = source.mapInArrow(batches, "doc_id long, score double")
    return scored.select(F.col("doc_id").alias(key), held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they were.

    Null and empty texts score alike; repeated rows are judged each on its own.
    """
    at = docs.columns.index("text")

    def batches(rows):
        for batch in rows:
            x = np.array([features(t) for t in as_bytes(batch.column(at))]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(batches, docs.schema)
