"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the classes' log-count ratios, then a linear hinge-loss model is fitted
by dual coordinate descent. N-grams: word uni- and bigrams, and runs of one to three token shapes, where
a shape keeps a token's case class, digits, punctuation, and whether it repeats the token before. They
are hashed into 2**``log2_features`` features.

The fit uses a bounded sample of labelled rows (``max_train``, by a hash of doc_id); a fifth of it fits
the logistic curve that turns margins into probabilities. Every whole text is scored.

Defined cases: null and empty texts have no n-grams and get the probability of the bias alone; null
labels are not learned; several labels of one doc_id each count; with one class or no labels every
score is the share of label 1 (0.5 without labels); repeated rows are scored each; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_fraction, hash_share, map_rows, split_bucket

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Documents with a score of at least this are good.
THRESHOLD = 0.3


def _shape(token: str) -> str:
    if token[0].isalpha():
        if token.islower():
            return "a"
        if len(token) > 1 and token.isupper():
            return "AA"
        return "Aa" if token[1:].islower() or len(token) == 1 else "aA"
    if token[0].isdigit():
        return "0"
    return token[:3]


def features(text: str | None, log2_features: int) -> list[int]:
    """Sorted distinct feature numbers of a text's n-gram indicators."""
    mask, crc = (1 << log2_features) - 1, zlib.crc32
    grams: set[str] = set()
    seen: dict[str, str] = {}
    last, one, two = "", "^", "^"
    add = grams.add
    for token in _TOKEN.findall(text or ""):
        shape = seen.get(token)
        if shape is None:
            shape = seen[token] = _shape(token)
        if token == last:
            shape = "="
        word = token.lower()
        add(word)
        add(f"{last.lower()} {word}")
        add(f"\t{shape}")
        add(f"\t{one}\t{shape}")
        add(f"\t{two}\t{one}\t{shape}")
        last, two, one = token, one, shape
    return sorted({crc(g.encode("utf-8", "surrogatepass")) & mask for g in grams})


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    log2_features: int

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum()) / math.sqrt(max(1, x.size)) + self.bias

    def probability(self, x: np.ndarray) -> float:
        z = self.slope * self.margin(x) + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, size), alpha)
    for x, label in zip(rows, y, strict=True):
        counts[int(label > 0), x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 20, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights (already times the ratios) and bias of min |w|^2/2 + C sum hinge, each row scaled by 1/sqrt(its n-grams)."""
    w, bias = np.zeros(ratios.size), 0.0
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(10)
    # Values are made from the ratios at every visit; to hold them would take twice the rows' memory.
    value = lambda x: ratios[x] / math.sqrt(max(1, x.size))
    norm = [float(v @ v) + 1.0 for v in map(value, rows)]
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            v = value(x)
            g = y[i] * (float(w[x] @ v) + bias) - 1.0
            old = alpha[i]
            new = min(max(old - g / norm[i], 0.0), cost)
            if new != old:
                worst = max(worst, abs(new - old))
                w[x] += (new - old) * y[i] * v
                bias += (new - old) * y[i]
                alpha[i] = new
        if worst < tolerance * cost:
            break
    return w * ratios, bias


def fit_sigmoid(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve with Platt's softened targets, by damped Newton steps."""
    up, down = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, math.log((up + 1) / (down + 1))
    for _ in range(steps):
        z = np.clip(a * margins + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
        if np.abs(move).max() < 1e-7:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: list[int], log2_features: int) -> Model:
    size = 1 << log2_features
    y = np.where(np.array(labels, dtype=np.int64) > 0, 1.0, -1.0)
    if not rows or abs(y.sum()) == len(rows):
        share = 0.5 if not rows else float((y > 0).mean())
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size, np.float32), 0.0, 0.0, math.log(share / (1 - share)), log2_features)
    held = np.arange(len(rows)) % 5 == 4
    enough = min((y[held] > 0).sum(), (y[held] < 0).sum()) >= 5
    use = ~held if enough else np.ones(len(rows), bool)
    part = [x for x, u in zip(rows, use, strict=True) if u]
    ratios = log_count_ratios(part, y[use], size)
    w, bias = dual_coordinate_descent(part, ratios, y[use])
    model = Model(w.astype(np.float32), bias, 1.0, 0.0, log2_features)
    test = [x for x, h in zip(rows, held if enough else use, strict=True) if h]
    model.slope, model.offset = fit_sigmoid(np.array([model.margin(x) for x in test]), y[held if enough else use])
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, log2_features: int = 18) -> Model:
    """Fit on at most about ``max_train`` labelled rows whose crc32(doc_id) mod 5 is not 0."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null").filter(split_bucket(F.col("doc_id"), 5) != 0)
    known = known.filter(hash_share(F.col("doc_id"), 10, bounded_fraction(known.count(), max_train)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")

    def make():
        def step(cols):
            for doc_id, quality, text in zip(*cols, strict=True):
                yield doc_id, quality, np.array(features(text, log2_features), np.int32).tobytes()

        return step

    # One buffer holds all rows' features; the rows are views of it.
    got = map_rows(rows, "doc_id long, quality int, x binary", make, 200).toArrow().combine_chunks()
    ids, marks = got["doc_id"].to_pylist(), got["quality"].to_pylist()
    column = got["x"].combine_chunks() if got.num_rows else None
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    found = [] if column is None else [np.frombuffer(column[i].as_buffer(), np.int32) for i in range(len(ids))]
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], marks[i], found[i].tobytes()))
    return fit([found[i] for i in order], [marks[i] for i in order], log2_features)


def predict(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with score and predicted; the model is 2**log2_features floats (1 MB by default)."""
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(cols):
            for *kept, text in zip(*cols, strict=True):
                score = model.probability(np.array(features(text, model.log2_features), np.int64))
                yield (*kept, score, int(score >= THRESHOLD))

        return step

    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return map_rows(docs.select(*keep, F.col("text").alias("__text")), schema, make, 1000)


def classify_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, **options))
    return out.select("doc_id", (split_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
