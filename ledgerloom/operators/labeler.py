"""The slot of a token model: one model a worker, batches of documents, words labelled by their first subword.

A model is what ``load`` returns on a worker: a function from lists of words and boxes of several documents to their
subwords' scores and the words they belong to. It is loaded once in a worker process, however many tasks and batches
the process sees. ``LinearModel`` is a small one: scores are sums of weights of hashed features.

Defined cases: documents without words get empty lists; a word without a subword is O with confidence 0; ties go
to the label named first; null words are empty texts; scores that aren't finite are an error of the model.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .labels import LABELS

#: (documents' words, documents' boxes) to one (scores [subword, label], word of each subword) a document.
Model = Callable[[list[list[str]], list[np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]

_loaded: dict[str, Model] = {}


def once(name: str, load: Callable[[], Model]) -> Model:
    """The model of this name in this process."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


class LinearModel:
    """Scores by weights [label, bucket] of the features of a subword: its text, the words beside its word, and the tenth of the page it stands on.

    Words are cut into subwords of ``width`` characters.
    """

    def __init__(self, weights: np.ndarray, width: int = 4):
        self.weights, self.width = weights, width

    def features(self, words: list[str], boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features [subword, 5] as buckets, word of each subword)."""
        n, rows, of = self.weights.shape[1], [], []
        at = lambda i: words[i].lower() if 0 <= i < len(words) else ""
        for i, word in enumerate(words):
            for k in range(0, len(word), self.width):
                x, y = (int(boxes[i][0]) // 100, int(boxes[i][1]) // 100) if len(boxes) > i else (0, 0)
                named = (f"s{word[k : k + self.width].lower()}", f"p{at(i - 1)}", f"n{at(i + 1)}", f"x{x}", f"y{y}")
                rows.append([zlib.crc32(f.encode("utf-8", "surrogatepass")) % n for f in named])
                of.append(i)
        return np.array(rows, np.int64).reshape(-1, 5), np.array(of, np.int64)

    def __call__(self, words: list[list[str]], boxes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        made = [self.features(w, b) for w, b in zip(words, boxes, strict=True)]
        every = np.concatenate([f for f, _ in made]) if made else np.zeros((0, 5), np.int64)
        scores = self.weights[:, every].sum(axis=2).T  # one product for the whole batch
        return list(zip(np.split(scores, np.cumsum([len(f) for f, _ in made])[:-1]) if made else [], [of for _, of in made], strict=True))


def softmax(scores: np.ndarray) -> np.ndarray:
    """Rows of probabilities."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if scores.size else scores
    return e / e.sum(axis=1, keepdims=True) if scores.size else e


def words_of(scores: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, probability) of each word, by its first subword."""
    label, sure = np.zeros(n_words, np.int64), np.zeros(n_words)
    if len(word):
        if not np.isfinite(scores).all():
            raise ValueError("the model's scores aren't finite")
        values, first = np.unique(word, return_index=True)
        p = softmax(scores[first])
        label[values], sure[values] = p.argmax(axis=1), p.max(axis=1)
    return label, sure


def label_tokens(rows: DataFrame, name: str, load: Callable[[], Model], labels: tuple[str, ...] = LABELS, threshold: float = 0.0, use_layout: bool = True, documents: int = 64) -> DataFrame:
    """Adds labels and sure, arrays beside t, to rows of packed tokens; below ``threshold`` a label is O.

    ``documents`` go to the model at a time. Without layout all boxes are zeros. The name tells models apart
    within a worker; other columns pass through.
    """
    ship(rows.sparkSession)
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(name, load)
        for batch in batches:
            for at in range(0, batch.num_rows, documents):
                part = batch.slice(at, documents)
                tokens = part.column(kept.index("t")).to_pylist()
                words = [[x["text"] or "" for x in t or ()] for t in tokens]
                place = lambda x: (x.get("x0") or 0, x.get("y0") or 0) if use_layout else (0, 0)
                boxes = [np.array([place(x) for x in t or ()], np.int64).reshape(-1, 2) for t in tokens]
                found = [words_of(s, w, len(own)) for (s, w), own in zip(model(words, boxes), words, strict=True)]
                named = [[labels[k] if p >= threshold and p > 0 else "O" for k, p in zip(*x, strict=True)] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(named, pa.list_(pa.string())), pa.array([p for _, p in found], pa.list_(pa.float64()))], names=[*kept, "labels", "sure"])

    more = [T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("sure", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def mean_confidence(labelled: DataFrame) -> DataFrame:
    """One row: the tokens that aren't O, and their mean confidence, 0 without any; labelled rows have labels and sure."""
    own = labelled.select(F.explode(F.arrays_zip("labels", "sure")).alias("x")).filter("x.labels <> 'O'")
    return own.agg(F.count("*").alias("n"), F.coalesce(F.avg("x.sure"), F.lit(0.0)).alias("mean"))
