"""Quality scores by Bradley-Terry pairwise ranking (operator 4)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, texts_of
from .fitting import best_cut, descend, labelled, remainder
from .packing import forget_words

#: Labelled rows of each class that a fit gathers.
PER_CLASS = 4000
#: Preference pairs that a fit draws from them.
PAIRS = 30_000
#: The score at which the chosen quantile of raw scores lies.
THRESHOLD = 0.3

_NAMES = (
    "log_bytes", "space", "newline", "digit", "upper", "ascii_letter", "high", "full_stop", "comma", "pipe", "markup",
    "other_symbol", "mean_word", "long_words", "unique_words", "repeats", "bare_words", "top_word", "symbol_kinds", "lines",
    "unique_lines", "sentence_words",
)


def features(text: bytes) -> list[float]:
    """Shares of kinds of bytes, and of words and lines; all are finite for any text."""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    digits, upper, lower = counts[48:58].sum(), counts[65:91].sum(), counts[97:123].sum()
    spaces = counts[32] + counts[9:14].sum()
    symbols = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    plain = counts[44] + counts[46]
    words = text.split()
    k = max(1, len(words))
    different = Counter(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    top = max(different.values(), default=0)
    stops = counts[46] + counts[33] + counts[63]
    return [
        np.log1p(n), spaces / n, counts[10] / n, digits / n, upper / n, (upper + lower) / n, counts[128:].sum() / n,
        counts[46] / n, counts[44] / n, counts[124] / n, (counts[60] + counts[62]) / n,
        (symbols - plain - counts[124] - counts[60] - counts[62]) / n,
        min(30, (n - spaces) / k) / 10, sum(len(w) > 20 for w in different) / k, len(different) / k, repeats / k,
        min(1.0, (stops + counts[44]) / k), top / k, (counts[33:48] > 0).sum() / 15, min(1.0, len(lines) / k),
        len(set(lines)) / max(1, len(lines)), min(60.0, k / max(1, stops)) / 60,
    ]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the chosen quantile."""
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranker | None:
    """Document scores from preferences: each pair holds a good and a bad document, the loss is
    logistic in the difference of their features. None if a class is missing.

    The cut is the quantile of fitted scores that parts the classes best.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        return 0.0, -(d * p[:, None]).mean(0) + 1e-3 * w

    w = descend(loss, np.zeros(x.shape[1]), 150)
    raw = z @ w
    cut = best_cut(raw, y)
    spread = max(1e-6, float(np.median(raw[good]) - np.median(raw[bad])))
    return Ranker(mean, scale, w, cut, 8 / spread)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ranker | None:
    """Fit on at most ``per_class`` labelled documents of each class; their features, not texts, are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch)
            x = [features(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"]
            )

    sample = labelled(docs, labels, "quality", per_class).select("doc_id", "label", "text")
    rows = sample.mapInArrow(frugal(run), "doc_id long, label int, x array<double>").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("doc_id", kind="stable")
    return fit(np.array(rows["x"].tolist()), rows["label"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Weights are learnt from preference pairs of labelled documents outside the
    held-out fold, and a score is a function of the whole text alone. predicted
    is 1 from 0.3 on, where the chosen quantile of fitted scores lies.

    Null text counts as empty and is scored like any text. Rows with a null
    label or doc_id aren't learnt from; every document is scored, repeated rows
    each time. Without labels of both classes every score is 0.5. An empty
    table gives no rows. Other columns are not read, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch)
            if model.value is None:
                s = np.full(len(at) - 1, 0.5)
            else:
                x = [features(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
                s = model.value.score(np.array(x).reshape(len(x), len(_NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s)], ["doc_id", "raw", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), "text")
    return read.mapInArrow(run, "doc_id long, raw long, score double").select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "raw"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with all columns of ``docs``, in one pass: no join.

    Null text counts as empty and is scored like any text, however long. Equal
    rows are kept or dropped alike; without labels of both classes all are
    kept. An empty table gives no rows. Only ``text`` is read, other columns
    pass through whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            if model.value is None:
                yield batch
                continue
            data, at = texts_of(batch)
            x = [features(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
            yield batch.filter(pa.array(model.value.score(np.array(x).reshape(len(x), len(_NAMES))) >= THRESHOLD))

    return docs.mapInArrow(frugal(run), docs.schema)
