"""What the two text classifiers share: the split, the labelled sample, the calibration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str) -> Column:
    """crc32 of the doc_id as text, modulo 5; null doc_ids count as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(5))


def labelled(docs: DataFrame, labels: DataFrame, name: str, per_class: int) -> DataFrame:
    """text and label (0 or 1) of up to ``per_class`` labelled rows of each class outside the held-out fold.

    The bound is on what a fit gathers, not on what is scored. The rows are
    those with the smallest hashes of their doc_ids, so the same at every run.
    A doc_id with both labels is in neither class; of several documents with
    one doc_id the text with the smallest hash counts.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder("doc_id") != 0))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("label = 0").orderBy(*order).limit(per_class).unionByName(
        usable.where("label = 1").orderBy(*order).limit(per_class)
    )
    # At most 2 * per_class short rows.
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen.select("doc_id", "label")), "doc_id"
    )
    one = met.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"))
    return one.select("doc_id", "label", "least.text")


def best_cut(raw: np.ndarray, label: np.ndarray, negative_weight: float = 1.0) -> float:
    """Where to part scores: the quantile with the best balanced accuracy, midway between two different scores.

    ``negative_weight`` is how much a wrong negative counts against a wrong positive.
    """
    order = np.argsort(raw, kind="stable")
    y, s = label[order], raw[order]
    gain = negative_weight * np.cumsum(1 - y) / max(1, int((1 - y).sum())) - np.cumsum(y) / max(1, int(y.sum()))
    between = np.flatnonzero(s[1:] > s[:-1])
    if not len(between):
        return float(s[0])
    k = int(between[np.argmax(gain[between])])
    return float((s[k] + s[k + 1]) / 2)


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int) -> np.ndarray:
    """Adam on a full gradient; small dense problems and sparse ones of a few thousand rows."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, g = loss(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
