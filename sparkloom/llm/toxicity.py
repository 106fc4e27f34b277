"""Toxicity scores with counterfactual regularisation (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import fsum, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import best_cut, descend, labelled, remainder

#: Labelled rows of each class that a fit gathers.
PER_CLASS = 2500
#: Weight of the squared score change when identity terms are swapped.
SWAP_PENALTY = 4.0
#: Features that differ between the classes as much as the kept ones by chance alone, at most about so many.
CHANCE = 5.0
# Terms that name groups, in the corpus's four languages; a neutral mention must not count. By kind: one is swapped for another of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "american"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "blind", "deaf", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "blinde", "taube", "alte", "junge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("homosexuel", "lesbienne", "hétérosexuel", "bisexuel"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("handicapés", "aveugles", "sourds", "vieux", "jeunes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("homosexual", "lesbiana", "heterosexual", "bisexual"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("discapacitados", "ciegos", "sordos", "viejos", "jóvenes"),
)

#: Lengths of the beginnings of words that are features beside whole words: an insult is inflected and compounded.
STEMS = range(3, 9)
#: Different words with one beginning are told apart up to so many.
TIMES = 3
#: How much a clean text called toxic counts against a toxic one missed.
CLEAN_WEIGHT = 4.0
#: Words whose features a Python worker remembers; when there are more it starts anew.
REMEMBERED = 300_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass
class Model:
    """``weights`` of features; a feature with a number behind its star stands for so many different words."""

    weights: dict[str, float]
    bias: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    upto: dict[str, tuple[float, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        for name in {x.rstrip("23") if "*" in x else x for x in self.weights}:
            steps = [self.weights.get(x, 0.0) for x in _times(name)]
            self.upto[name] = (0.0, *accumulate(steps))

    def score(self, words: set[str]) -> float:
        """Probability for a text of these words; each word counts once."""
        known, counts = self.known, {}
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = tuple(x for x in features_of(w) if x in self.upto)
            for x in f:
                counts[x] = counts.get(x, 0) + 1
        raw = self.bias + fsum([self.upto[x][min(n, len(self.upto[x]) - 1)] for x, n in counts.items()])
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, raw)))))


def _times(name: str) -> list[str]:
    """A beginning as met in one, two, three different words; a word is one."""
    return [name, *(f"{name}{n}" for n in range(2, TIMES + 1))] if name.endswith("*") else [name]


def _swapped(words: set[str], turn: int) -> set[str]:
    """A sentence's words with each identity term swapped for another of its kind; where there is none, one is put in."""
    out, found = set(words), False
    for kind in IDENTITY_TERMS:
        here = [t for t in kind if t in words]
        for t in here:
            out.discard(t)
            out.add(kind[(kind.index(t) + 1 + turn % (len(kind) - 1)) % len(kind)])
            found = True
    if not found:
        kind = IDENTITY_TERMS[turn % len(IDENTITY_TERMS)]
        out.add(kind[turn // len(IDENTITY_TERMS) % len(kind)])
    return out


class _Columns:
    """Numbers of features. A beginning's numbers for one, two, three words follow each other."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, int] = {}
        self.of: dict[str, np.ndarray] = {}
        self.starred = bytearray()

    def first(self, name: str) -> int:
        if name not in self.at:
            self.at[name] = len(self.names)
            self.names += _times(name)
            self.starred += bytes([name.endswith("*")]) * (len(self.names) - len(self.starred))
        return self.at[name]

    def word(self, w: str) -> np.ndarray:
        if w not in self.of:
            self.of[w] = np.array([self.first(x) for x in features_of(w)], np.int64)
        return self.of[w]

    def counts(self, words: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """First columns of a text's features, and of how many words each is one."""
        return np.unique(np.concatenate([np.zeros(0, np.int64), *[self.word(w) for w in words]]), return_counts=True)

    def columns(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        starred = np.frombuffer(self.starred, np.uint8)[first] > 0
        return np.concatenate([first[n > 0], *[first[starred & (n >= t)] + t - 1 for t in range(2, TIMES + 1)]])

    def moved(self, first: np.ndarray, n: np.ndarray, go: set[str], come: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns that come and that go when a text with these counts changes some words."""
        touched = np.unique(np.concatenate([np.zeros(0, np.int64), *[self.word(w) for w in (*go, *come)]]))
        at = np.minimum(np.searchsorted(first, touched), max(0, len(first) - 1))
        before = np.where(first[at] == touched, n[at], 0) if len(first) else np.zeros(len(touched), np.int64)
        change = np.zeros(len(touched), np.int64)
        for words, sign in ((go, -1), (come, 1)):
            for w in words:
                np.add.at(change, np.searchsorted(touched, self.word(w)), sign)
        old, new = self.columns(touched, before), self.columns(touched, before + change)
        return np.setdiff1d(new, old), np.setdiff1d(old, new)


def _entries(rows: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and kept column of every entry; ``place`` is -1 for columns that are left out."""
    ri = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ci = place[np.concatenate([np.zeros(0, np.int64), *rows])]
    return ri[ci >= 0], ci[ci >= 0]


def _telling(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Columns whose counts in the classes differ more than chance explains.

    The chance of a feature's counts is bounded by that of a binomial tail
    (Chernoff's bound); features too rare to differ at all aren't counted among those tried.
    """
    share = float(y.mean())
    n = np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=size)
    k = np.bincount(np.concatenate([np.zeros(0, np.int64), *[r for r, label in zip(rows, y) if label]]), minlength=size)
    p = k / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = n * (np.where(p > 0, p * np.log(p / share), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0))
    most = n * log(1 / min(share, 1 - share))
    tried = np.sort(most)[::-1]
    # As many are tried as could reach what so many tries ask for.
    need = np.log(np.maximum(np.arange(1, len(tried) + 1) / CHANCE, 1.0))
    asked = need[np.flatnonzero(tried >= need)[-1]] if len(tried) and (tried >= need).any() else 0.0
    return np.flatnonzero((far >= asked) & (n > 1))


def fit(rows: list[set[str]], y: np.ndarray, penalty: float = SWAP_PENALTY) -> Model | None:
    """Logistic regression on the words of a text, with the mean squared change of the
    raw score under identity swaps as a penalty. None if a class is missing.

    A feature's value is its log ratio of document shares among toxic and other
    texts, so few and frequent signs get through at once.
    """
    if len(set(y.tolist())) < 2:
        return None
    columns = _Columns()
    terms = [columns.first(t) for kind in IDENTITY_TERMS for t in kind]
    counted = [columns.counts(ws) for ws in rows]
    plain = [columns.columns(*c) for c in counted]
    changed = [_swapped(ws, i) for i, ws in enumerate(rows)]
    moves = [columns.moved(*c, ws - new, new - ws) for c, ws, new in zip(counted, rows, changed)]
    kept = np.array(list(dict.fromkeys([*terms, *_telling(plain, y, len(columns.names)).tolist()])))
    place = np.full(len(columns.names), -1)
    place[kept] = np.arange(len(kept))
    k, n = len(kept), len(rows)
    ri, ci = _entries(plain, place)
    toxic = y[ri] == 1
    p = np.bincount(ci[toxic], minlength=k) + 1.0
    q = np.bincount(ci[~toxic], minlength=k) + 1.0
    ratio = np.log(p / (y.sum() + 2)) - np.log(q / ((1 - y).sum() + 2))
    ratio[: len(terms)] = np.where(ratio[: len(terms)] == 0, 1.0, ratio[: len(terms)])
    # What a swap moves: the features that come, less those that go.
    si, sj = _entries([m[0] for m in moves], place)
    di, dj = _entries([m[1] for m in moves], place)
    ki, kj = np.concatenate([si, di]), np.concatenate([sj, dj])
    sign = np.concatenate([np.ones(len(si)), -np.ones(len(di))])
    balance = np.where(y == 1, n / (2 * max(1, y.sum())), n / (2 * max(1, (1 - y).sum())))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        v = w[:k] * ratio
        raw = np.bincount(ri, v[ci], minlength=n) + w[k]
        miss = balance * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / n
        moved = np.bincount(ki, sign * v[kj], minlength=n)
        g = np.bincount(ci, miss[ri], minlength=k) + penalty * np.bincount(kj, sign * moved[ki], minlength=k) / n
        return 0.0, np.append(g * ratio + 2e-4 * w[:k], miss.sum())

    w = descend(loss, np.zeros(k + 1), 60)
    v = w[:k] * ratio
    raw = np.bincount(ri, v[ci], minlength=n)
    return Model({columns.names[c]: float(x) for c, x in zip(kept.tolist(), v) if abs(x) > 1e-4}, -best_cut(raw, y, CLEAN_WEIGHT))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` labelled documents of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words_of(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["doc_id", "label", "words"]
            )

    sample = labelled(docs, labels, "toxic", per_class).select("doc_id", "label", "text")
    rows = sorted(sample.mapInArrow(run, "doc_id long, label int, words array<string>").toLocalIterator(), key=lambda r: r[0])
    if not rows:
        return None
    intern: dict[str, str] = {}
    sets = [{intern.setdefault(w, w) for w in r["words"]} for r in rows]
    return fit(sets, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.5 on).

    A linear model over the words of the whole text, learnt outside the
    held-out fold; swapping identity terms must not move a score, see fit.

    Null text counts as empty and gets the score of no words. Rows with a null
    label or doc_id aren't learnt from; every document is scored, repeated rows
    each time. Without labels of both classes every score is 0. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = [0.0 if model.value is None else model.value.score(words_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
