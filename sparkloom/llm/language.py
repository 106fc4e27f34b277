"""Language identification by interpolated Kneser-Ney character models (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts_of
from .fitting import remainder

#: Characters that a model looks at, the predicted one included.
ORDER = 5
#: Fold that scores are calibrated on; fold 0 is never learnt from.
CALIBRATION_FOLD = 4
#: Share of right answers that accepted ones must reach on the calibration fold.
PRECISION = 0.99
#: Bins of margins that a calibration gathers.
BINS = 256
#: Bytes of models that a task holds at a time; with more, texts are read in as many passes as needed.
MODEL_MEMORY = 96 << 20
#: Bytes of texts that are worked on at once.
TOGETHER = 2 << 20
#: Grams that a task holds before it adds up equal ones, and parts that a language's grams are dealt into.
MERGED_AT, BUCKETS = 1 << 21, 64
UNKNOWN = "und"

_SPACE = 32
_FACTORS = np.random.default_rng(31).integers(0, 1 << 63, (ORDER + 1, ORDER), np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = [f"c{k}" for k in range(ORDER)]


@cache
def _fold() -> np.ndarray:
    """For every code point its lower-case letter; a space for what is no letter."""
    folded = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            folded[c] = ord(x.lower()[0])
    return folded


def characters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, places of those to be predicted, and how many of these each text has.

    Letters in lower case; everything else is a space, runs of which are one.
    Before a text stand as many spaces as a context has, behind it one. A text
    without a letter has nothing to predict.
    """
    wide = [t.decode("utf-8", "replace").encode("utf-32-le") + b"\x20\0\0\0" for t in texts]
    codes = _fold()[np.frombuffer(b"".join(wide), np.uint32)]
    text = np.repeat(np.arange(len(wide)), np.array([len(w) for w in wide]) // 4)
    before = np.append(_SPACE, codes[:-1]) if len(codes) else codes
    keep = (codes != _SPACE) | ((before != _SPACE) & (np.diff(text, prepend=-1) == 0))
    codes, text = codes[keep], text[keep]
    at = np.arange(len(codes)) + (text + 1) * (ORDER - 1)
    laid = np.full(len(codes) + (ORDER - 1) * len(texts), _SPACE, np.uint32)
    laid[at] = codes
    return laid, at, np.bincount(text, minlength=len(texts))


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of grams, given character by character."""
    k = len(columns)
    return reduce(np.add, (c.astype(np.uint64) * f for c, f in zip(columns, _FACTORS[k])), np.zeros(len(columns[0]), np.uint64))


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct grams, character by character, and for each gram given the number of its own."""
    made = pa.array(hashes(columns)).dictionary_encode()
    nth = made.indices.to_numpy()
    first = np.empty(len(made.dictionary), np.int64)
    first[nth[::-1]] = np.arange(len(nth))[::-1]
    return [c[first] for c in columns], nth


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Grams and counts of several parts, each gram once."""
    whole = np.concatenate(parts, axis=1)
    columns, nth = distinct(list(whole[:ORDER]))
    sums = [np.bincount(nth, row).astype(whole.dtype) for row in whole[ORDER:]]
    return np.stack([*columns, *sums]).astype(whole.dtype) if len(nth) else whole


def _packed(lang: str, grams: np.ndarray) -> pa.RecordBatch:
    """Grams and counts dealt into buckets, each sorted and compressed: next to each other they take a few bytes each."""
    pack = zstandard.ZstdCompressor(level=3).compress
    bucket = (hashes(list(grams[:ORDER])) >> np.uint64(40)) % np.uint64(BUCKETS)
    order = np.lexsort((*grams[ORDER - 1 :: -1], bucket))
    edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    rows = [(k, pack(np.ascontiguousarray(grams[:, order[a:b]]).tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "bucket", "packed"])


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, the characters of a gram, n, and n_fit (outside the calibration fold), over all texts that models learn from; written out.

    A task adds up its texts' counts and hands on sorted, compressed parts; the
    parts of a language's bucket are merged one after another, so a task holds
    the different grams of one bucket and what comes next.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            data, at = texts_of(batch, "text")
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            groups: dict[tuple[str, bool], list[int]] = {}
            for i, key in enumerate(keys):
                groups.setdefault(key, []).append(i)
            for (lang, held), rows in groups.items():
                ends = np.cumsum([at[i + 1] - at[i] for i in rows])
                k = 0
                while k < len(rows):
                    m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + TOGETHER, "right")))
                    laid, places, _ = characters([data[at[i] : at[i + 1]].tobytes() for i in rows[k:m]])
                    k = m
                    if not len(places):
                        continue
                    columns, nth = distinct([laid[places - d] for d in range(ORDER - 1, -1, -1)])
                    n = np.bincount(nth).astype(np.uint32)
                    held_back.setdefault(lang, []).append(np.stack([*columns, n, n * np.uint32(not held)]))
                    size += len(n)
            if size > MERGED_AT:
                held_back = {lang: [_merged(parts)] for lang, parts in held_back.items()}
                size = sum(p[0].shape[1] for p in held_back.values())
                if size > MERGED_AT // 2:
                    for lang, parts in held_back.items():
                        yield _packed(lang, parts[0])
                    held_back, size = {}, 0
        for lang, parts in held_back.items():
            yield _packed(lang, _merged(parts))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        key, parts, size = None, [], 0

        def given() -> pa.RecordBatch:
            grams = _merged(parts)
            n = grams.shape[1]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), *(pa.array(c.astype(np.int32)) for c in grams[:ORDER]), *(pa.array(c.astype(np.int64)) for c in grams[ORDER:])], ["lang", *_GRAM, "n", "n_fit"])

        for batch in batches:
            for lang, bucket, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (lang, bucket) != key:
                    if parts:
                        yield given()
                    key, parts, size = (lang, bucket), [], 0
                parts.append(np.frombuffer(unpack(packed), np.uint32).reshape(ORDER + 2, -1).astype(np.uint64))
                size += parts[-1].shape[1]
                if size > max(MERGED_AT, 2 * parts[0].shape[1]):
                    parts = [_merged(parts)]
                    size = parts[0].shape[1]
        if parts:
            yield given()

    fold = remainder("doc_id")
    read = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(fold != 0).select(F.col("lang").cast("string"), (fold == CALIBRATION_FOLD).alias("held"), "text")
    parts = read.mapInArrow(count, "lang string, bucket int, packed binary").repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return materialize(parts.mapInArrow(merge, f"lang string, {', '.join(f'{c} int' for c in _GRAM)}, n long, n_fit long"))


def statistics(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What interpolated Kneser-Ney needs: grams (lang, k, c0.., n) and contexts (lang, k, c0.., all, kinds); written out.

    Characters stand at the end, -1 before them. Grams of full length count as
    often as they occur, shorter ones as many different characters as stand
    before them. A context has the sum of what follows it, and how many kinds.
    """
    level = counted.select("lang", F.lit(ORDER).alias("k"), *_GRAM, F.col("n").cast("double").alias("n"))
    levels = [level]
    for k in range(ORDER - 1, 0, -1):
        kept = _GRAM[ORDER - k :]
        shorter = level.groupBy("lang", *kept).agg(F.count("*").cast("double").alias("n"))
        level = shorter.select("lang", F.lit(k).alias("k"), *[F.col(c) if c in kept else F.lit(-1).alias(c) for c in _GRAM], "n")
        levels.append(level)
    grams = materialize(reduce(DataFrame.unionByName, levels))
    moved = grams.select("lang", (F.col("k") - 1).alias("k"), F.lit(-1).alias("c0"), *[F.col(a).alias(b) for a, b in zip(_GRAM, _GRAM[1:])], "n")
    contexts = moved.groupBy("lang", "k", *_GRAM).agg(F.sum("n").alias("all"), F.count("*").cast("double").alias("kinds"))
    return grams, contexts


@dataclass
class Model:
    """One language: sorted hashes of grams by length with their counts, and of contexts with sums and kinds; a discount for each length."""

    grams: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)
    contexts: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)
    cuts: dict[int, float] = field(default_factory=dict)

    @staticmethod
    def _found(table: tuple[np.ndarray, ...] | None, keys: np.ndarray) -> list[np.ndarray]:
        """The values of each key, zeros where it isn't there."""
        if table is None or not len(table[0]):
            return [np.zeros(len(keys))] * 2
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        there = table[0][at] == keys
        return [np.where(there, values[at], 0.0) for values in table[1:]]

    def probability(self, k: int, own: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Of grams of length k, by their and their contexts' hashes and the probabilities by shorter contexts."""
        n, cut = self._found(self.grams.get(k), own)[0], self.cuts.get(k, 0.5)
        whole, kinds = self._found(self.contexts.get(k - 1), context)
        seen = whole > 0
        whole = np.where(seen, whole, 1.0)
        return np.where(seen, (np.maximum(n - cut, 0) + cut * kinds * below) / whole, below)


@dataclass
class Slice:
    """The part of all models whose contexts end in a share of the pairs of characters."""

    languages: list[str]
    models: list[Model]
    floor: float
    part: int = 0
    parts: int = 1

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of the last character of each gram, a row for each language."""
        k = len(columns)
        if k == 0:
            return np.full((len(self.models), 1), self.floor)
        shorter, nth = distinct(columns[1:]) if k > 1 else ([], np.zeros(len(columns[0]), np.int64))
        below = self.probabilities(shorter)[:, nth]
        own, context = hashes(columns), hashes(columns[:-1]) if k > 1 else np.zeros(len(columns[0]), np.uint64)
        for i, m in enumerate(self.models):
            below[i] = m.probability(k, own, context, below[i])
        return below


def _branch(one: np.ndarray, two: np.ndarray, parts: int) -> np.ndarray:
    """The part that a pair of characters belongs to."""
    return ((hashes([one, two]) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


@dataclass
class Models:
    """The models of all languages in slices of bounded memory, on the tasks' side of a broadcast, and the calibration."""

    languages: list[str]
    slices: list[Broadcast]
    uniform: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5


def _slices(counted: DataFrame, memory: int) -> Models:
    """Models as sorted hash arrays, in slices of about ``memory`` bytes; grams of up to two characters are in each."""
    grams, contexts = statistics(counted)
    once, twice = (F.count(F.when(F.col("n") == c, 1)) for c in (1, 2))
    levels = grams.groupBy("lang", "k").agg(F.count("*").alias("rows"), once.alias("once"), twice.alias("twice"), F.collect_set(F.when(F.col("k") == 1, F.col(_GRAM[-1]))).alias("letters"))
    found = levels.collect()
    languages = sorted({r["lang"] for r in found})
    if not languages:
        return Models([], [], 1.0)
    floor = 1 / (len({c for r in found for c in r["letters"]}) + 1)
    # Where no gram is counted twice the share says nothing; a discount of one would leave nothing to what is counted once.
    cuts = {(r["lang"], r["k"]): min(0.95, r["once"] / (r["once"] + 2 * r["twice"])) if r["once"] and r["twice"] else 0.5 for r in found}
    parts = max(1, math.ceil(sum(r["rows"] for r in found) * 40 / memory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(1).to_numpy()
            codes = [batch.column(2 + j).to_numpy().astype(np.uint32) for j in range(ORDER)]
            context = batch.column(2 + ORDER).to_numpy(zero_copy_only=False)
            key, part = np.zeros(len(k), np.uint64), np.full(len(k), -1)
            for n in range(1, ORDER + 1):
                key[k == n] = hashes([c[k == n] for c in codes[ORDER - n :]])
            for chosen, end in ((context & (k >= 2), ORDER), (~context & (k >= 3), ORDER - 1)):
                part[chosen] = _branch(codes[end - 2][chosen], codes[end - 1][chosen], parts)
            kind = np.where(context, k, k + ORDER + 1).astype(np.int32)
            of = pc.index_in(batch.column(0), value_set=pa.array(languages, batch.column(0).type))
            yield pa.RecordBatch.from_arrays([of, pa.array(kind), pa.array(key.view(np.int64)), *batch.columns[-2:], pa.array(part.astype(np.int32))], ["of", "kind", "key", "n", "kinds", "part"])

    named = F.lit(False).alias("context"), "n", F.lit(0.0).alias("kinds")
    both = grams.select("lang", "k", *_GRAM, *named).union(contexts.select("lang", "k", *_GRAM, F.lit(True), "all", "kinds"))
    hashed = both.mapInArrow(run, "of int, kind int, key long, n double, kinds double, part int")
    hashed = materialize(hashed) if parts > 1 else hashed
    slices = []
    for part in range(parts):
        here = hashed.where(F.col("part").isin(-1, part)).drop("part").toArrow()
        of, kind, key, n, kinds = (here[c].to_numpy() for c in ("of", "kind", "key", "n", "kinds"))
        key = key.view(np.uint64)
        models = [Model(cuts={k: cut for (lang, k), cut in cuts.items() if lang == x}) for x in languages]
        order = np.lexsort((key, kind, of))
        for chosen in np.split(order, np.flatnonzero(np.diff(of[order]) | np.diff(kind[order])) + 1):
            if not len(chosen):
                continue
            x, model = int(kind[chosen[0]]), models[of[chosen[0]]]
            if x <= ORDER:
                model.contexts[x] = (key[chosen], n[chosen], kinds[chosen].astype(np.int32))
            else:
                model.grams[x - ORDER - 1] = (key[chosen], n[chosen])
        slices.append(counted.sparkSession.sparkContext.broadcast(Slice(languages, models, floor, part, parts)))
    return Models(languages, slices, -math.log(floor))


def cross_entropies(docs: DataFrame, models: Models, *keep: str) -> DataFrame:
    """doc_id, the columns to ``keep``, n (characters predicted) and h (nats a character in each language, in order) of every document.

    With more slices than one, the texts are read as often and the sums of a
    document's characters added up; rows of one doc_id and text count once for
    each time they come.
    """
    kept = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.xxhash64("text").alias("_raw"), "text")
    sums = [f"_s{i}" for i in range(len(models.languages))]
    schema = ", ".join(filter(None, ["doc_id long", kept, "_raw long, n long", *[f"{s} double" for s in sums]]))
    passes = []
    for table in models.slices:

        def run(batches: Iterator[pa.RecordBatch], table: Broadcast = table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = texts_of(batch, "text")
                k = 0
                while k < batch.num_rows:
                    m = max(k + 1, int(np.searchsorted(at, at[k] + TOGETHER, "right")) - 1)
                    yield _summed(batch.slice(k, m - k), [data[at[i] : at[i + 1]].tobytes() for i in range(k, m)], table.value, sums)
                    k = m

        passes.append(read.mapInArrow(run, schema))
    whole = passes[0]
    if len(passes) > 1:
        times = F.count("*") / len(passes)
        grouped = reduce(DataFrame.unionByName, passes).groupBy("doc_id", *keep, "_raw", "n").agg(times.cast("long").alias("_times"), *[(F.sum(s) / times).alias(s) for s in sums])
        whole = grouped.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    h = F.array(*[F.when(F.col("n") > 0, -F.col(s) / F.col("n")) for s in sums])
    return whole.select("doc_id", *keep, "n", h.alias("h"))


def _summed(batch: pa.RecordBatch, texts: list[bytes], models: Slice, sums: list[str]) -> pa.RecordBatch:
    """The batch without its text, the number of characters of each text, and the sums of log probabilities in each language."""
    laid, places, n = characters(texts)
    got = np.zeros((len(sums), len(texts)))
    if models.parts > 1:
        owner = np.repeat(np.arange(len(texts)), n)
        here = _branch(laid[places - 2], laid[places - 1], models.parts) == models.part
        places, counts = places[here], np.bincount(owner[here], minlength=len(texts))
    else:
        counts = n
    if len(places):
        columns, nth = distinct([laid[places - d] for d in range(ORDER - 1, -1, -1)])
        begins = np.cumsum(counts) - counts
        some = counts > 0
        for i, scores in enumerate(np.log(models.probabilities(columns))):
            got[i, some] = np.add.reduceat(scores[nth], begins[some])
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), *map(pa.array, got)], [*batch.schema.names[:-1], "n", *sums])


def _chosen(entropies: DataFrame, models: Models) -> DataFrame:
    """The columns of ``cross_entropies``, pred (the language with the lowest) and margin: how far the next one, or chance, is, for the text's length."""
    named = F.array(*[F.struct(F.get("h", F.lit(i)).alias("h"), F.lit(x).alias("lang")) for i, x in enumerate(models.languages)])
    ranked = entropies.withColumn("_ranked", F.array_sort(named))
    best, second = (F.get("_ranked", F.lit(i)) for i in (0, 1))
    following = F.least(F.coalesce(second["h"], F.lit(models.uniform)), F.lit(models.uniform))
    return ranked.select(*entropies.columns, best["lang"].alias("pred"), ((following - best["h"]) * F.sqrt("n")).alias("margin"))


def calibrated(models: Models, scored: DataFrame) -> Models:
    """The models with slope, offset and threshold from rows with lang, pred and margin.

    Logistic regression of right or wrong on the margin, from counts in bins of
    margins; answers below the threshold are those without which the others
    reach PRECISION.
    """
    binned = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.log2(1 + F.greatest(F.lit(0.0), F.col("margin"))) * 16).cast("int")))
    counts = scored.where("n > 0").groupBy(binned.alias("bin")).agg(F.count("*").alias("n"), F.count(F.when(F.col("lang") == F.col("pred"), 1)).alias("right"), F.avg("margin").alias("x"))
    rows = sorted(counts.collect(), key=lambda r: r["bin"])
    # One wrong and one right answer without a margin, so that certainty needs margins and is never whole.
    x = np.array([0.0, *[r["x"] for r in rows]])
    n, right = np.array([2, *[r["n"] for r in rows]], float), np.array([1, *[r["right"] for r in rows]], float)
    x = np.log1p(np.maximum(0, x))
    w = np.array([1.0, 0.0])
    features = np.stack([x, np.ones_like(x)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ features, -30, 30)))
        gradient = features @ (right - n * p) - 1e-3 * w
        step = np.linalg.solve((features * (n * p * (1 - p))) @ features.T + 1e-3 * np.eye(2), gradient)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    models.slope, models.offset = float(max(w[0], 1e-6)), float(w[1])
    score = 1 / (1 + np.exp(-(models.slope * x[1:] + models.offset)))
    share = np.cumsum(right[:0:-1])[::-1] / np.cumsum(n[:0:-1])[::-1]
    enough = np.flatnonzero(share >= PRECISION)
    models.threshold = float(score[enough[0]]) if len(enough) else 1.0
    return models


def fit(docs: DataFrame, memory: int = MODEL_MEMORY) -> Models:
    """Models of every language that documents outside the held-out fold have, from all their texts.

    Scores are calibrated with models that haven't seen CALIBRATION_FOLD, on
    the documents of that fold.
    """
    counted = gram_counts(docs)
    models = _slices(counted.select("lang", *_GRAM, "n"), memory)
    if not models.languages:
        return models
    trial = _slices(counted.where("n_fit > 0").select("lang", *_GRAM, F.col("n_fit").alias("n")), memory)
    if trial.languages:
        held = docs.where(F.col("lang").isNotNull()).where(remainder("doc_id") == CALIBRATION_FOLD)
        calibrated(trial, _chosen(cross_entropies(held.withColumn("lang", F.col("lang").cast("string")), trial, "lang"), trial))
        models.slope, models.offset, models.threshold = trial.slope, trial.offset, trial.threshold
        for s in trial.slices:
            s.unpersist()
    return models


def identify(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected and cross_entropy of every document.

    A character model of each language gives the text's cross-entropy, by
    character; the language with the lowest one is predicted, of equal ones the
    first by name. ``score`` is the calibrated chance that it is right, by how
    far the next language, or chance, is; with a score under the calibrated
    threshold the answer is ``rejected``. Without ``models`` they are learnt
    from text and lang of the documents outside the held-out fold.

    A null text or one without a letter is ``und``, with a score of 0, and
    rejected; so is every text where no language is known. Very long texts are
    read whole. Rows with a null lang, and those in the held-out fold, aren't
    learnt from, but predicted as all others; repeated rows are learnt from and
    come back as often as they come. A null doc_id counts as the empty text in
    the fold. An empty table gives no rows. Other columns are not read,
    whatever their names.
    """
    models = models or fit(docs)
    held_out = (remainder("doc_id") == 0).alias("held_out")
    if not models.languages:
        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        return one.select("doc_id", held_out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))
    found = _chosen(cross_entropies(docs, models), models)
    some = F.col("n") > 0
    raw = models.slope * F.log1p(F.greatest(F.lit(0.0), F.col("margin"))) + models.offset
    score = F.when(some, 1 / (1 + F.exp(-raw))).otherwise(F.lit(0.0))
    return found.select(
        "doc_id", held_out, F.when(some, F.col("pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"),
        (~some | (score < models.threshold)).alias("rejected"), F.array_min("h").alias("cross_entropy"),
    )
