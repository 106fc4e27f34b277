"""Translation metrics from additive statistics, bootstrap intervals, promotion gate."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
CHAR_ORDER, WORD_ORDER, BETA, BLEU_ORDER = 6, 2, 2.0, 4


def _counts(items: list[str], n: int) -> Counter:
    return Counter(zip(*(items[i:] for i in range(n))))


def sentence_statistics(hypothesis: str | None, reference: str | None) -> list[int]:
    """Hypothesis, reference and matched n-gram counts for characters 1-6, then words 1-4."""
    h, r = hypothesis or "", reference or ""
    out: list[int] = []
    for a, b, most in (("".join(h.split()), "".join(r.split()), CHAR_ORDER), (_WORD.findall(h), _WORD.findall(r), BLEU_ORDER)):
        for n in range(1, most + 1):
            x, y = _counts(a, n), _counts(b, n)
            out += [x.total(), y.total(), (x & y).total()]
    return out


def statistics(pairs: DataFrame, key: str, hypothesis: str, reference: str) -> DataFrame:
    """key and ``stats``, see sentence_statistics: vectors that add up over sentences. chrF++ takes the
    characters and words 1-2 of them, BLEU words 1-4.

    Counted in Arrow batches: nested array functions for thirty n-gram tables took a hundred times as long.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stats = [sentence_statistics(h, r) for h, r in zip(pdf["h"], pdf["r"])]
            yield pd.DataFrame({key: pdf[key], "stats": stats})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, F.col(hypothesis).alias("h"), F.col(reference).alias("r")).mapInPandas(run, f"{key} {kind}, stats array<long>")


def chrf(total: np.ndarray) -> float:
    """chrF++ of summed statistics: mean precision and recall over character and word orders, F with beta 2."""
    rows = total.reshape(-1, 3)[: CHAR_ORDER + WORD_ORDER].astype(float)
    rows = rows[(rows[:, 0] > 0) & (rows[:, 1] > 0)]
    if not len(rows):
        return 0.0
    p, r = (rows[:, 2] / rows[:, 0]).mean(), (rows[:, 2] / rows[:, 1]).mean()
    return 0.0 if p + r == 0 else float(100 * (1 + BETA**2) * p * r / (BETA**2 * p + r))


def bleu(total: np.ndarray) -> float:
    """BLEU of summed statistics, orders 1-4, with brevity penalty."""
    rows = total.reshape(-1, 3)[CHAR_ORDER : CHAR_ORDER + BLEU_ORDER].astype(float)
    if (rows[:, 2] == 0).any() or (rows[:, 0] == 0).any():
        return 0.0
    brief = min(0.0, 1 - rows[0, 1] / rows[0, 0])
    return float(100 * np.exp(brief + np.log(rows[:, 2] / rows[:, 0]).mean()))


def weights(key: object, resamples: int, seed: int = 12345) -> np.ndarray:
    """How often a sentence is drawn in each resample: Poisson numbers that its key alone decides, so that systems are paired."""
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())]).poisson(1.0, resamples)


def resampled(stats: DataFrame, key: str, resamples: int = 1000, seed: int = 12345) -> DataFrame:
    """system, resample, sums: the statistics of each resample, summed where the sentences are.

    ``stats`` has system, ``key`` and stats. Each task brings one vector a
    system and resample, however many sentences there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for system, k, x in zip(pdf["system"], pdf[key], pdf["stats"]):
                own = np.outer(weights(k, resamples, seed), np.asarray(x))
                sums[system] = own if system not in sums else sums[system] + own
        for system, total in sums.items():
            yield pd.DataFrame({"system": system, "resample": np.arange(resamples), "sums": list(total)})

    width = 3 * (CHAR_ORDER + BLEU_ORDER)
    parts = stats.select("system", key, "stats").mapInPandas(run, "system string, resample long, sums array<long>")
    total = parts.groupBy("system", "resample").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    return total.select("system", "resample", F.array(*[f"s{i}" for i in range(width)]).alias("sums"))


def gate(candidate: dict, baselines: list[dict], metric: str = "chrf", p_below: float = 0.05) -> bool:
    """A candidate may go out if it beats every baseline, each significantly."""
    return bool(baselines) and all(candidate[metric] > b[metric] and b["p_value"] < p_below for b in baselines)
