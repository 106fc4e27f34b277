"""Names of people in sentence pairs, swapped on both sides alike for names of a pool."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of names that a task holds; larger tables are refused.
MOST_NAMES = 64 << 20
# A name behind a title stands for somebody in particular.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "rev", "pastor", "king", "queen", "saint", "st", "pope", "president")


def _number(key: str) -> int:
    return int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")


@dataclass
class Swap:
    """Known names with their gender, and the pool of each gender in order."""

    people: dict[str, str]
    pool: dict[str, list[str]]
    seed: str

    def __post_init__(self) -> None:
        # A name within a hyphenated word or before an apostrophe's letter isn't one.
        names = "|".join(map(regex.escape, sorted(self.people, key=lambda n: (-len(n), n))))
        self.names = regex.compile(rf"(?<![\w-])(?:{names})(?![\w-])") if names else None
        self.titled = regex.compile(rf"(?<!\w)(?i:{'|'.join(TITLES)})\.?\s+(?:{names})(?![\w-])") if names else None

    def chosen(self, record: str, found: list[str]) -> dict[str, str] | None:
        """A name of the pool for each name: from a place that the record and the name tell, the next one not taken yet."""
        out: dict[str, str] = {}
        taken: set[str] = set()
        for name in dict.fromkeys(found):
            pool = self.pool.get(self.people[name], [])
            begin = _number(f"{self.seed}:{record}:{name}")
            free = next((x for k in range(len(pool)) if (x := pool[(begin + k) % len(pool)]) not in taken), None)
            if free is None:
                return None
            out[name] = free
            taken.add(free)
        return out

    def apply(self, record: str, source: str, target: str) -> tuple[str, str, str, dict[str, str]]:
        """Both sides, what became of the pair, and who is who now."""
        found = self.names.findall(source) if self.names else []
        if not found:
            return source, target, "no_name", {}
        if self.titled.search(source) or self.titled.search(target):
            return source, target, "behind_a_title", {}
        if Counter(found) != Counter(self.names.findall(target)):
            return source, target, "sides_differ", {}
        who = self.chosen(record, found)
        if who is None:
            return source, target, "pool_too_small", {}
        there = lambda m: who[m.group()]
        return self.names.sub(there, source), self.names.sub(there, target), "swapped", who


def swapped_names(pairs: DataFrame, people: DataFrame, pool: DataFrame, seed: str = "names-1", most: int = MOST_NAMES) -> DataFrame:
    """The pairs with both sides swapped, ``outcome`` and ``who`` (a map of names); the columns are id, source_text, target_text.

    ``people``: name, gender; ``pool``: gender, name. A pair is left as it is
    without a known name on its source side, with a name behind a title, where
    the sides don't have the same names as often, or where the pool has too few
    for its gender. Nobody in a pair gets a name that another has got. The same
    id and seed give the same names. Each name of both tables goes to every
    task once, however many rows have it; their size is checked. A null side is
    empty.
    """
    people = people.where("name <> ''").groupBy("name").agg(F.min(F.struct("gender"))["gender"].alias("gender"))
    pool = pool.where("name <> ''").select("gender", "name").distinct()
    size = people.agg(F.sum(F.char_length("name") + 100)).first()[0] or 0, pool.agg(F.sum(F.char_length("name") + 100)).first()[0] or 0
    if sum(size) > most:
        raise ValueError(f"the names take about {sum(size)} bytes of memory, more than {most}")
    known = {r["name"]: r["gender"] for r in people.select("name", "gender").collect()}
    by_gender: dict[str, list[str]] = {}
    for r in pool.orderBy("gender", "name").collect():
        by_gender.setdefault(r["gender"], []).append(r["name"])
    table = pairs.sparkSession.sparkContext.broadcast((known, by_gender))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = Swap(*table.value, seed)
        for batch in batches:
            ids, *sides = (batch.column(i).to_pylist() for i in range(3))
            made = [swap.apply(str(i), a or "", b or "") for i, a, b in zip(ids, *sides)]
            source, target, outcome, who = zip(*made) if made else ((), (), (), ())
            names = pa.array([list(w.items()) for w in who], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(source, pa.string()), pa.array(target, pa.string()), pa.array(outcome, pa.string()), names], ["id", "source_text", "target_text", "outcome", "who"])

    read = pairs.select("id", F.col("source_text").cast("string"), F.col("target_text").cast("string"))
    text = T.StringType()
    schema = T.StructType([read.schema["id"], *(T.StructField(c, text) for c in ("source_text", "target_text", "outcome")), T.StructField("who", T.MapType(text, text))])
    return read.mapInArrow(run, schema)
