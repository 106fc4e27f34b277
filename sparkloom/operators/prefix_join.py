"""Groups of texts whose sets of shingles are similar, by an exact prefix-filter join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hash_counts import REST, bits_for, buckets_for, counted_hashes, marked, marks, unpacked, unpacked_numbers
from .lineage import checkpointed
from .memory import frugal

#: Makes the sorted, distinct 64-bit hashes of each text's shingles.
Hasher = Callable[[list[bytes]], list[np.ndarray]]

#: Shingles told apart as frequent, at most; a plan choice, for any order of shingles gives the same pairs.
FREQUENT = 1 << 20
#: Shingles that a task counts at once.
COUNTED = 1 << 21
#: Bits of the filter that knows what shingles several texts have, at most, as a power of two, 64 MB; with fewer it takes more others for such.
MOST_BITS = 29
#: Texts that have a shingle in their prefixes, up to which each meets each before anything travels on.
SMALL = 24
#: Bytes of texts that are worked on at once.
TOGETHER = 2 << 20
#: Rows of a frequent shingle that are grouped together.
PER_SALT = 1 << 14
#: Rows up to which a list of keys is broadcast.
BROADCAST_ROWS = 1 << 17
_SLACK = 1e-6


def _sets(batch: pa.RecordBatch, hasher: Hasher, seen: set[int]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Keys and sets of a batch of (key, text), a few megabytes of text at a time; of a task's equal texts the first one."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
    keys, k = batch.column(0).to_pylist(), 0
    while k < batch.num_rows:
        m = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + TOGETHER, "right")))
        fresh = [i for i, key in enumerate(keys[k:m], k) if not (key in seen or seen.add(key))]
        texts = batch.column(1).take(pa.array(fresh, pa.int64())).fill_null("").cast(pa.large_binary())
        yield batch.column(0).take(pa.array(fresh, pa.int64())), hasher(texts.to_pylist())
        k = m


class Order:
    """What a task needs to put shingles in one order for all: first those that one text has, then the others, the frequent ones last.

    Shingles are told apart by their upper bits. Two that share these share a
    place, for all texts alike. ``tokens`` are the frequent ones, sorted, and ``counts`` about how many texts have them.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, shift: int, marks: bytes, bits: int):
        self.tokens, self.counts, self.shift, self.marks, self.bits = tokens, counts, shift, marks, bits

    def often(self, shingles: np.ndarray) -> np.ndarray:
        """-1 for a shingle that no two texts have, the number of texts for a frequent one, else 0."""
        found = marked(np.frombuffer(self.marks, np.uint8), shingles, self.bits).astype(np.int64) - 1
        if len(self.tokens):
            asked = shingles >> np.uint64(self.shift)
            at = np.minimum(np.searchsorted(self.tokens, asked), len(self.tokens) - 1)
            found = np.where(self.tokens[at] == asked, self.counts[at], found)
        return found


def _counted(texts: DataFrame, hasher: Hasher, buckets: int) -> DataFrame:
    """Shingles that several texts of all have, by their upper bits, see ``counted_hashes``."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch, hasher, seen):
                yield np.concatenate([*sets, np.zeros(0, np.uint64)])

    return counted_hashes(texts, hashes, 2, buckets, COUNTED)


def _bins(n: np.ndarray) -> np.ndarray:
    return np.floor(4 * np.log2(n)).astype(np.int64)


def _listed(counted: DataFrame, least: int = 0) -> DataFrame:
    """token and n: the upper bits of counted shingles from a bin on, and how many texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, rest, uses in zip(*[c.to_pylist() for c in batch.columns]):
                n = unpacked_numbers(uses)
                told = _bins(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array((bucket << REST) + unpacked(rest)[told].astype(np.int64)), pa.array(n[told])], ["token", "n"])

    return counted.select("bucket", "hashes", "uses").mapInArrow(frugal(run), "token long, n long")


def _repeated(texts: DataFrame, hasher: Hasher) -> DataFrame:
    """token and n: the upper 32 bits of shingles that several texts have, with how many."""
    return _listed(_counted(texts, hasher, 32 - REST))


def _order(texts: DataFrame, hasher: Hasher, most: int, buckets: int) -> Order:
    """Of all shingles; at most ``most`` frequent ones are told apart, and a bounded filter knows those that several texts have, so both go to all tasks."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uses in batch.column(0).to_pylist():
                held = np.bincount(_bins(unpacked_numbers(uses)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held.astype(np.int64))], ["bin", "of"])

    counted = _counted(texts, hasher, buckets)
    least, held = 1 << 10, 0
    for row in sorted(counted.select("uses").mapInArrow(frugal(binned), "bin long, of long").groupBy("bin").agg(F.sum("of").alias("of")).collect(), reverse=True):
        held += row["of"]
        if held > most:
            break
        least = row["bin"]
    found = _listed(counted, least).toArrow()
    token, n = found["token"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    order = np.argsort(token)
    bits = max(buckets + 3, min(MOST_BITS, bits_for(counted, buckets, 4)))
    return Order(token[order], n[order], 64 - buckets - REST, marks(counted, buckets, bits, range(1 << buckets)), bits)


def prefix(n: int, threshold: float) -> int:
    """How many of a set's first shingles a similar set can't lack altogether."""
    return n - int(np.ceil(threshold * n - _SLACK)) + 1


def _may_meet(one: tuple[str, str], two: tuple[str, str], threshold: float) -> Column:
    """Whether sets of given sizes whose first common shingle stands at given places can be similar; names of (size, place)."""
    (n, p), (m, q) = one, two
    shared = F.ceil((F.col(n) + F.col(m)) * (threshold / (1 + threshold)) - _SLACK)
    sizes = F.least(n, m) >= threshold * F.greatest(n, m) - _SLACK
    return sizes & (F.col(n) - F.col(p) >= shared) & (F.col(m) - F.col(q) >= shared)


#: Rows of shingles that several texts have in their prefixes; first, fn, fp are of the least key in the group of token and salt.
_MET = "token long, salt int, key long, n int, p int, first long, fn int, fp int"


def _met(texts: DataFrame, hasher: Hasher, threshold: float, least: int, order: Order) -> DataFrame:
    """Prefixes of all texts, grouped by shingle, without those that only one text has, nor those of small groups that are similar to none there."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = shared.value
        seen: set[int] = set()
        for batch in batches:
            for keys, sets in _sets(batch, hasher, seen):
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                often = ordered.often(flat)
                chosen, ends, kept = [], np.cumsum([0, *map(len, sets)]), []
                for i, s in enumerate(sets):
                    if len(s) < max(1, least):
                        continue
                    order = np.argsort(often[ends[i] : ends[i + 1]], kind="stable")[: prefix(len(s), threshold)]
                    chosen.append(order + ends[i])
                    kept.append(i)
                if not kept:
                    continue
                sizes = np.fromiter(map(len, chosen), np.int64, len(chosen))
                key = np.repeat(keys.to_numpy()[kept], sizes)
                place = np.concatenate(chosen)
                salt = np.where(often[place] > PER_SALT, 1 + (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % (1 + np.maximum(often[place], 0) // PER_SALT).astype(np.uint64), 0)
                n = np.repeat(np.fromiter((len(sets[i]) for i in kept), np.int64, len(kept)), sizes)
                p = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                several = often[place] >= 0
                columns = [flat[place].view(np.int64), salt.astype(np.int32), key, n.astype(np.int32), p.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in columns], ["token", "salt", "key", "n", "p"])

    rows = texts.mapInArrow(frugal(prefixes), "token long, salt int, key long, n int, p int")
    return checkpointed(rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "key").mapInArrow(frugal(lambda batches: _that_meet(_grouped(batches), threshold)), _MET))


def _that_meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Grouped rows without those that can't be similar to any other of their group, where that is small and its rows came together."""
    for batch in batches:
        token, salt, _, n, p = [c.to_numpy().astype(np.int64) for c in batch.columns[:5]]
        begins = np.append(np.ones(min(1, len(token)), bool), (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
        group = np.cumsum(begins) - 1
        sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        meets = (sizes[group] > SMALL) | (salt > 0)
        if len(group):
            meets |= (group == 0) | (group == group[-1])
        for d in range(1, min(SMALL, len(token))):
            shared = np.ceil((n[d:] + n[:-d]) * (threshold / (1 + threshold)) - 2 * _SLACK)
            may = (group[d:] == group[:-d]) & (np.minimum(n[d:], n[:-d]) >= threshold * np.maximum(n[d:], n[:-d]) - 2 * _SLACK)
            may &= (n[d:] - p[d:] >= shared) & (n[:-d] - p[:-d] >= shared)
            meets[d:] |= may
            meets[:-d] |= may
        yield batch.filter(pa.array(meets))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the first of their group; groups of one row are left out unless they are a part of a frequent shingle's.

    The last row waits for the next batch, so that is all that is kept between batches, with its group's first.
    """
    names = [c.split()[0] for c in _MET.split(", ")]
    waiting: list[np.ndarray] | None = None  # the last row, its first, and whether it began its group

    def given(rows: list[np.ndarray], chosen: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[chosen]) for c in rows[:8]], names)

    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if not len(rows[0]):
            continue
        if waiting:
            rows = [np.concatenate([w, c]) for w, c in zip(waiting, rows)]
        same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        fresh = np.append(True, ~(same & (rows[2][1:] == rows[2][:-1])))  # a text that is there twice counts once
        rows = [c[fresh] for c in rows]
        same = np.append(False, (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1]))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        firsts, begins = [rows[k][first] for k in (2, 3, 4)], ~same
        if waiting:
            older = first == 0
            firsts = [np.where(older, w, f) for w, f in zip(waiting[5:8], firsts)]
            begins[0] = waiting[8][0]
        rows += [*firsts, begins]
        alone = begins & np.append(begins[1:], True) & (rows[1] == 0)
        yield given(rows, np.append(~alone[:-1], False))
        waiting = [c[-1:] for c in rows]
    if waiting and not (waiting[8][0] and waiting[1][0] == 0):
        yield given(waiting, np.ones(1, bool))


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _to_first(met: DataFrame, threshold: float) -> DataFrame:
    """Every text with up to four texts of its shingles' groups: the two least firsts, and the two hubs.

    A hub is the text of a group that has the largest share of its prefix in
    common with others: copies of one text share more with it than with each
    other. This is to connect most of what is similar by a few pairs a text;
    who isn't connected meets in ``_between``.
    """
    direct = met.where(_may_meet(("n", "p"), ("fn", "fp"), threshold)).select(F.col("key").alias("a"), F.lit(0.0).alias("share"), F.col("first").alias("b"))
    # Of a frequent shingle the groups' firsts meet the first of them.
    parts = met.where("salt > 0 AND key = first").select("token", "key", "n", "p")
    least = parts.groupBy("token").agg(F.min(F.struct("key", "n", "p")).alias("f")).select("token", F.col("f.key").alias("first"), F.col("f.n").alias("fn"), F.col("f.p").alias("fp"))
    across = parts.join(least, "token").where(_may_meet(("n", "p"), ("fn", "fp"), threshold)).select(F.col("key").alias("a"), F.lit(0.0).alias("share"), F.col("first").alias("b"))
    shares = met.groupBy("key").agg((F.count("*") / F.first("n")).alias("share"))
    rows = met.select("token", "key", "n", "p").join(shares, "key")
    hubs = rows.groupBy("token").agg(F.max(F.struct("share", "key", "n", "p")).alias("h")).select("token", F.col("h.share").alias("hub_share"), F.col("h.key").alias("first"), F.col("h.n").alias("fn"), F.col("h.p").alias("fp"))
    to_hub = rows.join(hubs, "token").where(_may_meet(("n", "p"), ("fn", "fp"), threshold)).select(F.col("key").alias("a"), F.col("hub_share").alias("share"), F.col("first").alias("b"))
    met_first = direct.unionByName(across).unionByName(to_hub).where("a <> b").groupBy("a").agg(F.collect_set(F.struct((-F.col("share")).alias("less"), "b")).alias("firsts"))
    named = lambda firsts: F.transform(firsts, lambda x: x["b"])
    hub, first = F.filter("firsts", lambda x: x["less"] < 0), F.filter("firsts", lambda x: x["less"] >= 0)
    chosen = F.array_distinct(F.concat(F.slice(F.array_sort(named(first)), 1, 2), F.slice(named(F.array_sort(hub)), 1, 2)))
    return _distinct(met_first.select("a", F.explode(chosen).alias("b")))


def _between(met: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """Pairs of texts that have a shingle in common and aren't connected.

    Of two texts that aren't, one is outside the shingle's commonest group;
    these rows meet all others, so a large group never meets itself. The
    smaller text of a pair has the shingle earlier than the larger one may.
    """
    rows = met.select("token", "key", "n", "p").join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    early = F.col("n") - F.col("p") >= F.ceil(2 * threshold / (1 + threshold) * F.col("n") - _SLACK)
    rows = checkpointed(rows.withColumn("early", early))
    by_root = rows.groupBy("token", "root").agg(F.count("*").alias("of"), F.max("early").alias("early"))
    mixed = by_root.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("of", "root")).alias("most"), F.max("early").alias("early"))
    mixed = mixed.where("roots > 1 AND early").select("token", F.col("most.root").alias("major"))
    rows = checkpointed(rows.join(mixed, "token"))
    outside = rows.where("root <> major").select("token", *[F.col(c).alias(f"{c}a") for c in ("key", "n", "p", "root", "early")])
    others = rows.select("token", *[F.col(c).alias(f"{c}b") for c in ("key", "n", "p", "root", "early")])
    # What only a large crowd has late in its prefixes meets the few that have it early.
    met_each = outside.where("earlya").join(others, "token").unionByName(outside.where("NOT earlya").join(others.where("earlyb"), "token"))
    close = met_each.where("roota <> rootb").where(_may_meet(("na", "pa"), ("nb", "pb"), threshold))
    return _distinct(close.select(F.col("keya").alias("a"), F.col("keyb").alias("b")))


def _needed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that are in a pair."""
    needed = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    return texts.join(F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed, "key", "left_semi")


def _packed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """key and the compressed text of what is in a pair, each once, written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            found = [pack((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["key", "packed"])

    chosen = _needed(texts, pairs).mapInArrow(frugal(run), "key long, packed binary")
    return checkpointed(chosen.groupBy("key").agg(F.first("packed").alias("packed")))


def _sketch(tokens: np.ndarray) -> bytes:
    """A bit for each of two to four places a shingle, at least 64, set if an odd number of shingles fall there."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    at = (tokens ^ (tokens >> np.uint64(32))) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _differ_at_least(one: bytes, two: bytes) -> int:
    """How many shingles are in one of two sets only, at least: the bits that differ, the longer sketch folded to the other's length."""
    x, y = sorted((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _plausible(pairs: DataFrame, texts: DataFrame, hasher: Hasher, threshold: float) -> DataFrame:
    """The pairs that sketches of their sets don't rule out, written out; none that reaches the threshold is lost.

    Sketches are a small part of the texts' size, and no set is made more than once for them.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for keys, sets in _sets(batch, hasher, seen):
                yield pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int32()), pa.array(list(map(_sketch, sets)), pa.binary())], ["key", "n", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (1 - threshold) / (1 + threshold) * (batch.column(2).to_numpy() + batch.column(4).to_numpy()) + _SLACK
            least = [_differ_at_least(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(np.array(least, np.int64) <= most))

    made = checkpointed(_needed(texts, pairs).mapInArrow(frugal(sketches), "key long, n int, sketch binary").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    left, right = made.toDF("a", "na", "sa"), made.toDF("b", "nb", "sb")
    return checkpointed(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(frugal(run), "a long, b long"))


def _verified(pairs: DataFrame, texts: DataFrame, hasher: Hasher, threshold: float) -> DataFrame:
    """The pairs whose sets reach the threshold, written out. Of pairs that sketches leave, compressed texts travel: the sets are larger."""
    pairs = _plausible(pairs, texts, hasher, threshold)
    packed = _packed(texts, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                # Each text's set is made once: many pairs have their second text in common.
                there = dict(zip([*part.column(0).to_pylist(), *part.column(1).to_pylist()], [x for c in (2, 3) for x in part.column(c)]))
                sets = dict(zip(there, hasher([unpack(x.as_buffer()) for x in there.values()])))
                keep = []
                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    x, y = sets[a], sets[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= threshold * (len(x) + len(y) - both) - _SLACK)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = packed.toDF("a", "pa"), packed.toDF("b", "pb")
    return checkpointed(pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(frugal(run), "a long, b long"))


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs whose texts aren't connected yet."""
    one, two = linked.toDF("a", "roota"), linked.toDF("b", "rootb")
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("roota", "a") != F.coalesce("rootb", "b")).select("a", "b")


def similar_groups(
    texts: DataFrame, hasher: Hasher, threshold: float, least: int = 1, frequent: int = FREQUENT, proposed: DataFrame | None = None
) -> DataFrame:
    """(node, root): every text that is similar to another, by key, with the least key it is connected to, itself if there is none less.

    ``texts`` has key (long, one of equal texts) and text. Texts are similar if
    the Jaccard similarity of the sets that ``hasher`` makes reaches
    ``threshold``; sets of fewer than ``least`` shingles are similar to none.

    The join is exact, with no limit on how many texts share a shingle. Shingles
    are ordered, the frequent ones last; of two similar sets the first common
    shingle stands so early in both that enough can follow, so only those
    places, a set's prefix, are looked at. In the groups of texts that share
    such a shingle first each meets the group's first, which connects crowds of
    copies by a pair a text; then those meet that aren't connected. Every pair
    that meets is verified. ``frequent`` bounds how many shingles are told
    apart as frequent; fewer or none change the work alone.

    ``proposed`` has pairs (a, b) that another method found. They are verified
    first; what they connect isn't compared again, what they lack is found by
    the join.
    """
    texts = texts.select(F.col("key").cast("long").alias("key"), F.col("text").alias("text"))
    known = None if proposed is None else components(_verified(checkpointed(_distinct(proposed)), texts, hasher, threshold))
    met = _met(texts, hasher, threshold, least, _order(texts, hasher, frequent, buckets_for(texts)))
    first = _to_first(met, threshold)
    found = _verified(checkpointed(first if known is None else _apart(first, known)), texts, hasher, threshold)
    linked = components(found if known is None else found.unionByName(known.toDF("a", "b")))
    left = checkpointed(_between(met, linked, threshold))
    if not left.isEmpty() and not (more := _verified(left, texts, hasher, threshold)).isEmpty():
        # Earlier components count as the stars they are, so few steps are left.
        linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
