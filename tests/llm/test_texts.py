"""Personal data, perspectives, repeats and decontamination against brute force."""

import hashlib
import os
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import decontaminate, perspectives, pii, repeats

from .conftest import HARD


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub("[ -]", "", v)) <= 19 and luhn(re.sub("[ -]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m.group())]


PII = [
    "mail a.b@c.de, a@b.c@d.e.f x@y @z.q a@b..c 漢字🙂 me+you@x-y.co.uk.", "ips 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3 9.9.9.9x",
    "cards 4111 1111 1111 1111 4111-1111-1111-1112 4103495397927849 1 2 3 12345678901234567890", "call +1 (339) 555-8607 +12 +1234567 +49.30.123456-78 + 1 ++12345678901 +1234567890123456",
    "+1 4111 1111 1111 1111", "5" * 5000, "a" * 5000 + "@", "a." * 3000 + "@b.c", "1.1." * 3000, "+1" * 3000, "(" * 5000, "1 " * 30000, "a@b.c" * 500, "\n@.\n", "é@é.é x@é.de",
]


def test_base_spans_against_brute_force(spark, hard):
    texts = PII + [t for _, t in HARD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(df)).collect()}
    for i, t in enumerate(texts):
        want, r = brute(t), got[i]
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in BASE] == want, t and t[:60]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want) for k in BASE]
    assert pii.find_personal_data(hard).count() == len(HARD)


def test_many_spans_in_one_text(spark):
    texts = ["a@b.c " * 100_000, "1.2.3.4 +1 339 555 8607 x" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    began = time.monotonic()
    got = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(df)).collect()}
    assert time.monotonic() - began < 30
    for i, t in enumerate(texts):
        assert got[i]["spans"].split(",") == brute(t) and got[i]["n_spans"] == len(brute(t))


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB82WEST12345698765433", "phone: (212) 555-0100", "(212) 555-0100", "tel +1 (212) 555-0100"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: [(s["kind"], s["value"]) for s in r[1] if s["kind"] not in BASE] for r in pii.find_personal_data(df).collect()}
    assert got == {0: [("iban", "GB82 WEST 1234 5698 7654 32")], 1: [], 2: [("local_phone", "(212) 555-0100")], 3: [], 4: []}


def test_pii_empty(nothing):
    assert pii.digest(pii.find_personal_data(nothing)).count() == 0


def test_perspectives_by_hand(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, None, " ", "x"), (3, 70, "ann", "late"), (3, 1, "bob", "b"), (3, 1, "bob", "b")]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "conv_id long, turn long, role string, text string, segment int, participant string")
    got = {(r["conv_id"], r["participant"], r["segment"]): r for r in perspectives.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0), (3, "ann", 0), (3, "bob", 0)}
    bob = got[1, "bob", 0]
    assert bob["rendered"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    )
    s, e = map(int, bob["mask"].split(":"))
    assert bob["rendered"][s:e] == "yo<|im_end|>\n" and bob["n_masked"] == e - s
    assert got[1, "ann", 0]["n_own"] == 2 and got[3, "bob", 0]["n_messages"] == 3 and got[3, "bob", 0]["n_own"] == 2
    assert perspectives.rotate(df.limit(0)).count() == 0


def test_perspectives_bound_their_rows(spark):
    """Null, equal and repeated turns: no row holds over 64 messages, none is lost, a very long text stays whole."""
    rows = [(1, None, "ann", f"m{i}") for i in range(150)] + [(2, 5, "bob", "same")] * 130 + [(None, 1, None, "x" * 300_000), (None, None, "ann", None)]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "conv_id long, turn long, role string, text string, nth int, mid int, conv_key string").repartition(3)
    got = perspectives.rotate(df).collect()
    assert max(r["n_messages"] for r in got) <= 64
    assert Counter((r["conv_id"], r["participant"]) for r in got) == {(1, "ann"): 3, (2, "bob"): 3, (None, "ann"): 1, (None, "unknown"): 1}
    assert sum(r["n_messages"] for r in got if r["conv_id"] == 1) == 150 and sum(r["n_own"] for r in got if r["conv_id"] == 2) == 130
    said = "".join(r["rendered"] for r in sorted(got, key=lambda r: r["segment"]) if r["conv_id"] == 1)
    assert sorted(re.findall(r"assistant\n(m\d+)<", said)) == sorted(f"m{i}" for i in range(150))
    assert max(r["n_masked"] for r in got) == 300_000 + len(perspectives.CLOSE)


def brute_repeats(texts, n=400):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def repeat_texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijé ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(90) for _ in range(4)]
    texts = []
    for _ in range(40):
        t = prose(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 3)
            t += " " + p[a : a + rng.randint(300, 560)] + " " + prose(rng.randint(0, 60))
        texts.append(t)
    # Passages of 51 words, under 400 bytes, between other words, at ends, and glued to a word.
    few = " ".join(rng.choice("abcdef") * rng.randint(3, 8) for _ in range(51))
    texts += [f"{prose(20)} {few} {prose(30)}", f"{few}\n{prose(30)}", f"{prose(30)}\t{few}", few, f"{prose(9)} x{few}", f"{prose(9)} {few}y {prose(3)}"]
    texts += [f"{few[60:200]} {prose(4)} {few} {prose(k)}" for k in range(12)]
    return [*texts, "ab" * 700, "ab" * 300 + "c" + "ab" * 400, "x" * 5000, "x" * 399, "x" * 400, "Of " * 300, "", None, texts[3], texts[3], texts[5][:500] + "!" + texts[5][500:]]


def brute_passages(texts, n=50):
    """Strings of 50 whole words, of 256 to 399 bytes, that occur as whole words twice; with the 400-byte strings."""
    long = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    found, count = [], Counter()
    for k, t in enumerate(texts):
        words = list(re.finditer(rb"[^\x20\x09-\x0D]+", t))
        for a, b in zip(words, words[n - 1 :]):
            if 256 <= b.end() - a.start() < 400:
                found.append((k, a.start(), b.end()))
                count[t[a.start() : b.end()]] += 1
    out = []
    for k, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if long[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        for j, a, b in found:
            if j == k and count[t[a:b]] > 1:
                gone[a:b] = b"\1" * (b - a)
        out.append((sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), sum(gone)))
    return out


@pytest.mark.parametrize("options", [{}, {"per_lot": 7}, {"together": 1}, {"together": 3}])
def test_repeats_against_brute_force(spark, options):
    texts = repeat_texts(sum(options.values()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(df, **options).collect()}
    raw = [(t or "").encode() for t in texts]
    assert got == {i: (*a, *b) for i, (a, b) in enumerate(zip(brute_repeats(raw), brute_passages(raw)))}


@pytest.mark.parametrize("options", [{"together": 3}, {"together": 3, "per_lot": 7}])
def test_repeats_of_one_kind_at_a_crowded_anchor(spark, options):
    """Texts that begin alike, at an anchor that many other texts have beside other words."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    pool = np.frombuffer(noise(500_000).encode(), np.uint8)
    least = int(repeats.gram_hashes(pool).argmin())
    gram = pool[least : least + repeats.GRAM].tobytes().decode()
    twice = noise(100) + gram + noise(600)
    texts = [noise(300) + gram + noise(300) for _ in range(12)] + [twice + noise(70), twice + noise(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:5] for r in repeats.remove_repeats(df, **options).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts])))


def test_repeats_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    raw = [(r[1] or "").encode() for r in rows]
    want = {r[0]: (*a, *b) for r, a, b in zip(rows, brute_repeats(raw), brute_passages(raw))}
    assert {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(docs).collect()} == want


def test_repeats_hard_and_empty(hard, nothing):
    assert repeats.remove_repeats(hard).count() == len(HARD)
    assert repeats.remove_repeats(nothing).count() == 0


def test_run_index_matching_statistics():
    rng = random.Random(3)
    rows = [(g, bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))), bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9)))) for g in range(3) for _ in range(25)]
    rows = sorted(set(rows))
    copies = np.array([2 if i % 17 == 0 else 1 for i in range(len(rows))])
    pad = lambda x, n: [*x, *[256] * (n - len(x))]
    left = np.array([pad(r[1][::-1], 9) for r in rows], np.uint16)
    right = np.array([pad(r[2], 9) for r in rows], np.uint16)
    index = repeats.RunIndex(np.array([r[0] for r in rows]), left, right, copies)
    got = index.matching_statistics()
    for i, (g, back, on) in enumerate(rows):
        for a in range(len(back) + 1):
            own = back[len(back) - a :] + on
            best = len(own) if copies[i] > 1 else 0
            for j, (h, b, o) in enumerate(rows):
                if i != j and g == h and a <= len(b):
                    best = max(best, len(os.path.commonprefix([own, b[len(b) - a :] + o])))
            assert got[i, a] == best
    assert index.runs < left.size


def brute_leaks(docs, items):
    found = set()
    for d, t in docs:
        words = decontaminate.words_of((t or "").encode())
        seen = {n: decontaminate.shingles(words, n) for n in range(1, 6)}
        for i, x in items:
            asked = decontaminate.words_of((x or "").encode())
            width = min(5, len(asked))
            own = decontaminate.shingles(asked, width) if asked else set()
            if own and len(own & seen[width]) >= 0.8 * len(own):
                found.add((d, i))
    return found


def test_one_index_or_many_give_equal_scores(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    long = spark.createDataFrame([(10_000 + i, " ".join(f"w{j % (97 + i)}" for j in range(900))) for i in range(3)], "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.contaminated(docs, items.unionByName(long), m).collect())) for m in (1 << 30, 3_000_000))
    assert one and one == many


def test_short_items_and_memory(spark):
    items = spark.createDataFrame([(1, "Red fox!"), (2, "fox"), (3, "one two three four"), (4, "?!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a red, FOX ran"), (2, "fox red"), (3, "one two three five four"), (4, "x one two three four y")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (4, 3)}
    texts = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select("item_id", "text").collect()]
    texts += [(10_000 + i, " ".join(f"word{i}x{j}" for j in range(300))) for i in range(200)]
    tracemalloc.start()
    index = decontaminate.Index.build(texts)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(index.items) == len(texts)
    assert taken <= sum(decontaminate.memory_of(len(t.split()), len(t.encode())) for _, t in texts)


@pytest.mark.parametrize("index_memory", [256 << 20, 700_000])
def test_decontamination_against_brute_force(spark, sf_dir, index_memory):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items, index_memory).collect()}
    assert got == brute_leaks([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], [(r[0], r[1]) for r in items.select("item_id", "text").collect()])
    kept = {r[0] for r in decontaminate.keep_clean(docs, items, index_memory).select("doc_id").collect()}
    assert kept == {r[0] for r in docs.select("doc_id").collect()} - {d for d, _ in got}


def test_decontamination_edges(spark, hard, nothing):
    items = spark.createDataFrame([(1, None), (2, "one"), (3, HARD[9][1]), (3, HARD[9][1]), (None, HARD[9][1]), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(hard, items).collect()}
    # Document 9 has one word changed, which takes five of nineteen shingles.
    assert got == {(d, i) for d in (7, 8, 14) for i in (3, None)} | {(4, 2)}
    assert decontaminate.contaminated(nothing, items).count() == 0 and decontaminate.contaminated(hard, items.limit(0)).count() == 0
    kept = decontaminate.keep_clean(hard, items)
    assert kept.columns == hard.columns and kept.count() == len(HARD) - 4


def test_block_max_prunes_but_finds():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(60)]
    index = decontaminate.Index.build(items)
    for i, t in items:
        noise = " ".join(rng.choice(words) for _ in range(rng.randint(0, 300)))
        assert i in {m[0] for m in index.matches(f"{noise} {t.upper()}, {noise}".encode())}


def test_a_changed_word_hides_no_item_at_any_place(spark):
    items = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select("item_id", "text").collect()]
    index = decontaminate.Index.build(items)
    tried = missed = 0
    for i, t in items:
        words = decontaminate.words_of(t.encode())
        own = decontaminate.shingles(words)
        for p in range(len(words)):
            changed = [*words[:p], b"zzqx", *words[p + 1 :]]
            if len(own & decontaminate.shingles(changed)) >= 0.8 * len(own):
                tried += 1
                missed += i not in {m[0] for m in index.matches(b" ".join(changed))}
    assert tried > 5000 and missed == 0, (tried, missed)
