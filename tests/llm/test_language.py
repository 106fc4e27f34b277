"""Character models against plain Kneser-Ney, and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import language

from .conftest import HARD

TEXTS = {
    "en": ["the cat sat on the mat, and the dog ran!", "a man and the other men", "THE END of the day 12 times"],
    "de": ["der Hund und die Katze über Straße", "und das Ende der Welt", "die Männer der Stadt"],
    "xx": ["漢字 仮名 漢字", "仮名漢字"],
}


def training(copies=4):
    rows, i = [], 0
    for lang, texts in TEXTS.items():
        for text in texts * copies:
            i += 1
            rows.append((i, text, lang))
    return rows


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


class Plain:
    """Interpolated Kneser-Ney as in the book, with dictionaries."""

    def __init__(self, texts, letters):
        self.uniform = 1 / letters
        self.levels = {5: Counter()}
        for t in texts:
            s = self.clean(t)
            self.levels[5].update(s[i - 4 : i + 1] for i in range(4, len(s)))
        for k in range(4, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.cut, self.all, self.kinds = {}, defaultdict(float), Counter()
        for k, grams in self.levels.items():
            once, twice = (sum(n == c for n in grams.values()) for c in (1, 2))
            self.cut[k] = min(0.95, once / (once + 2 * twice)) if once and twice else 0.5
            for g, n in grams.items():
                self.all[k, g[:-1]] += n
                self.kinds[k, g[:-1]] += 1

    @staticmethod
    def clean(text):
        words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
        return "    " + "".join(w + " " for w in words)

    def p(self, gram):
        if not gram:
            return self.uniform
        k, below = len(gram), self.p(gram[1:])
        total = self.all.get((k, gram[:-1]))
        if not total:
            return below
        n = self.levels[k].get(gram, 0)
        return max(n - self.cut[k], 0) / total + self.cut[k] * self.kinds[k, gram[:-1]] / total * below

    def entropy(self, text):
        s = self.clean(text)
        return -sum(math.log(self.p(s[i - 4 : i + 1])) for i in range(4, len(s))) / (len(s) - 4)


ASKED = ["the men und die dog", "漢字", "completely Unseen žluťoučký", "Ende", "a", "x" * 50, "the " * 3000]


@pytest.fixture(scope="module")
def learnt(spark):
    return language.fit(spark.createDataFrame(training(), "doc_id long, text string, lang string"))


def test_against_plain_models(spark, learnt):
    rows = [r for r in training() if fold(r[0])]
    letters = len({c for _, t, _ in rows for c in Plain.clean(t)}) + 1
    plain = {x: Plain([t for _, t, lang in rows if lang == x], letters) for x in sorted(TEXTS)}
    assert learnt.languages == sorted(TEXTS)
    docs = spark.createDataFrame(list(enumerate(ASKED)), "doc_id long, text string")
    for r in language.cross_entropies(docs, learnt).collect():
        assert r["h"] == pytest.approx([m.entropy(ASKED[r["doc_id"]]) for m in plain.values()], rel=1e-9)
    got = {r["doc_id"]: r for r in language.identify(docs, learnt).collect()}
    for i, t in enumerate(ASKED):
        assert got[i]["lang_pred"] == min(plain, key=lambda x: plain[x].entropy(t))
        assert 0 <= got[i]["score"] <= 1


def test_models_in_slices_are_the_same(spark, learnt):
    small = language.fit(spark.createDataFrame(training(), "doc_id long, text string, lang string"), memory=5000)
    assert len(small.slices) >= 3
    docs = spark.createDataFrame([*enumerate(ASKED), (1, "漢字"), (None, None), (None, None)], "doc_id long, text string")
    one, many = (sorted((r["doc_id"] or -1, r["n"], [x and round(x, 9) for x in r["h"]]) for r in language.cross_entropies(docs, m).collect()) for m in (learnt, small))
    assert one == many and len(one) == len(ASKED) + 3
    assert (learnt.slope, learnt.offset) == pytest.approx((small.slope, small.offset))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got[~got["rejected"]].eval("lang == lang_pred").mean() > 0.98
    assert 0 <= got["score"].min() and got["score"].max() <= 1


def test_hard_rows(spark, hard, nothing):
    got = language.identify(hard).collect()
    assert len(got) == len(HARD)
    for r, (_, text) in zip(sorted(got, key=lambda r: r["doc_id"] or -1), sorted(HARD, key=lambda h: h[0] or -1)):
        assert r["doc_id"] is None or (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert language.identify(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "a", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in language.identify(unlabelled).collect()] == [("und", 0.0, True)] * 2
