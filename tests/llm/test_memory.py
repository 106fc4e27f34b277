"""Memory of Python workers: JVM heap and workers share an executor's limit."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import chunk_dedup, packing, quality, simhash
from sparkloom.operators import prefix_join

_LEARN = """
import resource, random
from sparkloom.llm import packing
ids = packing.WordIds(packing.vocabulary())
draw = random.Random(5)
text = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(160_000)).encode()
ids.of([b"first words"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids.of([text])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_new_words_take_little_memory_beside_their_ids():
    """160,000 new words (1.3 MB); what is remembered of them takes about 24 MB."""
    root = Path(corpus_pipeline.__file__).parent
    out = subprocess.run([sys.executable, "-c", _LEARN], cwd=root, capture_output=True, text=True, check=True, timeout=100)
    assert int(out.stdout.split()[-1]) < 130


@pytest.mark.parametrize("n", [0, 1, packing.ENCODED, packing.ENCODED + 1])
def test_words_are_encoded_a_part_at_a_time(n):
    """Same ids as for each word alone, on both sides of a part's edge, with words of other characters between."""
    ids = packing.WordIds(packing.vocabulary())
    words = [b"w%s" % bytes(97 + int(c) for c in str(i)) if i % 7 else b"%d-x" % i for i in range(n)]
    alone = [np.array(ids.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert ids._encode(words) == alone
    assert ids.of([b" ".join(words), b"", words[-1] if words else b"x"])[0] == b"".join(alone)


def test_python_stages_give_back_what_they_freed(spark, hard, monkeypatch):
    """Every Python step of the pipeline's stages on texts is wrapped by ``frugal``."""
    seen, plain = [], type(hard).mapInArrow
    monkeypatch.setattr(type(hard), "mapInArrow", lambda self, func, *rest: (seen.append(func), plain(self, func, *rest))[1])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    quality.keep_good(hard, labels)
    chunk_dedup._decisions(hard)
    simhash.drop_near_duplicates(hard)
    corpus_pipeline.decontaminate.keep_clean(hard, spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string"))
    packing.pieces(hard)
    assert len(seen) >= 9
    assert [f.__qualname__ for f in seen if not hasattr(f, "__wrapped__")] == []


def test_repeated_shingles_are_counted(spark):
    texts = spark.createDataFrame([(1, "a b c a"), (2, "b c d"), (3, "e"), (4, ""), (5, "c")], "key long, text string").coalesce(1)
    number = lambda texts: [np.unique(np.array([ord(w) << 32 for w in t.decode().split()], np.uint64)) for t in texts]
    assert sorted(map(tuple, prefix_join._repeated(texts, number).collect())) == [(ord("b"), 2), (ord("c"), 3)]
    assert prefix_join._repeated(texts.limit(0), number).count() == 0
