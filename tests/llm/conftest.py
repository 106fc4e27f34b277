import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, fp string, raw int, kept string, shard string, label string, recipe int, marks string, tuple int, bytes string, found string"


def rows_of(texts):
    """Documents with the given (doc_id, text), and columns whose names the operators use inside."""
    return [(i, t, "en", "s", len(t or ""), 1, "x", 2, "y", "z", "l", 3, "m", 4, "b", "f") for i, t in texts]


PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the river bank"
HARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Hello World"), (6, "hello world"), (6, "hello world"), (None, "HELLO WORLD"), (None, None),
    (7, PROSE), (8, PROSE), (9, PROSE.replace("seven", "eight")), (10, "x" * 50_000), (11, "ab " * 30_000), (12, "é ß 漢字 🙂 " * 500), (13, "a\x00b c"),
    (14, (PROSE + ". ") * 300),
]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(rows_of(HARD), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    got = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(1, 15)] + [(None, 1, 1), (3, None, None), (3, 1, 0)]
    return spark.createDataFrame(got, "doc_id long, quality int, toxic int")
