"""Name swaps: the guards by hand, and that a swap is the same every time."""

import pytest

from sparkloom.operators.names import Swap, swapped_names

PEOPLE = {"Tom": "m", "Tom Smith": "m", "Jerry": "m", "Ann": "f"}
POOL = {"m": ["Kham", "Thang", "Zam"], "f": ["Cing"]}


def test_guards():
    swap = Swap(PEOPLE, POOL, "s")
    outcome = lambda a, b: swap.apply("1", a, b)[2]
    assert outcome("nobody", "Tom") == "no_name" and outcome("Tom-and-Jerry, Tommy", "x") == "no_name"
    assert outcome("Dr. Tom came", "Tom hong pai") == "behind_a_title" and outcome("Tom came", "pastor Tom") == "behind_a_title"
    assert outcome("Tom saw Tom", "Tom") == "sides_differ" and outcome("Tom", "Jerry") == "sides_differ"
    assert Swap(PEOPLE, {"m": ["Kham"]}, "s").apply("1", "Tom Jerry", "Jerry Tom")[2] == "pool_too_small"
    assert Swap({}, POOL, "s").apply("1", "Tom", "Tom")[2] == "no_name"


def test_both_sides_alike_without_reuse():
    for seed in map(str, range(30)):
        source, target, outcome, who = Swap(PEOPLE, POOL, seed).apply("7", "Tom Smith and Tom and Jerry met Ann.", "Ann in Jerry, Tom le Tom Smith mu hi.")
        assert outcome == "swapped" and set(who) == {"Tom Smith", "Tom", "Jerry", "Ann"} and len(set(who.values())) == 4
        assert source == f"{who['Tom Smith']} and {who['Tom']} and {who['Jerry']} met {who['Ann']}." and target.startswith(f"{who['Ann']} in {who['Jerry']}, ")


def test_rows(spark):
    rows = [(1, "Tom ran", "Tom tai"), (2, None, None), (1, "Tom ran", "Tom tai")]
    df = spark.createDataFrame(rows, "id long, source_text string, target_text string")
    people, pool = (spark.createDataFrame(r, s) for r, s in (([(n, g) for n, g in PEOPLE.items()], "name string, gender string"), ([(g, n) for g, ns in POOL.items() for n in ns], "gender string, name string")))
    got = [tuple(r) for r in swapped_names(df, people, pool).orderBy("id").collect()]
    assert got[0] == got[1] and got[0][3] == "swapped" and got[0][4]["Tom"] in POOL["m"] and got[2][1:4] == ("", "", "no_name")


def test_many_rows_of_few_names(spark):
    """What goes to the tasks is as large as the names are, not as the tables: a name of many rows counts once."""
    df = spark.createDataFrame([(1, "Tom ran", "Tom tai")], "id long, source_text string, target_text string")
    people = spark.createDataFrame([("Tom", "m"), ("Tom", "x")] * 50, "name string, gender string")
    pool = spark.createDataFrame([("m", n) for n in POOL["m"]] * 50, "gender string, name string")
    assert swapped_names(df, people, pool, most=1000).first()["who"]["Tom"] in POOL["m"]
    with pytest.raises(ValueError):
        swapped_names(df, people, pool, most=100)
