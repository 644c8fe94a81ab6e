"""Number and text expressions."""

import pytest
from pyspark.sql import functions as F

from quaywork.functions import draws
from quaywork.functions.numbers import compact_money, fixed, money_text
from quaywork.functions.text import collated, natural_key


def values(spark, kind, rows, expression):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_money(spark):
    assert values(spark, "long", [0, 5, 123456, -123456, 100000000], money_text) == ["$0.00", "$0.05", "$1,234.56", "-$1,234.56", "$1,000,000.00"]


@pytest.mark.parametrize(("cents", "text"), [
    (99_999, "$999.99"), (100_000, "$1K"), (200_000, "$2K"), (250_000, "$2.5K"), (123_456, "$1.23K"), (999_900, "$10K"), (1_000_000, "$10.0K"), (1_234_500, "$12.3K"), (99_960_000, "$999.6K"), (99_995_000, "$1.00M"),
    (100_000_000, "$1.00M"), (123_900_000, "$1.24M"), (250_000_000_000, "$2.50B"), (-200_000, "-$2K"),
])
def test_compact_money(spark, cents, text):
    assert values(spark, "long", [cents], compact_money) == [text]


def test_fixed_places_round_the_exact_value(spark):
    assert values(spark, "double", [2.25, 2.35, 10.35, 0.05, -2.25, 1234.0, 99.75], lambda x: fixed(x, 1)) == ["2.3", "2.4", "10.3", "0.1", "-2.3", "1234.0", "99.8"]
    assert values(spark, "double", [0.125, 1.005, 2.675], lambda x: fixed(x, 2)) == ["0.13", "1.00", "2.67"]


def test_natural_order(spark):
    texts = ["a2", "a10", "A3", "é1", "e2", "b007", "b7x", f"c{10**25}", f"c{9 * 10**24}", ""]
    keys = dict(zip(texts, values(spark, "string", texts, natural_key), strict=True))
    assert sorted(texts, key=keys.get) == ["", "a2", "A3", "a10", "b007", "b7x", f"c{9 * 10**24}", f"c{10**25}", "é1", "e2"]


# In the order of the root collation at base strength, numbers by value: those on one line tie.
COLLATED = [
    [""], [" x"], ["_x"], ["-x"], [",x"], [";x"], [":x"], ["!x"], ["?x"], [".x"], ["'x"], ['"x'], ["(x)"], ["[x]"], ["{x}"], ["@x"], ["*x"], ["/x"], ["\\x"], ["&x"], ["#5"], ["%x"], ["`x"], ["^x"], ["+x"], ["<x"], ["=x"], [">x"], ["|x"], ["~x"], ["$1"],
    ["0", "00"], ["1a"], ["2"], ["9", "09"], ["10"], ["a", "A", "á", "Ä"], ["a 1"], ["a-1"], ["a.b"], ["a2", "A2", "á2"], ["a10"], ["ab"], ["B 1", "b 1"], ["B-1"], ["b1x"], ["b01y"], ["co op"], ["co-op"], ["coop", "COOP"], ["n", "ñ"], ["n~"], ["zebra2"], ["Zebra10"],
]


def test_collated_order(spark):
    import random

    texts = [(t, i) for i, line in enumerate(COLLATED) for t in line]
    random.Random(3).shuffle(texts)
    rows = spark.createDataFrame(texts, "t string, i int").withColumn("k", collated(F.col("t")))
    assert [r.i for r in rows.orderBy("k").collect()] == sorted(i for _, i in texts)
    assert rows.groupBy("k").agg(F.count("*").alias("n")).count() == len(COLLATED)


def mulberry(seed):
    """The generator, one draw after the other."""
    a = seed & 0xFFFFFFFF
    imul = lambda x, y: x * y & 0xFFFFFFFF
    while True:
        a = a + 0x6D2B79F5 & 0xFFFFFFFF
        t = imul(a ^ a >> 15, a | 1)
        t = (t + imul(t ^ t >> 7, t | 61) & 0xFFFFFFFF) ^ t
        yield t ^ t >> 14


@pytest.mark.parametrize("seed", [0, 1, 42, 0xFFFFFFFF, 20260315])
def test_draws_equal_the_sequential_generator(spark, seed):
    from itertools import islice

    one = list(islice(mulberry(seed), 3000))
    rows = spark.range(2500).select("id", draws.word(seed, F.col("id")).alias("w"), draws.between(seed, F.col("id"), -3, 8).alias("b"), draws.picked(seed, F.col("id"), ["x", "y", "z"]).alias("p"), draws.swaps(seed, F.col("id"), 9).alias("s"))
    got = rows.orderBy("id").collect()
    assert [r.w for r in got] == one[:2500]
    assert [r.b for r in got] == [x * 12 // 2**32 - 3 for x in one[:2500]]
    assert [r.p for r in got] == ["xyz"[x * 3 // 2**32] for x in one[:2500]]
    for r in got[::50]:
        order = list(range(9))
        for k, last in enumerate(range(8, 0, -1)):
            other = one[r.id + k] * (last + 1) // 2**32
            order[last], order[other] = order[other], order[last]
        assert r.s == order
