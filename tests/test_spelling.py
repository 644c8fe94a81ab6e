"""Edit distances and spelling pairs against all pairs of words."""

import random

from pyspark.sql import functions as F

from quaywork.operators import spelling as sp


def plain_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def allowed(a, b):
    n = min(len(a), len(b))
    return 2 if n >= 9 else 1 if n >= 5 else 0


def edited(word, rnd):
    word = list(word)
    for _ in range(rnd.randrange(3)):
        i = rnd.randrange(len(word))
        what = rnd.randrange(4)
        if what == 0:
            word.insert(i, rnd.choice("abé"))
        elif what == 1 and len(word) > 1:
            del word[i]
        elif what == 2:
            word[i] = rnd.choice("abé")
        elif i:
            word[i - 1], word[i] = word[i], word[i - 1]
    return "".join(word)


def test_distances(spark):
    rnd = random.Random(1)
    pairs = [("abdc", "abcd"), ("ca", "abc"), ("", ""), ("", "ab"), ("abc", ""), ("a", "a"), (None, "a")] + [("".join(rnd.choice("abcé") for _ in range(rnd.randrange(9))), "".join(rnd.choice("abcé") for _ in range(rnd.randrange(9)))) for _ in range(150)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sp.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [None if r.a is None else plain_distance(r.a, r.b) for r in got]
    assert [r.d for r in got[:2]] == [1, 3]


def test_pairs_equal_all_pairs(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abé") for _ in range(n)) for n in (3, 4, 5, 5, 6, 8, 8, 9, 9, 10, 12, 22, 23, 24, 24, 25, 26, 26, 27, 28, 31, 60) for _ in range(2)]
    words = base + [edited(w, rnd) for w in base for _ in range(6)] + ["", None, "x", base[0]]
    distinct = sorted({w for w in words if w is not None})
    want = sorted((a, b, plain_distance(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if abs(len(a) - len(b)) <= 2 and 0 < plain_distance(a, b) <= allowed(a, b))
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, other int")
    assert sorted(map(tuple, sp.spelled_alike(frame).collect())) == want and len(want) > 100
    some, rest = distinct[::3], distinct[1::2]
    two = sp.spelled_alike(spark.createDataFrame([(w,) for w in some], "word string"), spark.createDataFrame([(w,) for w in rest], "word string"))
    assert sorted(map(tuple, two.collect())) == sorted((a, b, plain_distance(a, b)) for a in some for b in rest if a != b and abs(len(a) - len(b)) <= 2 and plain_distance(a, b) <= allowed(a, b))
    assert sp.spelled_alike(frame.where("false")).collect() == []


def test_phrases(spark):
    phrases = ["reorder piont", "reorder point", "re order", "unit cots", "aveage daily usge", "average daily usage", "unit", "quantty"]
    known = ["reorder point", "unit cost", "average daily usage", "quantity", "unit"]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "phrase string")
    got = sorted(map(tuple, sp.phrases_alike(frame(phrases), frame(known)).collect()))
    assert got == [("quantty", "quantity"), ("reorder piont", "reorder point")]
    assert sorted(map(tuple, sp.phrases_alike(frame(["aveage daily usage"]), frame(known)).collect())) == [("aveage daily usage", "average daily usage")]
