import random

import pytest

from quaywork.llm import ngram_join as nj
from quaywork.llm.components import connected_components
from quaywork.llm.ngram_join import light_boundary, need, ngram_join, one_of_each


def brute(rows, width, percent):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else ([tuple(words)] if words else [])
        sets[doc_id] = set(grams)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * union:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def texts(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "Éa éa"), (6, "éa éa")]
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 6, 8, 10, 12, 15, 18, 40, 120]))]
        for _ in range(rnd.randrange(1, 7)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                copy = copy[: max(1, len(copy) - rnd.randrange(3))]
            rows.append((len(rows), (" " if rnd.random() < 0.5 else "\n").join(copy)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_groups_equal_those_of_all_pairs(spark, seed, width, percent):
    rows = texts(seed)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)


def test_boundary_weighs_both_costs():
    assert light_boundary({7: 100, 12: 100}, 85) >= 12
    assert light_boundary({25: 100}, 85) < 25
    assert need(100, 100, 85) == 92


def test_edges(spark):
    schema = "text string, doc_id long, shingles int, component long, key string"
    none = spark.createDataFrame([], schema)
    assert ngram_join(none).collect() == []
    rows = [("a b c d e f", 5, 1, 1, "x"), ("a b c d e f", 3, 1, 1, "x"), ("a b c d e f", 3, 1, 1, "x"), ("a b c d e f", None, 1, 1, "x"), (None, None, 1, 1, "x")]
    got = ngram_join(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(False, 3, 2, 3), (False, 3, 2, 3), (False, 5, 2, 3)]
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    kept = one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "3", "None", "None"]


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 150)] + [(7, i) for i in range(20, 60)] + [(3, 3), (900, 800), (800, 900), (None, 4)]
    random.Random(1).shuffle(links)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 151)} | {i: 7 for i in [7, *range(20, 60)]} | {800: 800, 900: 800}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "LIST_BLOCK", 3)
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(70)]  # few words: every list is long and holds several components
    rows = [(i, " ".join(rnd.sample(vocab, rnd.choice([34, 40, 46])))) for i in range(60)]
    rows += [(len(rows) + i, " ".join(rnd.sample(t.split(), len(t.split()))[rnd.randrange(4) :])) for i, (_, t) in enumerate(rows[:30])]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 1, 75).collect()
    want = brute(rows, 1, 75)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and 20 < len({c for _, c in want.values()}) < 85


def test_large_sets_and_very_long_texts(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for size in (600, 900, 1500, 3000):  # sets that have a sketch of counts
        base = [rnd.choice(vocab) for _ in range(size)]
        for changed in (0, 0.01, 0.02, 0.06, 0.3):
            rows.append((len(rows), " ".join(rnd.choice(vocab) if rnd.random() < changed else w for w in base)))
    long = " ".join(rnd.choice(vocab) for _ in range(300_000))
    rows += [(100, long), (101, long + " w1 w2"), (102, long[: len(long) // 2]), (103, "w1 " * 200_000)]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85)


def test_copies_in_many_partitions(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join(base if i % 3 else [*base[:-1], f"x{i % 9}"])) for i in range(200)] + [(300 + i, f"a{i} b{i} c d e f g") for i in range(40)]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(40), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85)
