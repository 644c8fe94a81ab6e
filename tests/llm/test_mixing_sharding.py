import random
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest

from quaywork.llm.mixing import mix, mixed_documents
from quaywork.llm.sharding import shard


def plain_targets(sizes, weights, share, most):
    """Shares by weight; what is above the limit is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, left, free = {s: Fraction(0) for s in names}, Fraction(share) * sum(sizes.values()), set(names)
    while left > 0 and free:
        total = sum(w[s] for s in free)
        over = Fraction(0)
        for s in list(free):
            target[s] += left * w[s] / total
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
                free.discard(s)
        left = over
    return target


@pytest.mark.parametrize("hot", [1, 40])
def test_mix_meets_targets(spark, hot):
    rnd = random.Random(hot)
    names = ["b", "a", None, "", "é", "zz"]
    rows = []
    for i in range(600):
        source = "a" if rnd.randrange(hot) else rnd.choice(names)
        rows.append((i, None if i % 97 == 0 else " ".join(["x"] * rnd.randrange(0, 60)), source, rnd.choice([None, 0.0, 0.5, 2.0])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    got = mix(docs, [5, 2, 1], quality="quality").collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == words[r.doc_id] and r.taken == r.size * r.copies and r.taken <= 2 * r.size and r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    targets = plain_targets(sizes, [5, 2, 1], Fraction(3, 2), 2)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(targets[r.source])) < 1e-6
    for s in sizes:
        assert abs(taken[s] - float(targets[s])) <= most[s] / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(7), [5, 2, 1], quality="quality").collect()))


def test_better_documents_come_first(spark):
    rows = [(i, "w " * 10, s, 8.0 if i % 2 else 1.0) for s in "ab" for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    got = [r for r in mix(docs, [3, 1], share=0.6, quality="quality").collect() if r.source == "b" and r.copies]
    assert sum(r.doc_id % 2 for r in got) > 0.7 * len(got)


def test_mixed_documents_repeat_rows(spark):
    rows = [(1, "a b", "x", 7), (1, "a b", "x", 7), (2, None, "x", 7), (3, "c", None, 7), (None, "d", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    assert mixed_documents(docs, [1], share=2.0).count() >= 8
    assert mixed_documents(docs, [1], share=2.0).columns == docs.columns
    assert mix(docs.limit(0), [1]).collect() == []


def test_shards_are_contiguous_and_even(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(10**6), "é" * rnd.randrange(0, 50), i) for i in range(3000)] + [(5, "copy", 1)] * 40 + [(None, None, 0), (9, "", 0)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(6)
    got = shard(docs).collect()
    assert len(got) == len(rows)
    raw = sorted(((d is not None, d or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, _ in rows)
    line = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [((r.doc_id is not None, r.doc_id or 0), r.text_crc32, r.size) for r in line] == raw
    by = defaultdict(list)
    for r in line:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(by) == list(range(16)) and all([r.slot for r in v] == list(range(len(v))) for v in by.values())
    mean = sum(r.size for r in got) / 16
    assert all(abs(sum(r.size for r in v) - mean) <= max(r.size for r in got) for v in by.values())
    assert shard(docs.limit(0)).collect() == []
    assert shard(docs.limit(1)).collect()[0].slot == 0


def test_one_very_long_text_spans_shards(spark):
    rows = [(i, "ab") for i in range(50)] + [(25, "x" * 3_000_000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows) and max(r.size for r in got) == 3_000_001
    assert [r.shard for r in got if r.size > 3] == [7] or [r.shard for r in got if r.size > 3] == [8]
    assert {r.shard for r in got if r.size == 3} == {0, 15}  # what stands before and after it


def test_mix_takes_very_long_texts_whole(spark):
    rows = [(i, "w " * 20, "a") for i in range(30)] + [(100, "w " * 400_000, "b"), (101, "w", None)]
    got = {r.doc_id: r for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [5, 2, 1]).collect()}
    assert got[100].size == 400_000 and got[100].taken in (400_000, 800_000) and got[5].taken == 40
