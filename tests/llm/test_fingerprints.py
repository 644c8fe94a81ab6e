import hashlib
import random

import numpy as np
import pytest

from quaywork.llm import fingerprints as fp
from quaywork.llm._text import GOLDEN, mix


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def plain_anchors(text):
    """Closed syncmers by their definition: for every k-mer the smallest of its s-mers is at an edge."""
    codes = points(text)

    def smer(i):
        level = [mix(np.array([c], dtype=np.uint64) + GOLDEN) for c in codes[i : i + fp.S]]
        while len(level) > 1:
            half = {8: 1, 7: 2, 5: 4}[len(level)]
            level = [mix(a * GOLDEN + b) for a, b in zip(level, level[half:])]
        return int(level[0][0])

    h = [smer(i) for i in range(len(codes) - fp.S + 1)]
    return [i for i in range(len(codes) - fp.K + 1) if min(h[i : i + fp.K - fp.S + 1]) in (h[i], h[i + fp.K - fp.S])]


def sample(rnd, n):
    return "".join(rnd.choice("abcdefgh éß\n中😀") for _ in range(n))


def test_anchors_follow_the_definition_and_leave_no_gap():
    rnd = random.Random(1)
    for n in (0, 39, 40, 41, 300, 900):
        text = sample(rnd, n)
        at, _ = fp.anchors(points(text))
        assert at.tolist() == plain_anchors(text)
    at, _ = fp.anchors(points(sample(rnd, 20_000)))
    assert np.diff(at).max() <= fp.K - fp.S and at[0] <= fp.K - fp.S


def test_anchors_do_not_depend_on_context():
    rnd = random.Random(2)
    passage = sample(rnd, 500)
    alone = fp.joined_anchors([points(passage)])[0]
    before = sample(rnd, 333)
    at, hashes = fp.joined_anchors([points(before + passage + sample(rnd, 77))])[0]
    inside = (at >= 333) & (at <= 333 + 500 - fp.K)
    assert (at[inside] - 333).tolist() == alone[0].tolist() and hashes[inside].tolist() == alone[1].tolist()


def test_fingerprint_round_trip_and_likeness():
    rnd = random.Random(3)
    text = sample(rnd, 3000)
    at, hashes = fp.joined_anchors([points(text)])[0]
    again = fp.parse(fp.fingerprint(at, hashes))
    assert again[0].tolist() == at.tolist() and again[1].tolist() == hashes.tolist()
    assert fp.likeness(hashes, hashes) == 1.0
    assert fp.likeness(hashes, hashes[:0]) == 0.0 and fp.likeness(hashes[:0], hashes[:0]) == 1.0
    swapped = fp.joined_anchors([points(text[1500:] + text[:1500])])[0][1]
    assert 0.4 < fp.likeness(hashes, swapped) < 0.6  # both halves are there, but only one in order
    assert fp.likeness(hashes, fp.joined_anchors([points(sample(rnd, 3000))])[0][1]) < 0.05


def test_texts_without_a_syncmer_are_told_apart():
    rnd = random.Random(4)
    texts = [sample(rnd, n) for n in range(fp.K - 1, 2 * fp.K - fp.S + 2) for _ in range(10)]
    none = [t for t in texts if len(t) >= fp.K and not plain_anchors(t)]
    assert len(none) > 100 and max(map(len, none)) < 2 * fp.K - fp.S
    made = fp.joined_anchors([points(t) for t in texts])
    assert "" not in (prints := [fp.fingerprint(*x) for x in made]) and len({*prints}) == len(texts)
    assert all(fp.likeness(a, b) < 1 for (_, a), (_, b) in zip(made, made[1:]))
    assert all(at.tolist() == (plain_anchors(t) or [0]) for t, (at, _) in zip(texts, made))
    edited = fp.joined_anchors([points(t[: len(t) - len(t) // 2] + "x" * (len(t) // 2)) for t in texts])
    assert all(fp.likeness(a, b) < 1 for (_, a), (_, b) in zip(made, edited))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (doc_id, text), (_, after) in zip(order, [*order[1:], *order[:1]], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        prints = fp.joined_anchors([points(text), points(edited), points(after)])
        one = [fp.joined_anchors([points(t)])[0] for t in (text, edited, after)]
        assert [x[0].tolist() for x in prints] == [x[0].tolist() for x in one]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(*one[0]), fp.fingerprint(*one[1]), fp.likeness(one[0][1], one[1][1]), fp.likeness(one[0][1], one[2][1])))
    return out


@pytest.mark.parametrize("size", [1 << 30, 3000, 100])
def test_every_row_meets_its_next(spark, size):
    rnd = random.Random(size)
    rows = [(rnd.randrange(-500, 500), sample(rnd, rnd.choice([0, 1, 5, 45, 200, 900]))) for _ in range(120)]
    rows += [(7, "same"), (7, "same"), (8, None), (9, "long " * 3000)] + ([(None, "x" * 60), (None, "a")] if size == 3000 else [])
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, part string").repartition(5)
    got = fp.compare_with_edits(docs, size).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.compare_with_edits(empty).collect() == [] and fp.fingerprints(empty).collect() == []
    lone = fp.compare_with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and lone.near_next == 1.0
    a, b = fp.fingerprints(spark.createDataFrame([(1, "word " * 50), (2, "word " * 50)], "doc_id long, text string")).collect()
    assert a.fingerprint == b.fingerprint != ""
