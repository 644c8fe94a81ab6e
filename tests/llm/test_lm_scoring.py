import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quaywork.llm import lm_scoring
from quaywork.llm.lm_scoring import BINS, BUCKETS, STEPS, learn_weights, score_texts


def tokens(text):
    return [*(text or "").encode().lower().split(), "<end>"]


def grams(text, order):
    t = ["<s>"] * (order - 1) + tokens(text)
    return [tuple(t[i : i + order]) for i in range(len(t) - order + 1)]


class Plain:
    """The same model written out with counters."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter(g for t in texts for g in grams(t, k)) for k in range(1, order + 1)]
        self.contexts = [Counter(g[:-1] for t in texts for g in grams(t, k)) for k in range(1, order + 1)]
        self.n, self.v = sum(self.counts[0].values()), len(self.counts[0])

    def estimates(self, text):
        for top in grams(text, self.order):
            p = [1 / (self.v + 1), self.counts[0][top[-1:]] / max(self.n, 1)]
            seen = self.n
            for k in range(2, self.order + 1):
                g = top[-k:]
                seen = self.contexts[k - 1][g[:-1]]
                p.append(self.counts[k - 1][g] / seen if seen else 0.0)
            yield p, min(int(math.log2(seen)) + 1, BUCKETS - 1) if seen else 0, self.counts[0][top[-1:]]


def brute(rows, order):
    fold = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 for d, _ in rows}
    full = Plain([t for d, t in rows if fold[d] != 1], order)
    kept = Plain([t for d, t in rows if fold[d] not in (1, 4)], order)
    events = Counter()
    for d, t in rows:
        if fold[d] == 4:
            for p, b, _ in kept.estimates(t):
                events[(b, *[int(np.clip(np.rint(math.log2(x / p[0]) * STEPS), 1 - BINS // 2, BINS // 2 - 1)) if x else None for x in p[1:]])] += 1
    keys = sorted(events, key=str)
    p = np.array([[1.0, *[0.0 if s is None else 2 ** (s / STEPS) for s in k[1:]]] for k in keys]).reshape(-1, order + 1)
    w = learn_weights(np.array([k[0] for k in keys], dtype=int), p, np.array([float(events[k]) for k in keys]))
    out = []
    for d, t in rows:
        e = list(full.estimates(t))
        out.append((d, fold[d] == 1, len(e), sum(c > 0 for *_, c in e), full.n, sum(math.log10((c + 0.5) / (full.n + 0.5 * (full.v + 1))) for *_, c in e), sum(math.log10(sum(a * b for a, b in zip(w[b_], p_, strict=True))) for p_, b_, _ in e)))
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    follow = {f"w{i}": [f"w{rnd.randrange(40)}" for _ in range(3)] for i in range(40)}
    rows = []
    for i in range(n):
        w = "w0"
        words = [w := rnd.choice(follow[w]) if rnd.random() < 0.9 else f"W{rnd.randrange(40)}".lower() for _ in range(rnd.randrange(0, 60))]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(words).replace("w1 ", "W1 ")))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "Éa unseen<end>"), (7, "w1 w2"), (None, "w3 w4")]


@pytest.mark.parametrize(("order", "block"), [(2, 8 << 20), (2, 500), (3, 800), (1, 500)])
def test_scores_equal_those_of_plain_counts(spark, monkeypatch, order, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", 3000)
    rows = corpus(order)
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted(score_texts(docs, order).collect(), key=str)
    want = sorted(brute(rows, order), key=lambda r: (str(r[0]), r[2]))
    got.sort(key=lambda r: (str(r.doc_id), r.n_tokens))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert tuple(g)[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    if order > 1:
        held = [r for r in got if r.held_out and r.n_tokens == r.n_known]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_rows_and_no_training(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = score_texts(spark.createDataFrame([(lone, "a b")], "doc_id long, text string")).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0) and got.score <= 0


def test_em_finds_the_mixture():
    p = np.array([[1.0, 8.0, 0.0], [1.0, 0.0, 8.0], [1.0, 0.5, 0.5]])
    w = learn_weights(np.array([3, 3, 3]), p, np.array([300.0, 100.0, 10.0]))
    assert w[3].sum() == pytest.approx(1) and w[3][1] > w[3][2] > w[3][0]
    assert w[5] == pytest.approx(w[3])
