import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quaywork.llm import language_id as li
from quaywork.llm.language_id import ORDER, UNIT, CharacterModels, characters, identify, packed, train
from quaywork.llm.queries import op8_language_id


def normal(text):
    """Lower-case letters with single spaces in place of all else, one before and one after the text."""
    words = "".join(ch.lower() if ch.isalpha() and len(ch.lower()) == 1 else ch if ch.isalpha() else " " for ch in text or "").split()
    return [*(" " + " ".join(words)), " "]


def plain_grams(text):
    """Each character after the leading space with the three before it; spaces stand before a text."""
    full = " " * (ORDER - 1) + "".join(normal(text))
    return [full[i - ORDER + 1 : i + 1] for i in range(ORDER, len(full))]


def key_of(gram):
    return sum(min(ord(ch), 0xFFFF) << 16 * (ORDER - 1 - i) for i, ch in enumerate(gram))


def reference_log2(counts, alphabet, gram):
    """Interpolated Kneser-Ney of one language from its highest-order counts, written out."""

    def table(k):
        if k == ORDER:
            return counts
        out = Counter()
        for g in table(k + 1):
            out[g[1:]] += 1
        return out

    def prob(g):
        if not g:
            return 1 / (alphabet + 1)
        t = table(len(g))
        once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        after = {x: v for x, v in t.items() if x[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return prob(g[1:])
        return max(t.get(g, 0) - d, 0) / total + d * len(after) / total * prob(g[1:])

    return math.log2(prob(gram))


def test_probabilities_are_interpolated_kneser_ney():
    texts = {"x": "abab abba baab", "y": "cab cabba acc"}
    counts, plain = {}, {}
    for lang, text in texts.items():
        plain[lang] = Counter(plain_grams(text))
        c, starts = characters(pa.array([text]))
        g, n = np.unique(packed(c, starts, 1, len(c)), return_counts=True)
        counts[lang] = (g, n)
        assert dict(zip(g.tolist(), n.tolist(), strict=True)) == {key_of(x): m for x, m in plain[lang].items()}
    model = CharacterModels.fit(counts)
    alphabet = len({g[-1] for p in plain.values() for g in p})
    wanted = sorted({g for p in plain.values() for g in p} | {"abcc", "zzzz", "bbbb", "aaca", "   c"})
    got = model.lookup(np.array([key_of(g) for g in wanted], dtype=np.uint64), ORDER - 1) / UNIT
    for row, gram in zip(got, wanted, strict=True):
        for i, lang in enumerate(model.langs):
            assert abs(row[i] - reference_log2(plain[lang], alphabet, gram)) < 1e-4, (gram, lang)


def test_held_out_accuracy_and_rejection(spark):
    rnd = random.Random(5)
    parts = {"aa": ["ka", "to", "mi", "ren", "sul"], "bb": ["kö", "tra", "ni", "gel", "ba"], "cc": ["xi", "wo", "ja", "quu", "pe"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(30)), lang) for i in range(300) for lang in [rnd.choice(list(parts))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs.where("doc_id < 250"))
    tests = [*rows[250:], (1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", None), (1003, "vhg bzzd fyyy " * 20, "aa"), (None, "katomi " * 9, None)]
    frame = spark.createDataFrame([(*r, "z") for r in tests], "doc_id long, text string, lang string, score string").drop("lang")
    got = {r.doc_id: r for r in identify(frame, model).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, lang in rows[250:])
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    assert got[1003].rejected and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_empty_tables_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(empty)
    assert identify(empty, model).collect() == []
    assert identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"
    one = train(spark.createDataFrame([(i, "the one of them all", "en") for i in range(50)], "doc_id long, text string, lang string"))
    long = spark.createDataFrame([(1, "the one of " * 500_000)], "doc_id long, text string")
    assert identify(long, one).first().lang_pred == "en"


def test_texts_are_kept_apart():
    texts = ["Abc, déf", "", None, "!!", "x", " yz 12 yz. ", "- a"]
    c, starts = characters(pa.array(texts))
    assert [c[a : b + 1].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [[ord(ch) for ch in normal(t)] for t in texts[:1]] + [[32, 32]] * 3 + [[ord(ch) for ch in normal(t)] for t in texts[4:]]


def made_model(rnd, spread=True):
    kinds = {"aa": "abcde ", "bb": "cdefg ", "cc": "xyzab "}
    plain = {lang: Counter(g for _ in range(40) for g in plain_grams("".join(rnd.choice(letters) for _ in range(60)))) for lang, letters in kinds.items()}
    model = CharacterModels.fit({lang: (np.array([key_of(g) for g in own], dtype=np.uint64), np.array(list(own.values()))) for lang, own in plain.items()})
    model.mean, model.spread = np.array([2.0, 2.5, 2.2]), np.array([0.15, 0.2, 0.2])
    return plain, model


def test_predictions_equal_a_plain_version_whatever_stands_beside_a_text(monkeypatch):
    rnd = random.Random(3)
    plain, model = made_model(rnd)
    texts = ["".join(rnd.choice("abcdefgxyz .,É1") for _ in range(rnd.choice([1, 3, 20, 90]))) for _ in range(30)] + [None, "", "12 !", "zz", "zz", "abc " * 60]
    together = model.predict(pa.array(texts))
    known: dict = {}
    for i, text in enumerate(texts):
        grams = plain_grams(text)
        letters = sum(ch != " " for ch in normal(text))
        bits = []
        for lang in model.langs:
            for g in grams:
                if (lang, g) not in known:
                    known[lang, g] = reference_log2(plain[lang], len({x[-1] for p in plain.values() for x in p}), g)
            bits.append(-sum(known[lang, g] for g in grams) / len(grams))
        best = min(range(3), key=lambda k: bits[k])
        if not letters:
            assert (together["lang"][i], together["score"][i], together["rejected"][i]) == ("und", 0, True)
            continue
        assert together["lang"][i] == model.langs[best] and abs(together["bits"][i] - bits[best]) < 1e-4
        assert abs(together["score"][i] - 1 / sum(2 ** (-8 * (x - bits[best])) for x in bits)) < 1e-3
        assert together["rejected"][i] == (bits[best] > model.mean[best] + li.TOLERANCE * model.spread[best] * math.sqrt(1 + 400 / letters))
    assert any(together["rejected"][:30]) and not all(together["rejected"][:30])
    order = rnd.sample(range(len(texts)), len(texts))
    shuffled = model.predict(pa.array([texts[i] for i in order]))
    monkeypatch.setattr(li, "BLOCK", 17)  # texts over several blocks, blocks of several texts
    blocks = model.predict(pa.array(texts))
    for name, values in together.items():
        assert [shuffled[name][order.index(i)] for i in range(len(texts))] == list(values) == list(blocks[name])
        assert [model.predict(pa.array([t], pa.string()))[name][0] for t in texts] == list(values)


def test_repeated_rows_are_learned_once_and_answered_alike(spark):
    rows = [(1, "kati mora tolu " * 5, "aa"), *[(i, f"xelu niro {'qo ' * (i % 7)}", "bb") for i in range(2, 100)]]
    kind = "doc_id long, text string, lang string"
    once = train(spark.createDataFrame(rows, kind))
    again = train(spark.createDataFrame(rows * 3, kind).repartition(5))  # small enough for all rows to be in both samples
    assert all((a == b).all() for x, y in zip((*once.grams, *once.logs), (*again.grams, *again.logs), strict=True) for a, b in [(x, y)])
    got = {(r.doc_id, r.lang_pred, r.score, r.bits, r.rejected) for r in identify(spark.createDataFrame(rows * 3, kind).repartition(7), again).collect()}
    assert len(got) == len(rows)


def test_query_learns_from_its_folds_only(spark, tmp_path):
    rnd = random.Random(8)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    word = lambda lang: "".join(rnd.choice({"aa": ["ka", "to"], "bb": ["xi", "wo"]}[lang]) for _ in range(3))
    rows = [(i, " ".join(word("ab"[i % 2] * 2) for _ in range(20)), "zz" if i in held else "ab"[i % 2] * 2, "s") for i in range(400)] + [(None, "kato tok", None, None), (500, None, "aa", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op8_language_id(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and {r.doc_id for r in out if r.held_out} == {i for i in got if zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2}
    assert all(got[i].lang_pred == "ab"[i % 2] * 2 for i in range(400))  # the label zz stands in the held-out fold alone
    assert (got[500].lang_pred, got[500].score) == ("und", 0.0)
