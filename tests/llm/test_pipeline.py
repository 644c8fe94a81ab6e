import hashlib
import random
import string
from collections import Counter, defaultdict
from fractions import Fraction

import corpus_pipeline as cp
import public_tokenizers
from tokenizers import Tokenizer

from quaywork.llm.queries import LABEL_WEIGHTS
from tests.llm.test_mixing_sharding import plain_targets
from tests.llm.test_ngram_join import brute

KIND = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["ka", "to", "mi", "ren", "sul"], "bb": ["kö", "tra", "ni", "gel", "ba"]}


def corpus(seed=9):
    """Documents of two invented languages, near and exact copies of some, and unlabelled others that no model should accept."""
    rnd = random.Random(seed)
    word = lambda lang: "".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(2, 5)))
    rows = []
    for i in range(260):
        lang = rnd.choice("ab") * 2
        rows.append((i, " ".join(word(lang) for _ in range(rnd.randrange(40, 90))), lang, rnd.choice(["s1", "s2", None]), 0))
    for i in range(260, 320):
        base = rows[rnd.randrange(40)]
        words = base[1].split()
        if i % 3:
            words[rnd.randrange(len(words))] = word(base[2])
        rows.append((i, " ".join(words), *base[2:]))
    odd = [(1000 + i, " ".join("".join(rnd.choice("qxzvwjy") for _ in range(7)) for _ in range(60)), None, "s1", 0) for i in range(6)]
    blank = [(2000, None, "aa", "s1", 0), (2001, "", "bb", "s2", 0), (2002, "12 ... 34", None, "s2", 0)]
    rows += odd + blank
    rnd.shuffle(rows)
    return rows


def test_stages_and_columns(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "mixing", "bpe"] and cp.ORACLE_SQL is None
    none = spark.createDataFrame([], KIND)
    for _, stage in cp.STAGES[:2]:
        none = stage(spark, none, "")
        assert none.columns == cp.COLUMNS and none.collect() == []


def test_language_stage_drops_what_no_model_accepts_and_keeps_the_rest(spark):
    rows = corpus()
    out = cp.language_id(spark, spark.createDataFrame([(*r, "x") for r in rows], KIND + ", rejected string").repartition(3), "")
    assert out.columns == cp.COLUMNS
    assert sorted(map(tuple, out.collect())) == sorted(r for r in rows if r[0] < 1000)


def test_near_duplicate_stage_keeps_the_first_of_each_group(spark):
    rows = [r for r in corpus() if r[0] < 1000] + [(3000, None, None, None, None), (3001, "", None, None, None), (3002, "a b", None, None, None), (3003, "a b", None, None, None)]
    out = cp.near_duplicates(spark, spark.createDataFrame([(*r, 1) for r in rows], KIND + ", component_id int").repartition(3), "")
    assert out.columns == cp.COLUMNS
    kept = {d for d, (_, c) in brute([r[:2] for r in rows], cp.WIDTH, cp.PERCENT).items() if d == c}
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept) and 200 < len(kept) < len(rows) - 40


def test_bpe_stage_gives_the_library_s_ids(spark):
    rows = [(1, "Hello wörld\n\ntwo  spaces", "x", None, 0), (1, "Hello wörld\n\ntwo  spaces", "x", None, 0), (2, None, "x", "s", 0), (3, "", None, "s", 0), (4, "ab " * 60_000, None, "s", 0)]
    rows += [(10 + i, "".join(random.Random(i).choice(string.printable) for _ in range(300)), "x", "s", 0) for i in range(20)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    out = cp.bpe(spark, spark.createDataFrame(rows, KIND), "").collect()
    want = sorted((r[0], r[2] or "", r[3] or "", library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted((r.doc_id, r.lang or "", r.source or "", r.ids) for r in out) == want and all(r.n_tokens == len(r.ids) for r in out)


def test_whole_run_is_its_stages_one_after_another(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, KIND).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    labels = {r[0]: r[0] % 2 for r in rows if r[0] % 3}
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    clean = [r for r in rows if r[0] < 1000]
    groups = brute([r[:2] for r in clean], cp.WIDTH, cp.PERCENT)
    want = plain_mix([r for r in clean if groups[r[0]][1] == r[0]], {i: [q] for i, q in labels.items()})
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, n in want.items() if n})


def test_stages_hand_python_small_batches_of_texts(spark, tmp_path, monkeypatch):
    def texts_of(batches):
        import pyarrow as pa

        for batch in batches:
            size = batch.column("text").nbytes
            yield pa.RecordBatch.from_pydict({"doc_id": [size], "text": [""], "lang": [""], "source": [""], "n_chars": [size], "rejected": [False], "ids": pa.array([[]], pa.list_(pa.int32()))})

    told = lambda docs, *_: docs.select(cp.COLUMNS).mapInArrow(texts_of, KIND + ", rejected boolean, ids array<int>")
    monkeypatch.setattr(cp, "train", lambda docs: None)
    monkeypatch.setattr(cp, "identify", told)
    monkeypatch.setattr(cp, "bpe_encode", told)
    path = str(tmp_path / "large.parquet")
    spark.createDataFrame([(i, "word " * 20_000, "x", "s", 0) for i in range(120)], KIND).coalesce(1).write.parquet(path)
    for stage in (cp.language_id, cp.bpe):
        stage(spark, spark.read.parquet(path), "").write.parquet(out := str(tmp_path / stage.__name__))  # as the driver writes it
        sizes = [r.doc_id for r in spark.read.parquet(out).collect()]
        assert sum(sizes) > 11_000_000 and max(sizes) < 3 << 20


def plain_mix(rows, labels):
    """Copies of each document: whole epochs, then by exponential keys scaled with the label's weight."""
    by_source, out = defaultdict(list), {}
    for doc_id, text, _, source, _ in rows:
        u = (int(hashlib.md5(f"17:{doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        weight = LABEL_WEIGHTS[max(labels[doc_id])] if labels.get(doc_id) else 1.0
        by_source[source].append((1 - u ** (1 / weight), len(text.split()), doc_id))
    targets = plain_targets({s: sum(x[1] for x in own) for s, own in by_source.items()}, cp.SOURCE_WEIGHTS, Fraction(cp.SHARE), 2)
    for s, own in by_source.items():
        whole = sum(x[1] for x in own)
        epochs, rest, seat = targets[s] // whole, targets[s] % whole, 0
        for _, size, doc_id in sorted(own):
            out[doc_id] = int(epochs + (rest > 0 and seat + Fraction(size, 2) <= rest))
            seat += size
    return out


def test_mixing_takes_better_labelled_documents_first(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 40)), "xx", rnd.choice("abbc"), 0) for i in range(900)]
    labels = {i: [rnd.randrange(2) for _ in range(rnd.choice([1, 1, 2]))] for i in range(0, 800)}
    spark.createDataFrame([(i, q, 0) for i, own in labels.items() for q in own] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    mixed = cp.mixing(spark, docs, str(tmp_path))
    assert mixed.columns == cp.COLUMNS
    got, want = Counter(map(tuple, mixed.collect())), plain_mix(rows, labels)
    assert got == Counter({r: want[r[0]] for r in rows if want[r[0]]})
    mean = {q: sum(want[i] for i, own in labels.items() if max(own) == q) / sum(max(own) == q for own in labels.values()) for q in (0, 1)}
    assert mean[1] > mean[0] + 0.1
