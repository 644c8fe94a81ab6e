"""Benchmark windows against a plain search, in one block and in many."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quaywork.llm import decontamination as dc
from quaywork.llm.queries import op13_decontamination

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, width):
    windows = {}
    for item, text in items:
        words = WORD.findall(lowered(text))
        for i in range(max(1, len(words) - width + 1)) if words else []:
            windows.setdefault(tuple(words[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        words, hit, found = WORD.findall(lowered(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if ids := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(words), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def got(frame):
    rows = frame.select("doc_id", "n_words", "spans", "items").collect()
    return sorted(((r.doc_id, r.n_words, [i for s in r.spans for i in range(s.start, s.end)], r["items"]) for r in rows), key=str)


def sample(seed):
    rnd = random.Random(seed)
    words = ["a", "B", "c1", "é", "ÉA", "straße", "語", "x9", "_", "the"]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "--", " ", "."]) for _ in range(k))
    items = [(i, text(rnd.choice([0, 1, 2, 3, 4, 6, 9]))) for i in range(30)] + [(3, text(5)), (None, text(6)), (70, None), (71, ""), (72, "..."), (73, "Rare words stand here only once"), (74, "rare words stand here only once")]
    docs = [(i, text(rnd.randrange(30))) for i in range(60)] + [(60, None), (61, ""), (62, "!!"), (None, text(9)), (None, None), (63, "x RARE words, stand here-only once x rare words stand"), (64, "rare words stand here only")]
    docs += docs[:4] + [(65, "y" * 2_000_000), (66, "the quick " * 30_000 + "rare words stand here only once")]
    return docs, items


@pytest.mark.parametrize("width", [3, 5])
@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 900])
def test_spans_and_items_equal_a_plain_search(spark, width, block):
    docs, items = sample(width)
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("spans", "items", "n_words", "digest", "d", "g", "hash", "words")})
    assert got(dc.find_leaks(frame.repartition(3), spark.createDataFrame(items, ITEMS).withColumn("n", F.lit(2)), width, block)) == plain(docs, items, width)


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c"), (2, None)], DOCS)
    no_items, items = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "b")], ITEMS)
    assert got(dc.find_leaks(none, items)) == [] and got(dc.find_leaks(none, no_items)) == []
    assert got(dc.find_leaks(docs, no_items)) == [(1, 3, [], []), (2, 0, [], [])]
    assert got(dc.find_leaks(docs, items)) == [(1, 3, [1], ["1"]), (2, 0, [], [])]


def test_equal_hashes_of_different_words_are_told_apart(spark, monkeypatch):
    real = dc.Words.windows

    def blunt(self, widths):
        for n, hashed in real(self, widths):
            yield n, hashed & dc.np.uint64(7)

    monkeypatch.setattr(dc.Words, "windows", blunt)
    docs, items = [(i, f"w{i} v{i % 5} u{i % 3}") for i in range(50)], [(i, f"w{3 * i} v{3 * i % 5}") for i in range(9)]
    windows = dc.pa.table({"hash": [], "n": [], "words": [], "items": []}, dc.pa.schema([("hash", "int64"), ("n", "int32"), ("words", "string"), ("items", dc.pa.list_(dc.pa.string()))]))
    rows = []
    for item, text in items:
        w = dc.Words(dc.pa.array([text]))
        rows.append({"hash": int(dict(w.windows([2]))[2].view("int64")[0]), "n": 2, "words": text, "items": [str(item)]})
    held = dc.WindowSet(dc.pa.Table.from_pylist(rows, windows.schema))
    found = held.found(dc.Words(dc.pa.array([t for _, t in docs])))[2].to_pylist()
    assert [(d, 3, list(range(2)) if f else [], f) for (d, _), f in zip(docs, found, strict=True)] == sorted(plain(docs, items, 2))


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 300])
def test_spans_or_documents_go(spark, block):
    items = spark.createDataFrame([(1, "one two three four"), (2, "vier fünf")], ITEMS)
    docs = spark.createDataFrame([(1, "Say: One, two; THREE four five!"), (2, "clean\ttext "), (3, "é vier - Fünf. vier fünf é"), (None, "one two three"), (5, None), (6, "two three four one two")], DOCS)
    whole = {r.doc_id: r.text for r in dc.decontaminate(docs, items, "documents", 3, block).collect()}
    assert whole == {2: "clean\ttext ", 5: None}
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, items, "spans", 3, block).collect()}
    assert cut == {1: "Say:  five!", 2: "clean\ttext ", 3: "é  é", None: "", 5: None, 6: " one two"}
    with pytest.raises(ValueError, match="documents or spans"):
        dc.decontaminate(docs, items, "words")


def test_the_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in op13_decontamination(spark, sf).collect()), key=str)
    assert rows == [(d, n, len(hit), len(found), bool(hit)) for d, n, hit, found in plain(docs, items, 10)] and any(r[4] for r in rows)
