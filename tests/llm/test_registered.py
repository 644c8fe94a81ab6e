"""Queries without SQL, as they are registered, over a whole table; and odd rows through every stage of the pipeline."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from quaywork.llm import embedding_dedup
from quaywork.llm.embedding_dedup import near_vectors
from quaywork.llm.lm_scoring import score_texts
from quaywork.llm.queries import queries
from quaywork.llm.token_counts import marked, model_pieces
from tests.llm.test_embedding_dedup import brute as brute_links
from tests.llm.test_lm_scoring import brute as brute_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def test_op1_scores(spark, documents):
    got = sorted(queries()["op1_lm_scoring"](spark, SF).collect(), key=lambda r: r.doc_id)
    for g, w in zip(got, sorted(brute_scores(documents, 2)), strict=True):
        assert tuple(g)[:5] == w[:5] and tuple(g)[5:7] == pytest.approx(w[5:], rel=1e-9)


def test_op3_counts(spark, documents):
    pieces = model_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    got = {r.doc_id: r.n_tokens for r in queries()["op3_token_counts"](spark, SF).collect()}
    assert got == {d: len(library.encode(marked(t)).tokens) if t else 0 for d, t in documents}


def test_op4_ids_and_texts(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = []
    for doc_id, text in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries()["op4_bpe_encoding"](spark, SF).collect()) == want


def test_op6_edits(spark, documents):
    got = {r.doc_id: r for r in queries()["op6_fingerprints"](spark, SF).collect()}
    texts = [t or "" for _, t in documents]
    assert len(got) == len(documents)
    for i, (doc_id, _) in enumerate(documents):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = (text[: len(text) - half] if half else text) + after[:half]
        assert (got[doc_id].n_chars, got[doc_id].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[doc_id].near_next <= 1 and (got[doc_id].near_edited > got[doc_id].near_next or len(text) < 400)


def test_op1_very_long_texts(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(i, t) for i, t in enumerate(["a b", "x" * 300_000, "to be or not " * 50_000, "b a", "a", "to be", "or b", "not a b"]) for _ in range(1)]
    rows += [(i, "a b to be") for i in range(10, 30)]
    assert {fold(i) for i, _ in rows} == {0, 1, 2, 3, 4}
    got = sorted(score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    for g, w in zip(got, sorted(brute_scores(rows, 2)), strict=True):
        assert tuple(g)[:5] == w[:5] and tuple(g)[5:7] == pytest.approx(w[5:], rel=1e-9)


def test_op2_a_cell_with_half_of_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 100)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    near = [list(map(float, centre + 0.03 * rng.normal(size=16))) for _ in range(700)]
    rows = [(i, x) for i, x in enumerate(near + [list(map(float, rng.normal(size=16))) for _ in range(700)])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).collect()}
    want = brute_links(rows, 0.95)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[v][0] <= want[v][0] for v in want) and found >= 0.98 * there > 100_000
    assert {v: c for v, (_, c, _) in got.items()} == {v: c for v, (_, c, _) in want.items()}


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables_through_every_stage(spark, tmp_path):
    none = spark.createDataFrame([], KIND)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in cp.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.collect() == [] and (out.columns == cp.COLUMNS or name == "bpe")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_through_every_stage(spark, tmp_path):
    def text(seed, n=60):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choice(["ka", "to", "mi", "ren", "sul"]) for _ in range(rnd.randrange(2, 5))) for _ in range(n))

    rows = [(i, text(i), "aa", f"s{i % 2}", 0) for i in range(150)]
    rows += [(5, rows[5][1], "aa", "s1", 0), (None, text(777), "aa", None, None), (None, text(778), None, "s0", None), (400, text(999, 120_000), "aa", "s0", 0), (401, None, None, None, None), (402, "", "aa", "s0", 0), (403, rows[9][1], "aa", "s1", 0)]
    spark.createDataFrame([(*r, "x") for r in rows], KIND + ", size string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    out = cp.run(spark, str(tmp_path)).collect()
    ids = {}
    for r in out:
        ids.setdefault(r.doc_id, []).append(list(r.ids))
    # the very long text may be too long for its source's share of the mix, but the stages before keep it
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = Counter(r.doc_id for r in cp.near_duplicates(spark, cp.language_id(spark, docs, ""), "").collect())
    assert not {401, 402, 403} & set(left) and left[400] == 1 and left[5] == 2 and left[None] >= 1 and set(ids) <= set(left)
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids)
    assert all(x in texts[d] for d, own in ids.items() for x in own)
