import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from quaywork.llm import chat
from quaywork.llm.token_counts import UnigramCounter, marked, model_pieces, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", None, "### User:", "\\### Assistant: </turn> ok", "#\\## User: #\\\\## User:", "<\\/turn></turn><<//turn>", "#### System: \\", "é 中 😀\n\n  x", "</role>### Other: a</role>", "<|endoftext|>"]


def test_escape_is_reversible_and_leaves_no_control_string():
    rnd = random.Random(1)
    parts = ["#", "\\", "## User:", "### Assistant:", "</turn>", "/turn>", "<", "a", " "]
    for text in [t or "" for t in ODD] + ["".join(rnd.choice(parts) for _ in range(8)) for _ in range(3000)]:
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(p.strip(" \n") in safe for p in chat.PRINTED)


def test_formatted_conversations_read_back(spark):
    rnd = random.Random(2)
    rows = []
    for conv in range(40):
        rows += [(conv, t, rnd.choice(["system", "user", "assistant", "tool ### User:", None]), rnd.choice(ODD), "x") for t in range(rnd.randrange(1, 6))]
    rows += [(99, 0, "assistant", "a" * 100_000, "x"), (None, None, "user", "lost", "x")]
    rnd.shuffle(rows)
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3), RANKS)
    got = {r.conv_id: r for r in chat.chat_digests(made, RANKS).collect()}
    raw = {r.conv_id: r for r in made.collect()}
    assert len(got) == 42
    for conv, r in got.items():
        turns = [(role or "", text or "") for c, _, role, text, _ in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1] or 0)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(raw[conv].formatted)
        assert raw[conv].formatted.count("</turn>\n") == len(turns)
        assert chat.read_turns(np.array(raw[conv].input_ids), np.array(raw[conv].loss_mask), RANKS)[0] == turns
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty, RANKS).collect() == []


def test_a_large_conversation_is_written_in_bounded_segments(spark):
    rnd = random.Random(5)
    rows = [(None, t, rnd.choice(["user", "assistant", "tool"]), f"{t} " + rnd.choice(ODD[3:])) for t in range(6000)]
    rows += [(c, t, "assistant", f"{c} {t} é") for c in (-3, 1, 2) for t in range(30)] + [(5, 0, "user", "0 1 " * 20_000), (5, 1, "assistant", "end")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = {}
    for conv, _, role, text in sorted(rows, key=lambda r: r[1]):
        want.setdefault(conv, []).append((role, text))
    for most in (40, chat.SEGMENT_IDS):
        made = chat.format_chats(docs, RANKS, most)
        parts = sorted(made.collect(), key=lambda r: (str(r.conv_id), r.segment))
        assert sum(r.conv_id is None for r in parts) > 1
        read, learned = {}, {}
        for r in parts:
            turns, under = chat.read_turns(np.array(r.input_ids), np.array(r.loss_mask), RANKS)
            assert len(r.input_ids) == len(r.loss_mask) and (len(r.input_ids) <= most or len(turns) == 1)
            read.setdefault(r.conv_id, []).extend(turns)
            learned.setdefault(r.conv_id, []).extend(under)
        assert read == want
        got = {r.conv_id: r for r in chat.chat_digests(made, RANKS).collect()}
        assert got.keys() == want.keys()
        for conv, turns in want.items():
            loss = "".join(t for role, t in turns if role == "assistant")
            assert "".join(learned[conv]) == loss
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert got[conv].formatted_chars == sum(len(r.formatted) for r in parts if r.conv_id == conv)
    with pytest.raises(Exception, match="doesn't follow"):
        chat.chat_digests(made.where("segment <> 1"), RANKS).collect()


@pytest.fixture(scope="module")
def pieces():
    return model_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def library(vocab):
    return Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], 0, False))


def test_counts_equal_the_librarys(pieces):
    counter, lib = UnigramCounter(pieces), library(pieces)
    rnd = random.Random(3)
    texts = ["", "Hello  world", "   ", "naïve 中文 ☃☃ x☃y", "a" * 50]
    texts += ["".join(rnd.choice("abcdehinorst  éß☃☃1") for _ in range(rnd.randrange(1, 60))) for _ in range(1500)]
    for text in texts:
        assert counter.count_text(text)[0] == (len(lib.encode(marked(text)).tokens) if text else 0), text


def test_ties_and_unknowns_follow_the_library():
    vocab = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -6.0), ("▁a", -3.0), ("bb", -3.0)]
    counter, lib = UnigramCounter(vocab), library(vocab)
    rnd = random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choice("aabb z") for _ in range(rnd.randrange(1, 14)))
        assert counter.count_text(text)[0] == len(lib.encode(marked(text)).tokens), text


def test_counts_of_a_table(spark, pieces):
    rows = [(1, "two words", 0), (1, "two words", 0), (None, None, 0), (2, "", 0), (3, "long " * 20_000, 0)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, score int"), pieces).collect()
    lib = library(pieces)
    want = [(d or 0, len(lib.encode(marked(t or "")).tokens) if t else 0) for d, t, _ in rows]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted(want)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), pieces).collect() == []
