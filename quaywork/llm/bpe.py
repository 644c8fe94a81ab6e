"""BPE encoding and decoding by prefix-sharing trie traversal.

A word's BPE encoding is the one cut into vocabulary tokens in which every two neighbours are *compatible*: merging
their joined text from scratch gives those two tokens again. So the encoding of a prefix is fixed by its last token,
and that token by the last tokens of shorter prefixes. Distinct words are put in a trie (kept as the sorted words and
the length that each shares with the one before, so a path is a stack); a depth-first walk hands last tokens down, and
a prefix that many words share is encoded once.

Style: Arrow batches inside map tasks. Nothing is shuffled, the state of a task is bounded, and a lost executor costs
only its own partitions.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ._spark import pick
from ._text import give_back, slices, words

#: Entries of the word memo of a task, and of the memo of compatible pairs; each is emptied when full. The lean ones are for
#: encoding beside other stages' memory.
MEMO_WORDS, MEMO_PAIRS = 500_000, 1_000_000
LEAN_WORDS, LEAN_PAIRS = 100_000, 250_000
#: Bytes of the texts that are then encoded together (a longer text: alone).
LEAN_SLICE = 1 << 19

#: What the vocabulary file's splitting pattern calls white space.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class TrieBpe:
    """Encoder and decoder for a ``tokenizers`` BPE file with word ends and ids in merge order."""

    def __init__(self, path: str, lean: bool = False):
        self.path, self.splitter = path, None
        self.most_words, self.most_pairs = (LEAN_WORDS, LEAN_PAIRS) if lean else (MEMO_WORDS, MEMO_PAIRS)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.sizes = {i: len(t.removesuffix(WORD_END)) for t, i in self.ids.items()}
        self.tails: dict[str, int] = {}  # every end of a token: its id, or -1 where it isn't a token itself
        for token in self.ids:
            for k in range(len(token)):
                self.tails.setdefault(token[k:], -1)
        self.tails |= self.ids
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = self.ids[left + right]
            self.merged[self.ids[left], self.ids[right]] = whole
            self.halves.setdefault(whole, (self.ids[left], self.ids[right]))
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        self.mark = os.path.commonprefix(list(self.special))
        self.alphabet = byte_alphabet()
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}  # of a word its ids as little-endian unsigned 32-bit integers
        self.said: dict[str, str] = {}  # and, where texts are decoded too, its tokens' strings

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE over the joined text of the two tokens gives just these two.

        Walks both tokens' merges backwards, latest first; a merge across the seam that BPE would have made before the
        next step shows that it wouldn't stop at this pair. Of equal merges the left one is made first.
        """
        a, b, made = left, right, 1 << 60
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < made:
                return False
            from_a, from_b = self.halves.get(a), self.halves.get(b)
            if from_a and (a > b or not from_b):
                made, a = a, from_a[1]
            elif from_b:
                made, b = b + 1, from_b[0]
            else:
                return True

    def fits(self, left: int, token: int) -> bool:
        """``compatible``, remembered."""
        known = self.pairs.get(left << 20 | token)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[left << 20 | token] = self.compatible(left, token)
        return known

    def encode_parts(self, parts: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct pre-token (bytes written in the byte alphabet), by one walk of their trie.

        ``last[i]`` is the last token of the first ``i`` symbols on the path. Of the tokens that end there just one is
        compatible with the last token of what stands before it.
        """
        out: dict[str, list[int]] = {}
        last: list[int] = [-1]
        before, sizes, fits, tail, pair = "", self.sizes, self.fits, self.tails.get, self.pairs.get
        for part in sorted(parts):
            most = min(len(part), len(last)) - 1
            shared = 0
            while shared < most and before[shared] == part[shared]:
                shared += 1
            del last[shared + 1 :]
            for ends in range(shared + 1, len(part)):
                for start in range(ends - 1, -1, -1):
                    token = tail(part[start:ends])
                    if token >= 0 and (not start or pair(last[start] << 20 | token) or fits(last[start], token)):
                        last.append(token)
                        break
            whole = part + WORD_END
            at = len(part)
            for start in range(at - 1, -1, -1):
                token = tail(whole[start:])
                if token >= 0 and (not start or pair(last[start] << 20 | token) or fits(last[start], token)):
                    break
            ids = [token]
            at -= sizes[token]
            while at:
                token = last[at]
                ids.append(token)
                at -= sizes[token]
            ids.reverse()
            out[part] = ids
            before = part
        return out

    def split(self, word: str) -> list[str | int]:
        """Pre-tokens of a word without white space, in the byte alphabet; a special token gives its id."""
        if self.mark not in word:
            return self.split_plain(word)
        found: list[str | int] = []
        at = 0
        for hit in self.specials.finditer(word):
            found += self.split_plain(word[at : hit.start()])
            found.append(self.special[hit[0]])
            at = hit.end()
        return found + self.split_plain(word[at:])

    def split_plain(self, text: str) -> list[str]:
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in text):
                return self.split_unassigned(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        parts = self.pattern.findall(text.lower())
        alphabet = self.alphabet
        return [p if p.isascii() and p.isprintable() else "".join(alphabet[b] for b in p.encode()) for p in parts]

    def split_unassigned(self, text: str) -> list[str]:
        """Of code points that Python's Unicode version doesn't know, libraries of other versions may; the file's own splitter decides."""
        if self.splitter is None:
            self.splitter = Tokenizer.from_file(self.path)
        return [p for p, _ in self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(text))]

    def learn(self, distinct: list[str]) -> None:
        """Puts the encodings of distinct words in the memo."""
        memo = self.memo
        if len(memo) + len(distinct) > self.most_words:
            memo.clear()
            self.said.clear()
        new = [w for w in distinct if w not in memo]
        cut = [self.split(w) for w in new]
        coded = self.encode_parts(list({p for parts in cut for p in parts if isinstance(p, str)}))
        for word, parts in zip(new, cut, strict=True):
            ids = [i for p in parts for i in ([p] if isinstance(p, int) else coded[p])]
            memo[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        distinct = [w.decode() for w in text.encode().split()]
        self.learn(distinct)
        return [i for w in distinct for i in struct.unpack(f"<{len(self.memo[w]) // 4}I", self.memo[w])]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids with a space between, as the file has no decoder."""
        return " ".join([self.strings[i] for i in ids])

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return (ids for ids, _ in self._coded(texts, decoded=False))

    def round_trip(self, texts: pa.Array) -> Iterator[tuple[bytes, str]]:
        """``encode_column`` and the decoded text of each text."""
        return self._coded(texts, decoded=True)

    def _coded(self, texts: pa.Array, decoded: bool) -> Iterator[tuple[bytes, str]]:
        distinct, index, offsets = words(texts)
        distinct = distinct.to_pylist()
        self.learn(distinct)
        known = [self.memo[w] for w in distinct]
        ids, said = np.empty(len(known), dtype=object), np.empty(len(known), dtype=object)
        ids[:] = known
        if decoded:
            strings, told = self.strings, self.said
            for w, k in zip(distinct, known, strict=True):
                if w not in told:
                    told[w] = "".join([f"{strings[i]} " for i in struct.unpack(f"<{len(k) // 4}I", k)])
            said[:] = [told[w] for w in distinct]
        ids = ids[index].tolist()
        said = said[index].tolist() if decoded else []
        for a, b in pairwise(offsets.tolist()):
            yield b"".join(ids[a:b]), "".join(said[a:b])[:-1]


@lru_cache(maxsize=2)
def tokenizer(path: str, lean: bool = False) -> TrieBpe:
    """One encoder for each Python worker and file."""
    return TrieBpe(path, lean)


def _file(spark, path: str) -> str:
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def bpe_encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids`` array<int>, the token ids of the whole ``text``.

    A null or empty text has no ids. Rows are independent: repeated rows, ties and null ids give a row each; other
    columns are ignored. ``path`` is a vocabulary file; Spark sends it to the executors.
    """
    name = _file(docs.sparkSession, path)
    source = pick(docs, *keep, "text")
    fields = [f for f in source.schema.fields if f.name != "text" or "text" in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(SparkFiles.get(name), True)
        for batch in batches:
            for part in slices(batch, most=LEAN_SLICE):
                raw = list(bpe.encode_column(part.column("text")))
                ends = np.cumsum([0, *[len(r) // 4 for r in raw]]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
                ids = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], ids], [*[f.name for f in fields], "ids"])
                del raw, values, ids
                give_back()

    return source.mapInArrow(run, schema)


def bpe_decode(coded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``text``, the decoded ``ids``; null ids give an empty text."""
    name = _file(coded.sparkSession, path)
    source = pick(coded, *keep, "ids")
    schema = ", ".join([f"`{source.schema[k].name}` {source.schema[k].dataType.simpleString()}" for k in keep] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(SparkFiles.get(name))
        for batch in batches:
            text = pa.array([bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], text], [*keep, "text"])

    return source.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, without keeping ids or decoded text.

    Encodes and decodes as ``bpe_encode`` and ``bpe_decode`` do; the digest of no tokens is that of no bytes.
    """
    name = _file(docs.sparkSession, path)
    source = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(SparkFiles.get(name))
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                counts, ids_hash, text_hash = [], [], []
                for ids, decoded in bpe.round_trip(part.column("text")):
                    counts.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
