"""Benchmark decontamination: word windows of test items in a broadcast hash set, documents scanned against it.

Windows are the runs of ``width`` words of an item, or all words of a shorter one. Their hashes stand in sorted arrays which
every task reads; a task turns a block of texts into normalised bytes (words, one space after each), hashes the windows
at every word by array operations, looks them up, and compares the words of each hit with those of the window before it
counts. A set that outgrows ``BLOCK_BYTES`` is cut by window hash into blocks that are broadcast one after the other, each with a
scan of its own, and a document's hits are put together by its key and digest; nothing is left out at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise, pick
from ._text import GOLDEN, give_back, mix, slices

WIDTH = 10
#: Most bytes of windows (words and item numbers) that are broadcast at once.
BLOCK_BYTES = 64 << 20
#: Words are runs of digits, letters a to z and all code points above 127, that is, of these bytes.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[ord("0") : ord("9") + 1] = WORD_BYTES[ord("a") : ord("z") + 1] = WORD_BYTES[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: An odd multiplier of polynomial hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of the table that turns most hashes away before the search.
GATE_BITS = 22

#: Words of a text that windows cover (from start to before end), the same as bytes of its UTF-8, and the items hit.
FOUND = "n_words long, spans array<struct<start:int,end:int,first_byte:int,end_byte:int>>, items array<string>"


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a column of texts: where they lie in the texts' bytes and in the normalised bytes, and their hashes."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.raw = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        lowered = LOWER[self.raw]
        inside = WORD_BYTES[lowered]
        edge = np.zeros(len(lowered) + 1, dtype=bool)  # a word may not go on from one text to the next
        edge[self.offsets] = True
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        self.starts = np.flatnonzero(after & (~before | edge))
        self.ends = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, and the number of words at the end
        lengths = self.ends - self.starts
        self.n_ends = np.cumsum(lengths + 1) - 1  # in the normalised bytes
        self.n_starts = self.n_ends - lengths
        self.bytes = np.full(int(lengths.sum()) + len(lengths), ord(" "), dtype=np.uint8)
        letters = lowered[inside]
        spaced = np.ones(len(self.bytes), dtype=bool)
        spaced[self.n_ends] = False
        self.bytes[spaced] = letters
        sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(letters)), dtype=np.uint64, out=sums[1:])
        at = np.concatenate([[0], np.cumsum(lengths)])
        self.hashes = (sums[at[1:]] - sums[at[:-1]]) * powers(INVERSE, len(letters) + 1)[at[:-1]]

    def windows(self, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each width in ascending order the hash of the window at each word, whole windows or not."""
        hashed = mix(self.hashes + GOLDEN)
        for width in range(1, max(widths, default=0) + 1):
            if width > 1:
                later = np.zeros_like(hashed)
                later[: -(width - 1) or None] = self.hashes[width - 1 :]
                hashed = mix(hashed * GOLDEN + later)
            if width in widths:
                yield width, hashed

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The text of each word."""
        return np.searchsorted(self.first, words, side="right") - 1


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """hash, n (words), words (normalised) and items (sorted) of every different window of ``items`` (item_id, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                raw = words.bytes.tobytes()
                counts = np.diff(words.first)
                ids, hashes, sizes, texts = [], [], [], []
                for n, hashed in words.windows(sorted({*counts[(counts > 0) & (counts < width)].tolist(), width})):
                    where = np.arange(len(hashed))
                    own = words.text_of(where)
                    whole = (counts[own] >= width) & (where + width <= words.first[own + 1]) if n == width else (counts[own] == n) & (where == words.first[own])
                    at = np.flatnonzero(whole)
                    ids += pc.take(part.column("item_id"), pa.array(own[at])).to_pylist()
                    hashes += hashed[at].view(np.int64).tolist()
                    sizes += [n] * len(at)
                    texts += [raw[a:b].decode() for a, b in zip(words.n_starts[at].tolist(), words.n_ends[at + n - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())], ["item_id", "hash", "n", "words"])

    rows = pick(items, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    found = rows.mapInArrow(find, "item_id string, hash long, n int, words string")
    return found.groupBy("hash", "n", "words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


class WindowSet:
    """Windows as sorted arrays, to be sent to every task."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("hash").combine_chunks()
        self.hashes = table.column("hash").to_numpy().astype(np.int64)
        self.n = table.column("n").to_numpy()
        self.words = [w.encode() for w in table.column("words").to_pylist()]
        lists = table.column("items").to_pylist()
        self.ids = sorted({x for row in lists for x in row})
        number = {x: i for i, x in enumerate(self.ids)}
        self.items = np.array([number[x] for row in lists for x in row], dtype=np.int32)
        self.item_ends = np.cumsum([0, *map(len, lists)])
        self.widths = sorted(set(self.n.tolist()))
        self.gate = np.zeros(1 << GATE_BITS, dtype=bool)
        self.gate[self.hashes & ((1 << GATE_BITS) - 1)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words at which a window begins, numbers of those windows), each compared word by word."""
        at, which = [], []
        raw = words.bytes.tobytes()
        for width, hashed in words.windows(self.widths):
            signed = hashed.view(np.int64)
            near = np.flatnonzero(self.gate[signed & ((1 << GATE_BITS) - 1)])
            near = near[near + width <= words.first[words.text_of(near) + 1]]
            low = np.searchsorted(self.hashes, signed[near])
            for p, w in zip(near.tolist(), low.tolist(), strict=True):
                key, text = signed[p], None
                while w < len(self.hashes) and self.hashes[w] == key:
                    if self.n[w] == width:
                        text = text or raw[words.n_starts[p] : words.n_ends[p + width - 1]]
                        if text == self.words[w]:
                            at.append(p)
                            which.append(w)
                    w += 1
        return np.array(at, dtype=np.int64), np.array(which, dtype=np.int64)

    def found(self, words: Words) -> list[pa.Array]:
        """n_words, spans and items of each text."""
        at, which = self.hits(words)
        depth = np.zeros(len(words.starts) + 1, dtype=np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + self.n[which], -1)
        hit = np.cumsum(depth)[:-1] > 0
        edge = np.zeros(len(hit) + 1, dtype=bool)
        edge[words.first] = True
        starts = np.flatnonzero(hit & (~np.concatenate([[False], hit[:-1]]) | edge[:-1]))
        ends = np.flatnonzero(hit & (~np.concatenate([hit[1:], [False]]) | edge[1:])) + 1
        base, text = words.first[words.text_of(starts)], words.offsets[words.text_of(starts)]
        span = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (starts - base, ends - base, words.starts[starts] - text, words.ends[ends - 1] - text)], ["start", "end", "first_byte", "end_byte"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, words.first), pa.int32()), span)
        sizes = np.diff(self.item_ends)[which]
        into = np.repeat(self.item_ends[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(which) else np.zeros(0, np.int64), sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(words.text_of(at), sizes) * max(1, len(self.ids)) + self.items[into.astype(np.int64)])
        owner, item = np.divmod(pairs, max(1, len(self.ids)))
        names = pa.array(self.ids, pa.string()).take(pa.array(item))
        items = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(words.first))), pa.int32()), names)
        return [pa.array(np.diff(words.first), pa.int64()), spans, items]


def _scan(docs: DataFrame, windows: pa.Table) -> DataFrame:
    """``docs`` without text, with n_words, spans and items against one block of windows."""
    kept = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(windows))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, *shared.value.found(Words(part.column("text")))], [*kept, "n_words", "spans", "items"])
        give_back()

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"], FOUND])
    return docs.mapInArrow(find, schema)


def _united(spans: str) -> str:
    """SQL of a sorted array of spans with those that overlap or touch made one."""
    whole = "named_struct('start', last.start, 'end', greatest(last.end, s.end), 'first_byte', last.first_byte, 'end_byte', greatest(last.end_byte, s.end_byte))"
    joined = f"transform(array(element_at(acc, -1)), last -> {whole})"
    return f"aggregate(array_sort({spans}), slice({spans}, 1, 0), (acc, s) -> if(size(acc) > 0 and s.start <= try_element_at(acc, -1).end, concat(slice(acc, 1, size(acc) - 1), {joined}), concat(acc, array(s))))"


def find_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, digest, n_words, spans and items for every row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    A window is ``width`` consecutive words of an item, or all words of a shorter one that has any; spans are the words of a text that
    lie in an occurrence of a window, items the ids (as text, sorted) of those with such a window. Words are lower-cased A-Z
    and are runs of digits, letters a-z and code points above 127. A null text has no words; a null item_id is the empty id,
    items that share an id are one; rows that repeat are found alike, and digest is that of the text (SHA-256, null: empty).
    No items leave every text clean; no documents give no rows; other columns are ignored.
    """
    windows = materialise(item_windows(items, width))
    total = windows.agg(F.sum(F.octet_length("words") + 16 + 8 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = pick(docs, "doc_id", "text").select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    scans = (_scan(rows, windows.where(F.pmod("hash", F.lit(blocks)) == b).select("hash", "n", "words", "items").toArrow()) for b in range(blocks))
    if blocks == 1:
        return next(scans)
    light, parts = None, []
    for b, scanned in enumerate(scans):
        found = materialise(scanned.where("size(items) > 0") if b else scanned)
        light = light or found.select("doc_id", "digest", "n_words")
        parts.append(found.where("size(items) > 0").select("doc_id", "digest", "spans", "items"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merged.distinct().groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.expr(_united("spans")).alias("spans"), "items")
    none = {f.name: F.array().cast(f.dataType) for f in merged.schema if f.name in ("spans", "items")}
    return light.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left").select("doc_id", "digest", "n_words", *[F.coalesce(c, none[c]).alias(c) for c in ("spans", "items")])


def decontaminate(docs: DataFrame, items: DataFrame, how: str = "documents", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and text of the documents without what ``items`` hold.

    ``how`` is ``documents``: those with a hit go whole; or ``spans``: all stay, each span is cut out of the text from its
    first word's first byte to its last word's last, the rest is left as it is. Rows that repeat stay or change together.
    """
    if how not in ("documents", "spans"):
        raise ValueError(f"documents or spans, not {how!r}")
    found = find_leaks(docs, items, width, block_bytes).where("size(items) > 0").select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "spans").distinct()
    rows = pick(docs, "doc_id", "text").withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))
    if how == "documents":
        return rows.join(found, same, "left_anti").select("doc_id", "text")
    bounds = F.expr("concat(array(0), flatten(transform(spans, s -> array(s.first_byte, s.end_byte))), array(octet_length(text)))")
    pieces = F.expr("transform(sequence(0, size(bounds) div 2 - 1), i -> cast(substring(cast(text as binary), bounds[2 * i] + 1, bounds[2 * i + 1] - bounds[2 * i]) as string))")
    cut = rows.join(found, same, "left").withColumn("bounds", F.when(F.size("spans") > 0, bounds))
    return cut.select("doc_id", F.when(F.col("bounds").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"))
