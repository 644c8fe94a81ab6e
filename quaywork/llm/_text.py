"""Tokenising whole texts by column with Arrow and numpy; runs inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are handled in slices of about so many bytes; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIER = np.uint64(0xBF58476D1CE4E5B9)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose ``column`` holds about ``most`` bytes each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system: a task's process waits for the next task, beside others on its machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space: (distinct words, index of each word, offsets of each text).

    Null texts are empty. ``lower`` turns A-Z to a-z and nothing else.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    parts = split.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)])
    full = pc.not_equal(pc.binary_length(parts), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = parts.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), kept[ends]


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's UTF-8 bytes."""
    raw = distinct.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), dtype=np.uint64, count=len(raw))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each position from parallel arrays of hashes, order counting."""
    out = mix(parts[0] + GOLDEN)
    for part in parts[1:]:
        out = mix(out * GOLDEN + part)
    return out
