"""Document fingerprints of closed syncmers.

A k-mer of code points is an anchor if the smallest (by hash) of the s-mers inside it stands at its first or last place.
That depends on the k-mer alone, not on what is around it, so a passage has the same anchors wherever it is copied to,
and no stretch of k - s + 1 k-mers is without one. A shorter text that has none is one anchor as a whole, so that only
empty texts have no anchor. A fingerprint lists a text's anchors in order with the distance to
the one before; two fingerprints are matched by position: anchors of equal hash are paired and the longest chain of
pairs that runs in the same order in both counts.

Style: numpy over whole Arrow batches inside map tasks. Neighbours in doc_id order are brought together by one shuffle of
the texts into ranges of bounded size; the first text of a range is also sent to the range before.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import pick
from ._text import GOLDEN, mix, slices

#: Code points of a k-mer and of its inner s-mers; a k-mer is eight s-mers long at most one after another.
K, S = 40, 8
#: Text bytes of a range of documents.
RANGE_BYTES = 8 << 20
#: The most ranges.
RANGES = 1 << 15
#: Code points that are fingerprinted at once, about.
GROUP_POINTS = 1 << 20


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of one or more texts joined in ``codes``."""
    if len(codes) < K:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    h = mix(codes.astype(np.uint64) + GOLDEN)
    for step in (1, 2, 4):  # now of eight code points
        h = mix(h[:-step] * GOLDEN + h[step:])
    window = K - S + 1
    least, width = h, 1
    while width * 2 <= window:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    least = np.minimum(least[: len(h) - window + 1], least[window - width : len(h) - width + 1])
    first, last = h[: len(least)], h[window - 1 :]
    at = np.flatnonzero((first == least) | (last == least))
    whole = h[at]
    for j in range(S, K, S):
        whole = mix(whole * GOLDEN + h[at + j])
    return at, (whole >> np.uint64(32)).astype(np.uint32)


def joined_anchors(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``anchors`` of each text. A text without any has one, all of it; an empty one has none."""
    if not texts:
        return []
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at, hashes = anchors(np.concatenate(texts))
    cuts = np.searchsorted(at, starts)
    out = []
    for i, (a, b) in enumerate(pairwise(starts.tolist())):
        own = slice(cuts[i], max(cuts[i], np.searchsorted(at, b - K + 1)))
        if own.start < own.stop or a == b:
            out.append((at[own] - a, hashes[own]))
        else:
            digest = hashlib.sha256(texts[i].astype("<u4").tobytes()).digest()
            out.append((np.zeros(1, dtype=np.int64), np.frombuffer(digest[:4], dtype="<u4").astype(np.uint32)))
    return out


def fingerprint(at: np.ndarray, hashes: np.ndarray) -> str:
    """Ten hex digits for each anchor: two for the distance to the one before, eight for the hash."""
    if not len(at):
        return ""
    raw = np.empty((len(at), 5), dtype=np.uint8)
    raw[:, 0] = np.diff(at, prepend=0)
    raw[:, 1:] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    return raw.tobytes().hex()


def parse(printed: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a fingerprint."""
    raw = np.frombuffer(bytes.fromhex(printed), dtype=np.uint8).reshape(-1, 5)
    return np.cumsum(raw[:, 0], dtype=np.int64), np.ascontiguousarray(raw[:, 1:]).view(">u4").ravel().astype(np.uint32)


def _nth(hashes: np.ndarray) -> np.ndarray:
    """Each hash together with how often it came before, so that repeats differ."""
    order = np.argsort(hashes, kind="stable")
    run = hashes[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    count = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    out = np.empty(len(run), dtype=np.uint64)
    out[order] = (run.astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two lists of anchor hashes in order: twice the anchors that match in order, over all anchors; 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, in_a, in_b = np.intersect1d(_nth(a), _nth(b), assume_unique=True, return_indices=True)
    order = in_b[np.argsort(in_a)]
    matched = len(order)
    if matched > 1 and (np.diff(order) < 0).any():
        ends: list[int] = []
        for x in order.tolist():
            i = bisect_left(ends, x)
            ends[i : i + 1] = [x]
        matched = len(ends)
    return 2 * matched / (len(a) + len(b))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def _groups(texts: list, most: int = GROUP_POINTS) -> Iterator[tuple[int, int]]:
    """Cuts a list of texts into runs of about ``most`` code points."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row's whole ``text``; a null text is empty and has an empty fingerprint.

    Equal texts have equal fingerprints. Other columns are ignored; repeated rows come back as often; no rows, no rows.
    """
    source = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_points(t or "") for t in batch.column("text").to_pylist()]
            prints = [fingerprint(*x) for a, b in _groups(texts) for x in joined_anchors(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """part, own, doc_id, text: docs (doc_id, text) dealt to ranges of doc_id and put in order.

    Inside a range come its own rows by (doc_id, text), null ids first, then (own = false) those with the first doc_id of
    the range after it, or of the first range after the last. So each row's next document follows it. Ranges begin at
    quantiles of doc_id that are ids themselves; at most ``RANGES`` are made, as their starts are part of the plan, and
    no task holds a range, only a few rows of it.
    """
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    parts = int(min(RANGES, max(1, (total["bytes"] or 0) // range_bytes)))
    cuts: list[int] = []
    if parts > 1 and total["least"] is not None:
        shares = [i / parts for i in range(1, parts)]
        found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("q")).first()["q"]
        cuts = sorted({*found} - {total["least"]})
    part, also = F.lit(0), F.lit(None).cast("int")
    if cuts:
        step = max(1, int(len(cuts) ** 0.5))  # in two steps, so that few starts are compared with each row
        starts = F.array(*[F.lit(c) for c in cuts])
        skipped = F.greatest((F.size(F.filter(F.array(*[F.lit(c) for c in cuts[::step]]), lambda c: c <= F.col("doc_id"))) - 1) * step, F.lit(0))
        part = F.coalesce(skipped + F.size(F.filter(F.slice(starts, skipped + 1, step + 1), lambda c: c <= F.col("doc_id"))), F.lit(0))
        also = F.when((F.col("part") > 0) & (F.try_element_at(starts, F.col("part")) == F.col("doc_id")), F.col("part") - 1)
    first = F.col("doc_id").isNull() if total["nulls"] else F.col("doc_id") == F.lit(total["least"])
    placed = rows.withColumn("part", part.cast("int")).withColumn("also", F.when(first, F.lit(len(cuts))).otherwise(also))
    own = F.struct(F.col("part").alias("part"), F.lit(True).alias("own"))
    sent = F.array_compact(F.array(own, F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("part"), F.lit(False).alias("own")))))
    dealt = placed.select(F.explode(sent).alias("to"), "doc_id", "text").select("to.part", "to.own", "doc_id", "text")
    return dealt.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", F.desc("own"), F.asc_nulls_first("doc_id"), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(ids: list[int | None], texts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows for the documents of ``ids``; ``texts`` has one more, the next of the last."""
    edited = [np.concatenate([t[: len(t) - len(t) // 2], n[: len(t) // 2]]) for t, n in pairwise(texts)]
    prints, changed = joined_anchors(texts), joined_anchors(edited)
    columns = {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(_text(t).encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [fingerprint(*x) for x in prints[:-1]],
        "edited_fingerprint": [fingerprint(*x) for x in changed],
        "near_edited": [likeness(a, b) for (_, a), (_, b) in zip(prints, changed, strict=False)],
        "near_next": [likeness(a, b) for (_, a), (_, b) in pairwise(prints)],
    }
    return pa.RecordBatch.from_pydict(columns, schema=ARROW)


def compare_with_edits(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The fingerprint of every row of ``docs`` (doc_id, text), of its edited text, and how near both and the next are.

    Edited: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document in
    order of doc_id (null first, ties by text; after the last comes the first, and a lone document is its own next).
    near_edited and near_next are the likeness of the fingerprint to that of the edited text and of the next document.
    A null text is empty; rows are kept as they are, repeated or not; other columns are ignored; no rows, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, held = None, [], [], 0  # the last of ``texts`` waits for its next
        for batch in batches:
            for rows in slices(batch, most=1 << 20):
                for to, own, doc_id, text in zip(*[rows.column(c).to_pylist() for c in ("part", "own", "doc_id", "text")], strict=True):
                    points = _points(text)
                    if to == part:
                        texts.append(points)
                        held += len(points)
                    elif own:
                        part, ids, texts, held = to, [], [points], 0
                    if own:
                        if held >= GROUP_POINTS:
                            yield _compared(ids, texts)
                            ids, texts, held = [], texts[-1:], 0
                        ids.append(doc_id)
                    elif to == part:
                        yield _compared(ids, texts)
                        part, ids, texts, held = None, [], [], 0

    return with_next(docs, range_bytes).mapInArrow(run, SCHEMA)
