"""Scoring texts with a deleted-interpolation n-gram language model counted over the whole corpus.

The model mixes maximum-likelihood estimates of every order down to the uniform one; the weights depend on how often the
longest context was seen, by powers of two. The weights are learned by expectation-maximisation on documents that are
left out of the counts for that (the deleted part); the final counts have all training documents.

Counting and looking up follow one pattern. Documents are packed once into compressed blocks of bounded size. Each block
asks for its distinct n-grams (arrays of 64-bit hashes with the block's own counts), dealt by hash; whoever holds a hash
range adds up what all blocks sent and answers each block with the totals, in the order asked. So an n-gram crosses the
network once for each block that has it, never once for each occurrence, a frequent n-gram is no larger than a rare one,
and no vocabulary or table of counts is ever in one place. Only sums of fixed size reach the driver.

Style: numpy inside Arrow tasks; Spark groups and joins the blocks. Blocks are a table in the shared folder, so a lost
executor costs the blocks it was working on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import crc_fold, materialise
from ._text import chain, word_hashes, words

#: Text bytes of a block, and of a hash range's share of the text.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Hashes that no word has: a word holds no white space.
END, START = (np.uint64(h) for h in (0x5BD1E995C0FFEE01, 0xA24BAED4963EE407))
#: Buckets of context counts, steps of the logarithm to which held-out probabilities are binned for EM, and EM rounds.
BUCKETS, STEPS, BINS, ROUNDS = 32, 4, 192, 60


def _blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, fold, deleted) in blocks: block, deleted, bytes, doc_ids, folds, lengths, packed."""
    names = ["block", "deleted", "bytes", "doc_ids", "folds", "lengths", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        open_blocks: dict[bool, list] = {False: [], True: []}
        held = {False: 0, True: 0}

        def close(deleted: bool) -> pa.RecordBatch:
            nonlocal serial
            ids, folds, texts = zip(*open_blocks[deleted], strict=True)
            raw = b"".join(texts)
            row = [[serial], [deleted], [len(raw)], [list(ids)], [list(folds)], [[len(t) for t in texts]], [pa.compress(raw, "zstd", asbytes=True)]]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            serial, open_blocks[deleted], held[deleted] = serial + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "fold", "deleted"))
            for doc_id, fold, deleted, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                open_blocks[deleted].append((doc_id, fold, text or b""))
                held[deleted] += len(text or b"") + 16
                if held[deleted] >= BLOCK_BYTES:
                    yield close(deleted)
        for deleted in (False, True):
            if open_blocks[deleted]:
                yield close(deleted)

    return docs.mapInArrow(run, "block long, deleted boolean, bytes long, doc_ids array<long>, folds array<int>, lengths array<int>, packed binary")


@dataclass
class Grams:
    """The tokens of a block: for each order the distinct n-grams in order of their ranges, and each token's n-gram."""

    doc_ids: pa.Array
    folds: np.ndarray
    starts: np.ndarray  # of each document's tokens
    keys: list[np.ndarray]
    ranges: list[np.ndarray]
    at: list[np.ndarray]

    @classmethod
    def of(cls, row: dict, order: int, ranges: int) -> Grams:
        """From a row of the blocks; a document's tokens are its words and one end."""
        raw = pa.decompress(row["packed"], decompressed_size=row["bytes"], codec="zstd") if row["bytes"] else pa.py_buffer(b"")
        ends = np.cumsum([0, *row["lengths"]]).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(row["lengths"]), pa.py_buffer(ends), raw)
        distinct, index, offsets = words(texts, lower=True)
        sizes = np.diff(offsets) + 1
        starts = np.concatenate([[0], np.cumsum(sizes)])
        token = np.empty(starts[-1], dtype=np.uint64)
        is_end = np.zeros(len(token), dtype=bool)
        is_end[starts[1:] - 1] = True
        token[is_end] = END
        token[~is_end] = word_hashes(distinct)[index]
        place = np.arange(len(token)) - np.repeat(starts[:-1], sizes)
        back = [token]
        for k in range(1, order):
            before = np.full(len(token), START)
            before[k:] = np.where(place[k:] >= k, token[:-k], START)
            back.append(before)
        out = cls(row["doc_ids"], np.array(row["folds"]), starts, [], [], [])
        for k in range(1, order + 1):
            keys, inverse = np.unique(chain(back[:k][::-1]) if k > 1 else token, return_inverse=True)
            part = (keys >> np.uint64(20)) % np.uint64(ranges)
            dealt = np.argsort(part, kind="stable")
            seat = np.empty(len(keys), dtype=np.int64)
            seat[dealt] = np.arange(len(keys))
            out.keys.append(keys[dealt])
            out.ranges.append(np.searchsorted(part[dealt], np.arange(ranges + 1)))
            out.at.append(seat[inverse])
        return out


def _requests(blocks: DataFrame, order: int, ranges: int, held_fold: int) -> DataFrame:
    """level, range, block, deleted, keys, counts: what each block asks for and adds (nothing from held-out documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = Grams.of(row, order, ranges)
                learn = np.repeat(g.folds != held_fold, np.diff(g.starts))
                for level in range(order):
                    counts = np.bincount(g.at[level][learn], minlength=len(g.keys[level])).astype(np.int32)
                    cuts = g.ranges[level].astype(np.int32)
                    full = np.flatnonzero(np.diff(cuts)).astype(np.int32)
                    ends = pa.array(np.append(cuts[full], cuts[-1]))
                    many = len(full)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(many, level, dtype=np.int32)), pa.array(full), pa.array(np.full(many, row["block"])), pa.array(np.full(many, row["deleted"])), pa.ListArray.from_arrays(ends, pa.array(g.keys[level].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(counts))],
                        ["level", "range", "block", "deleted", "keys", "counts"],
                    )

    return blocks.mapInArrow(run, "level int, range int, block long, deleted boolean, keys array<long>, counts array<int>")


def _answers(requests: DataFrame) -> DataFrame:
    """level, range, block, kept, total: totals of the keys asked for, without and with the deleted part.

    ``kept`` only goes to deleted blocks. Block -1: (types, tokens) of the range, as ``kept`` and ``total``.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = table.column("keys").combine_chunks()
        sizes = np.diff(keys.offsets.to_numpy())
        counts = table.column("counts").combine_chunks().flatten().to_numpy()
        deleted = table.column("deleted").to_numpy(zero_copy_only=False)
        values = keys.flatten().to_numpy()
        distinct, inverse = np.unique(values, return_inverse=True)
        of_deleted = np.repeat(deleted, sizes)
        total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        kept = np.bincount(inverse[~of_deleted], counts[~of_deleted], len(distinct)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        kept_ends = np.concatenate([[0], np.cumsum(np.where(deleted, sizes, 0))]).astype(np.int32)
        blocks = table.column("block").to_numpy()
        sums = [[int((t > 0).sum()), int(t.sum())] for t in (kept, total)]
        rows = len(blocks) + 1
        return pa.table({
            "level": pa.array(np.full(rows, key[0].as_py(), dtype=np.int32)),
            "range": pa.array(np.full(rows, key[1].as_py(), dtype=np.int32)),
            "block": pa.array(np.append(blocks, -1)),
            "kept": pa.ListArray.from_arrays(pa.array(np.append(kept_ends, kept_ends[-1] + 2)), pa.array(np.append(kept[inverse[of_deleted]], sums[0]))),
            "total": pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1] + 2)), pa.array(np.append(total[inverse], sums[1]))),
        })

    return requests.groupBy("level", "range").applyInArrow(run, "level int, range int, block long, kept array<long>, total array<long>")


def _estimates(g: Grams, answers: pa.Table, column: str, types: int, tokens: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each token of a block the estimates of orders 0, 1, ..., the bucket of its longest context, and its count."""
    level, part = answers.column("level").to_numpy(), answers.column("range").to_numpy()
    lists = answers.column(column).combine_chunks()
    of, counts = [], []
    for k in range(len(g.keys)):
        rows = np.flatnonzero(level == k)
        rows = rows[np.argsort(part[rows])]
        own = lists.take(pa.array(rows)).flatten().to_numpy()
        if len(own) != len(g.keys[k]):
            raise RuntimeError(f"block has {len(g.keys[k])} n-grams of order {k + 1}, was answered {len(own)}")
        counts.append(own[g.at[k]].astype(np.float64))
    first = np.zeros(len(counts[0]), dtype=bool)
    first[g.starts[:-1]] = True
    documents = counts[0][g.starts[1] - 1] if len(g.starts) > 1 else 0.0  # every document has one end
    of = [np.full(len(first), 1 / (types + 1)), counts[0] / max(tokens, 1)]
    context = np.full(len(first), float(tokens))
    for k in range(1, len(counts)):
        context = np.empty(len(first))
        context[1:] = counts[k - 1][:-1]
        context[first] = documents
        of.append(np.where(context > 0, counts[k] / np.maximum(context, 1), 0.0))
    bucket = np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)
    return of, bucket, counts[0]


def learn_weights(bucket: np.ndarray, estimates: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mixture weights of every bucket by EM, from held-out events: estimates by order, and how often each occurred.

    A bucket without events gets the weights of all together.
    """
    orders = estimates.shape[1]

    def fit(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(orders, 1 / orders)
        for _ in range(ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    weights = np.full((BUCKETS, orders), 1 / orders)
    if len(count):
        weights[:] = fit(estimates, count)
        for b in np.unique(bucket):
            weights[b] = fit(estimates[bucket == b], count[bucket == b])
    return weights


def score_texts(docs: DataFrame, order: int = 2, folds: int = 5, held_fold: int = 1, deleted_fold: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    ``docs`` needs doc_id (integer) and text; other columns are ignored. A document's fold is crc32 of its doc_id as text
    modulo ``folds``; fold ``held_fold`` is held out of all counts, fold ``deleted_fold`` only of those on which the
    mixture weights are learned. Tokens are the words between ASCII white space, A-Z lower-cased, and one end; a null or
    empty text has the end alone. n_known counts tokens that occur in training; base_score sums
    log10((c + 0.5) / (N + 0.5 (V + 1))); score is the model's log10 probability of the text. Rows are scored one by
    one: repeated rows count as often as they occur; a null doc_id counts as the empty text for its fold. Without
    training documents only the uniform estimate is left. No rows give no rows.
    """
    fold = crc_fold("`doc_id`", folds).cast("int")
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"), fold.alias("fold"), (fold == deleted_fold).alias("deleted"))
    blocks = materialise(_blocks(rows))
    size = blocks.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    ranges = int(max(1, -(-size // RANGE_BYTES)))
    answers = materialise(_answers(_requests(blocks, order, ranges, held_fold)))
    sums = answers.where("block = -1 and level = 0").agg(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("kept", "total") for i in (0, 1)]).first()
    kept_types, kept_tokens, types, tokens = (int(x or 0) for x in sums)
    own = answers.where("block >= 0")

    def events(key: tuple, block: pa.Table, answer: pa.Table) -> pa.Table:
        codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for row in block.to_pylist():
            g = Grams.of(row, order, ranges)
            of, bucket, _ = _estimates(g, answer, "kept", kept_types, kept_tokens)
            code = bucket
            for p in of[1:]:
                step = np.rint(np.log2(np.maximum(p / of[0], 1e-9)) * STEPS).astype(np.int64) + BINS // 2
                code = code * BINS + np.where(p > 0, np.clip(step, 1, BINS - 1), 0)
            codes, counts = np.unique(code, return_counts=True)
        return pa.table({"code": pa.array(codes, pa.int64()), "n": pa.array(counts, pa.int64())})

    deleted = blocks.where("deleted").groupBy("block").cogroup(own.where("size(kept) > 0").groupBy("block"))
    seen = deleted.applyInArrow(events, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, steps = seen["code"].to_numpy(), []
    for _ in range(order):
        steps.append(code % BINS)
        code = code // BINS
    p = np.stack([np.ones(len(code)), *[np.where(s > 0, np.exp2((s - BINS // 2) / STEPS), 0.0) for s in steps[::-1]]], axis=1)
    weights = learn_weights(code, p, seen["n"].to_numpy().astype(np.float64))

    def scores(key: tuple, block: pa.Table, answer: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            g = Grams.of(row, order, ranges)
            of, bucket, count = _estimates(g, answer, "total", types, tokens)
            w = weights[bucket]
            mixed = np.log10(sum(w[:, k] * p for k, p in enumerate(of)))
            base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
            at = g.starts[:-1]
            out.append(pa.table({
                "doc_id": pa.array(g.doc_ids, pa.int64()),
                "held_out": pa.array(g.folds == held_fold),
                "n_tokens": pa.array(np.diff(g.starts)),
                "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                "train_tokens": pa.array(np.full(len(at), tokens)),
                "base_score": pa.array(np.add.reduceat(base, at)),
                "score": pa.array(np.add.reduceat(mixed, at)),
            }))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], k) for n, k in [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]})

    asked = own.select("level", "range", "block", "total")
    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
