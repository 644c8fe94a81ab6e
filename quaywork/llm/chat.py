"""Chat formatting at token level: segments encoded apart, reserved ids between them, loss masks by prefix sums.

Every text is escaped and encoded alone, so no merge crosses a turn, and reserved ids, which no text can produce, mark
where turns begin and end. In print a reserved id is a control string; where a text holds one, a backslash goes in after
its first character (one more where some stand there already), which no other text turns into and which is undone on
reading. The mask covers the texts of assistant turns and nothing else.

Style: encoding is a map over Arrow batches of turns; Spark brings a conversation's encoded turns together and sorts them
on disk; assembly is a map over the sorted turns. A conversation is written in numbered segments of whole turns and
bounded size and read back segment by segment, so only a turn, which is a row of the input, has to fit in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

#: How the byte-level vocabulary splits text before its merges (a fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Reserved ids, above the vocabulary, and what they print as.
FIRST_RESERVED = 50257
PRINTED = ["### System: ", "### User: ", "### Assistant: ", "### Other: ", "</role>", "</turn>\n"]
SYSTEM, USER, ASSISTANT, OTHER, ROLE_END, TURN_END = range(FIRST_RESERVED, FIRST_RESERVED + len(PRINTED))
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
TRAINED = "assistant"

#: Ids of a segment of a conversation, at most; a turn of more is a segment of its own.
SEGMENT_IDS = 1 << 14
#: Ids of the segments that are handed on at once, about.
BATCH_IDS = 1 << 20

_CONTROL = r"(?:#{slashes}(?=## (?:System|User|Assistant|Other):)|<{slashes}(?=/(?:role|turn)>))"
_TO_ESCAPE = re.compile(_CONTROL.replace("{slashes}", r"\\*"))
_ESCAPED = re.compile(_CONTROL.replace("{slashes}", r"\\+"))


def escape(text: str) -> str:
    """``text`` without control strings, reversibly."""
    return _TO_ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The text of which ``escape`` made ``text``."""
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _turns(rows: DataFrame, name: str) -> DataFrame:
    """conv_id, turn, role, ids: each turn's reserved ids and encoded text, and ``inside``: where the text's ids lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoding(SparkFiles.get(name))
        for batch in batches:
            ids, inside = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head = [ROLES[role]] if role in ROLES else [OTHER, *coder.encode_ordinary(escape(role or "")), ROLE_END]
                body = coder.encode_ordinary(escape(text or ""))
                ids.append([*head, *body, TURN_END])
                inside.append([len(head), len(body)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "turn", "role")], pa.array(ids, pa.list_(pa.int32())), pa.array(inside, pa.list_(pa.int32()))], ["conv_id", "turn", "role", "ids", "inside"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, ids array<int>, inside array<int>")


def format_chats(rows: DataFrame, path: str, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """conv_id, segment, input_ids, loss_mask, formatted of every conversation of ``rows`` (conv_id, turn, role, text).

    ``path``: a tiktoken rank file of 50,256 byte-level tokens, sent to the executors. Turns stand in order of turn
    (null first, ties by role, then text ids); repeated rows are turns of their own; a null text is empty, a null role is
    an empty one; roles other than system, user and assistant are written out after the mark for others. loss_mask has
    1 for the ids of assistant texts. formatted is the print of input_ids. A null conv_id is one conversation. Other
    columns are ignored; no rows give no rows.

    A conversation of more than ``segment_ids`` ids has several rows, segments from 0 on, which joined in order are the
    whole of it; a segment has whole turns, and more ids than that only if it is one turn. The segments of a conversation
    come one after another in one partition.
    """
    rows.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    plain = rows.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), F.col("`role`").cast("string").alias("role"), F.col("`text`").cast("string").alias("text"))
    turns = _turns(plain, name).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids", "inside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoding(SparkFiles.get(name))
        made: list[tuple] = []
        held = 0
        for conv, number, own in _segments(batches, segment_ids):
            ids = np.concatenate([t for _, t, _ in own])
            starts = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in own])])
            change = np.zeros(len(ids) + 1, dtype=np.int64)
            for start, (role, _, inside) in zip(starts.tolist(), own, strict=False):
                if role == TRAINED:
                    change[start + inside[0]] += 1
                    change[start + sum(inside)] -= 1
            made.append((conv, number, ids, np.cumsum(change[:-1]).astype(np.int8), "".join(_print(coder, part) for part in _parts(ids))))
            held += len(ids)
            if held >= BATCH_IDS:
                yield _segment_batch(made)
                made, held = [], 0
        if made:
            yield _segment_batch(made)

    return turns.mapInArrow(run, "conv_id long, segment long, input_ids array<int>, loss_mask array<tinyint>, formatted string")


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int | None, int, list[tuple]]]:
    """conv_id, number and turns (role, ids, inside) of each segment of at most ``most`` ids, from turns in order."""
    conv, number, own, held = None, 0, [], 0
    for batch in batches:
        every, cuts = batch.column("ids").values.to_numpy(), batch.column("ids").offsets.to_pylist()
        for i, (of, role, inside) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "inside")], strict=True)):
            ids = every[cuts[i] : cuts[i + 1]]
            if own and (of != conv or held + len(ids) > most):
                yield conv, number, own
                number, own, held = number + 1, [], 0
            if of != conv:
                conv, number = of, 0
            own.append((role, ids, inside))
            held += len(ids)
    if own:
        yield conv, number, own


def _segment_batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made), kinds, strict=True)], ["conv_id", "segment", "input_ids", "loss_mask", "formatted"])


def _parts(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of ordinary ids and single reserved ids."""
    cuts = np.flatnonzero(ids >= FIRST_RESERVED)
    yield from np.split(ids, np.unique(np.concatenate([cuts, cuts + 1])))


def _print(coder: tiktoken.Encoding, ids: np.ndarray) -> str:
    if len(ids) and ids[0] >= FIRST_RESERVED:
        return PRINTED[ids[0] - FIRST_RESERVED]
    return coder.decode(ids.tolist())


def read_turns(ids: np.ndarray, mask: np.ndarray, path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(role, text) of each turn, and the texts under the mask, from a formatted segment's ids."""
    coder = _encoding(path)
    names = {i: r for r, i in ROLES.items()}
    turns, learned, start, role = [], [], 0, ""
    for at in np.flatnonzero(ids >= FIRST_RESERVED).tolist():
        if ids[at] in names or ids[at] == OTHER:
            role, start = names.get(int(ids[at]), ""), at + 1
        elif ids[at] == ROLE_END:
            role, start = unescape(coder.decode(ids[start:at].tolist())), at + 1
        else:
            turns.append((role, unescape(coder.decode(ids[start:at].tolist()))))
            under = ids[start:at][mask[start:at] > 0]
            if len(under):
                learned.append(unescape(coder.decode(under.tolist())))
    return turns, learned


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def chat_digests(formatted: DataFrame, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``format_chats``.

    The segments of a conversation have to stand in order in one partition, as ``format_chats`` gives them; anything else
    is refused. Rows that were stored get there by repartition("conv_id") and sortWithinPartitions("conv_id", "segment").
    """
    formatted.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, said, loss = None, 0, hashlib.sha256(), hashlib.sha256()

        def ended() -> dict:
            return now | {"turns_sha256": said.hexdigest(), "loss_sha256": loss.hexdigest()}

        for batch in batches:
            out = []
            for rows in slices(batch, "formatted"):
                for conv, number, ids, mask, text in zip(*[rows.column(c).to_pylist() for c in ("conv_id", "segment", "input_ids", "loss_mask", "formatted")], strict=True):
                    if number == 0:
                        out += [] if now is None else [ended()]
                        now, said, loss = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}, hashlib.sha256(), hashlib.sha256()
                    elif now is None or (conv, number) != (now["conv_id"], last + 1):
                        raise ValueError(f"segment {number} of conversation {conv} doesn't follow the one before it")
                    last = number
                    turns, learned = read_turns(np.array(ids, dtype=np.int32), np.array(mask, dtype=np.int8), SparkFiles.get(name))
                    said.update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                    loss.update("".join(learned).encode())
                    now["n_turns"] += len(turns)
                    now["loss_chars"] += sum(map(len, learned))
                    now["formatted_chars"] += len(text)
            yield pa.RecordBatch.from_pylist(out, schema=DIGESTS)
        if now is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema=DIGESTS)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
