"""Delimited text as a Spark job: files are split and read in parallel, and still every record knows its first line.

Where a quote counts only at a cell's start, the quotes before a block don't tell whether it starts inside a cell. So each line is a map
from how it may start (outside quotes, or inside) to how it ends, which patterns give without knowing the start; a block's map
is that of its lines one after the other. One row for each block, its map and its number of lines, is all that moves: a scan over
those rows tells how each block starts and which line it starts on. Then blocks are read again and cut into records at
once; only the pieces of a record that lies in several blocks are brought together. Nothing is read whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .encoding import settled_encoding, text_lines

#: Most blocks whose starts (some 60 bytes each) are broadcast; beyond it they are joined by their key.
MOST_BROADCAST = 1 << 20


class Grammar:
    """Patterns (Java's) of cells and lines for one delimiter."""

    def __init__(self, delimiter: str):
        if len(delimiter) != 1 or delimiter in '"\r\n':
            raise ValueError(f"not a delimiter: {delimiter!r}")
        self.delimiter = delimiter
        d = rf"\x{{{ord(delimiter):x}}}"
        quoted = r'"[^"]*+(?:""[^"]*+)*+'  # without its closing quote
        body = r'[^"]*+(?:""[^"]*+)*+'
        self.quoted = rf"(?s)^{quoted}\"(.*)\z"
        #: a cell in which a quote after the first or after a closing one is a character as any other
        self.cell = rf'(?:{quoted}"[^{d}]*+|(?!")[^{d}]*+)'
        cells = rf"(?:{self.cell}{d})*+"
        #: whether a line ends inside quotes, if it starts outside, and if it starts inside
        self.opens = rf"^{cells}{quoted}\z"
        self.stays = rf'^{body}(?:"[^{d}]*+{d}{cells}{quoted})?\z'
        strict = rf'(?:{quoted}"|[^"{d}]*+)'
        #: whether every quote of a line stands where it may, by how the line starts
        self.tidy_outside = rf"^(?:{strict}{d})*+(?:{strict}|{quoted})\z"
        self.tidy_inside = rf'^{body}(?:"(?:{d}{strict})*+(?:{d}{quoted})?)?\z'

    def cells(self, record: Column) -> Column:
        """The cells of a whole record; quotes around a cell go, ``""`` inside them is a quote, what follows them stays."""
        raw = F.regexp_extract_all(F.concat(F.lit(self.delimiter), record), F.lit(rf"(?s)\x{{{ord(self.delimiter):x}}}({self.cell})"), F.lit(1))
        rest = lambda c: F.regexp_extract(c, self.quoted, 1)
        inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - F.length(rest(c)) - 2), F.lit('""'), F.lit('"'))
        return F.transform(raw, lambda c: F.when(F.startswith(c, F.lit('"')), F.concat(inner(c), rest(c))).otherwise(c))


def states(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line starts inside quotes, and last whether what follows does; from the lines' maps and the first state.

    A line with one end whatever its start settles the state; one whose end is its start's opposite turns it. So a state is that
    of the last settling line before it, turned as often as lines after that turn it.
    """
    settles, turned = opens == stays, np.concatenate([[0], np.cumsum(opens & ~stays)])
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(settles, np.arange(len(opens)), -1))]).astype(np.int64)
    base = np.where(last >= 0, opens[last] if len(opens) else False, inside)
    since = turned - np.where(last >= 0, turned[last], 0)
    return base ^ (since % 2 == 1)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(key, whether the block goes on from the piece before, rows) of the pieces of blocks that batches hold."""
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        other = (np.diff(blocks) != 0) | pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = (files[a].as_py(), int(blocks[a]))
            yield now, now == key, batch.slice(a, b - a)
            key = now


def _flags(piece: pa.RecordBatch, name: str) -> np.ndarray:
    return piece.column(name).to_numpy(zero_copy_only=False)


TOTALS = "file string, block long, lines long, opens boolean, stays boolean, out_start long, in_start long, out_bad long, in_bad long"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its lines, its map, and for either start the last line that begins a record and the first untidy one."""
    schema = pa.schema([("file", "string"), ("block", "int64"), ("lines", "int64"), ("opens", "bool"), ("stays", "bool"), ("out_start", "int64"), ("in_start", "int64"), ("out_bad", "int64"), ("in_bad", "int64")])
    block: dict = {}
    for (file, start), goes_on, piece in _by_block(batches):
        if not goes_on:
            if block:
                yield pa.RecordBatch.from_pylist([block], schema)
            block = {"file": file, "block": start, "lines": 0, "opens": False, "stays": True, "out_start": None, "in_start": None, "out_bad": None, "in_bad": None}
        for end, begun, bad in (("opens", "out_start", "out_bad"), ("stays", "in_start", "in_bad")):
            inside = states(_flags(piece, "opens"), _flags(piece, "stays"), block[end])
            starts = np.flatnonzero(~inside[:-1])
            untidy = np.flatnonzero(~np.where(inside[:-1], _flags(piece, "tidy_inside"), _flags(piece, "tidy_outside")))
            if len(starts):
                block[begun] = block["lines"] + int(starts[-1]) + 1
            if len(untidy) and block[bad] is None:
                block[bad] = block["lines"] + int(untidy[0]) + 1
            block[end] = bool(inside[-1])
        block["lines"] += piece.num_rows
    if block:
        yield pa.RecordBatch.from_pylist([block], schema)


def _starts(totals: DataFrame) -> DataFrame:
    """file, block, inside, lines_before, carried (line of the record that is open there), crossed (whether a record goes over one of
    its ends), left_open (line of the record open after a file's last block) and bad (line): the scan of the blocks' maps."""
    order = Window.partitionBy("file").orderBy("block")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    flag = lambda c: F.col(c).cast("int")
    rows = totals.withColumn("turns", F.sum(F.when(F.col("opens") & ~F.col("stays"), 1).otherwise(0)).over(so_far))
    rows = rows.withColumn("settled", F.when(F.col("opens") == F.col("stays"), flag("opens") + F.col("turns")))
    state = lambda w: (F.coalesce(F.last("settled", ignorenulls=True).over(w), F.lit(0)) + F.coalesce(F.max("turns").over(w), F.lit(0))) % 2 == 1
    rows = rows.withColumns({"inside": state(before), "ends_inside": state(so_far), "lines_before": F.coalesce(F.sum("lines").over(before), F.lit(0))})
    begun = F.col("lines_before") + F.when(F.col("inside"), F.col("in_start")).otherwise(F.col("out_start"))
    bad = F.col("lines_before") + F.when(F.col("inside"), F.col("in_bad")).otherwise(F.col("out_bad"))
    rows = rows.withColumns({"begun": begun, "bad": bad, "is_last": F.lead("block").over(order).isNull()})
    rows = rows.withColumns({"carried": F.last("begun", ignorenulls=True).over(before), "open_now": F.last("begun", ignorenulls=True).over(so_far)})
    return rows.select("file", "block", "inside", "lines_before", "carried", (F.col("inside") | F.col("ends_inside")).alias("crossed"), F.when(F.col("is_last") & F.col("ends_inside"), F.col("open_now")).alias("left_open"), "bad")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, line, part, text, whole: records, or the pieces of those that lie in several blocks, with the line each starts on."""
    held = None  # of the block's last record, if it isn't closed: values, line, part, whether it began in this block
    file, inside, lines = None, False, 0

    def batch(values: pa.Array, firsts: np.ndarray, ends: int, line: np.ndarray, part: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, ends), pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array([file] * len(firsts), pa.string()), pa.array(line, pa.int64()), pa.array(part, pa.int64()), pc.binary_join(lists, "\n"), pa.array(whole)], ["file", "line", "part", "text", "whole"])

    def left(rest: tuple) -> pa.RecordBatch:
        values, line, part, _ = rest
        return batch(values, np.array([0]), len(values), np.array([line]), np.array([part]), np.array([False]))

    for (name, _), goes_on, piece in _by_block(batches):
        if not goes_on:
            if held:
                yield left(held)
            file, held = name, None
            if piece.column("lines_before")[0].as_py() is None:
                raise ValueError(f"{name}: read in other blocks than before")
            inside, lines = piece.column("inside")[0].as_py(), piece.column("lines_before")[0].as_py()
            if inside:
                held = (piece.column("value").slice(0, 0), piece.column("carried")[0].as_py(), lines + 1, False)
        state = states(_flags(piece, "opens"), _flags(piece, "stays"), inside)
        skip = len(held[0]) if held else 0
        values = pa.concat_arrays([held[0], piece.column("value")]) if held else piece.column("value")
        begun = np.flatnonzero(~state[:-1])
        line = part = begun + lines + 1
        firsts, own = begun + skip, np.ones(len(begun), dtype=bool)
        if held:
            firsts, own = np.append(0, firsts), np.append(held[3], own)
            line, part = np.append(held[1], line), np.append(held[2], part)
        lines, inside = lines + piece.num_rows, bool(state[-1])
        n = len(firsts) - inside
        held = (values.slice(int(firsts[n])), int(line[n]), int(part[n]), bool(own[n])) if inside else None
        if n:
            yield batch(values, firsts[:n], int(firsts[n]) if inside else len(values), line[:n], part[:n], own[:n])
    if held:
        yield left(held)


def read_records(spark: SparkSession, path: str, delimiter: str = ",", strict: bool = False, encoding: str | None = "utf-8") -> DataFrame:
    """file, line, cells of every record of delimited text with text in it; header records are not told apart.

    A cell that begins with a quote lasts to the closing one; ``""`` in it is a quote, line breaks in it stay (as ``\\n``).
    Any other quote is a character of its cell, as is what follows a closing quote, but with ``strict`` a file that has such is
    refused. So is a file whose last quote is never closed. Lines end with LF, CRLF or CR; a byte order mark goes. A record has
    to fit a task, a file or block hasn't (but for UTF-16, see ``text_lines``). Empty files have no records. Without an
    ``encoding`` (None) it is detected, and files that leave a doubt are refused.
    """
    grammar = Grammar(delimiter)
    maps = lambda rows: rows.withColumns({"opens": F.col("value").rlike(grammar.opens), "stays": F.col("value").rlike(grammar.stays)})
    tidy = {"tidy_outside": F.col("value").rlike(grammar.tidy_outside), "tidy_inside": F.col("value").rlike(grammar.tidy_inside)} if strict else {"tidy_outside": F.lit(True), "tidy_inside": F.lit(True)}
    raw = text_lines(spark, path, encoding or settled_encoding(spark, path))
    starts = _starts(maps(raw).withColumns(tidy).drop("value").mapInArrow(_totals, TOTALS))
    known = starts.limit(MOST_BROADCAST + 1).toArrow()
    small = known.num_rows <= MOST_BROADCAST
    if small and known.num_rows:
        starts = spark.createDataFrame(known)
    wrong = F.least("bad", "left_open")
    first = starts.where(wrong.isNotNull()).select("file", wrong.alias("line"), F.col("bad").isNotNull().alias("stray")).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['file']}: a quote is {'out of place' if strict else 'never closed'} on line {first[0]['line']}")
    starts = starts.select("file", "block", "inside", "lines_before", "carried", "crossed")

    def pieces(of: DataFrame, how: str) -> DataFrame:
        ordered = raw.join(F.broadcast(of), ["file", "block"], how) if small else raw.withColumn("seq", F.monotonically_increasing_id()).join(of.hint("merge"), ["file", "block"], how).sortWithinPartitions("file", "block", "seq").drop("seq")
        return maps(ordered).mapInArrow(_pieces, "file string, line long, part long, text string, whole boolean")

    records = pieces(starts, "left").where("whole").select("file", "line", "text")
    crossed = starts.where("crossed")
    if not small or crossed.limit(1).count():  # else no block is read for pieces
        parts = pieces(crossed, "inner").where("not whole").groupBy("file", "line").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
        records = records.unionByName(parts.select("file", "line", F.array_join("parts.text", "\n").alias("text")))
    out = records.select("file", "line", grammar.cells(F.col("text")).alias("cells"))
    return out.where(F.exists("cells", lambda c: trimmed(c) != ""))


def read_strict_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, line, cells of every record of a comma-separated file in which every quote stands where it may."""
    return read_records(spark, path, strict=True)
