"""How a file's bytes are text, judged by Spark over whole files of any size, and lines read in that encoding.

Files are read as lines of raw bytes, block by block; what the judgement needs are sums and conjunctions over lines, one row a
file. The reader itself drops a UTF-8 byte order mark, so its trace is that the file is three bytes longer than its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Control characters that text has none of, and how many make a file binary.
CONTROLS = r"[\x00-\x08\x0B\x0E-\x1F\x7F]"
MOST_CONTROLS, CONTROL_SHARE = 8, 0.01
ENCODINGS = ("utf-8", "utf-16le", "utf-16be", "windows-1252")
#: Bytes 80 to 9F of Windows-1252 that stand for a character, and those that don't.
_HIGH = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
UNDEFINED = "".join(chr(b) for b, c in _HIGH.items() if not c)
#: A UTF-16 file is read whole by one task; a larger one is refused.
MOST_WHOLE = 1 << 30


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("block"), "value")


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """file, size, encoding, bom, needs_confirmation, refusal and evidence of every file at ``path``.

    A byte order mark decides. Without one, NUL bytes or many control characters are binary content; else valid UTF-8 is UTF-8, and
    other bytes are Windows-1252 if it defines them all, which has to be confirmed. encoding is null where refusal
    (``utf-32``, ``binary``, ``undefined-bytes``) says why. An empty file has no row.
    """
    value, raw = F.col("value"), F.col("value").cast("binary")
    latin = F.decode(raw, "ISO-8859-1")
    valid = F.is_valid_utf8(value)
    head = F.min_by(F.hex(F.substring(raw, 1, 4)), F.when(F.col("block") == 0, F.col("at")))
    facts = _raw_lines(spark, path).groupBy("file").agg(
        head.alias("head"),
        F.max("size").alias("size"),
        (F.max("size") - F.sum(F.octet_length(value) + 1)).alias("beyond"),
        F.bool_or(F.contains(value, F.lit("\0"))).alias("nul"),
        F.sum(F.regexp_count(value, F.lit(CONTROLS))).alias("controls"),
        F.bool_and(valid).alias("valid"),
        F.bool_or(F.when(~valid, latin.rlike(f"[{UNDEFINED}]")).otherwise(False)).alias("undefined"),
    )
    mark = F.when(F.col("beyond").isin(2, 3), "utf-8").when(F.col("head").isin("FFFE0000", "0000FEFF"), "utf-32").when(F.startswith("head", F.lit("FFFE")), "utf-16le").when(F.startswith("head", F.lit("FEFF")), "utf-16be")
    rows = facts.withColumn("mark", mark)
    binary = F.col("nul") | ((F.col("controls") > MOST_CONTROLS) & (F.col("controls") > F.col("size") * CONTROL_SHARE))
    open_ = F.col("mark").isNull()
    refusal = F.when(F.col("mark") == "utf-32", "utf-32").when(open_ & binary, "binary").when(open_ & ~F.col("valid") & F.col("undefined"), "undefined-bytes")
    rows = rows.withColumn("refusal", refusal)
    found = F.when(F.col("refusal").isNull(), F.coalesce(F.col("mark"), F.when(~F.col("valid"), "windows-1252"), F.lit("utf-8")))
    rows = rows.withColumn("encoding", found)
    evidence = (
        F.when(F.col("mark") == "utf-8", "UTF-8 byte order mark").when(F.col("mark") == "utf-32", "UTF-32 byte order mark").when(F.col("mark") == "utf-16le", "UTF-16 little-endian byte order mark").when(F.col("mark") == "utf-16be", "UTF-16 big-endian byte order mark")
        .when(F.col("refusal").isNotNull() & F.col("nul"), "NUL bytes: binary content").when(F.col("refusal") == "binary", "many control characters: binary content")
        .when(F.col("refusal") == "undefined-bytes", "bytes that are undefined in every supported encoding")
        .when(F.col("encoding") == "windows-1252", "not valid UTF-8; bytes are consistent with Windows-1252 (needs confirmation)").otherwise("valid UTF-8")
    )
    return rows.select("file", "size", "encoding", F.col("mark").isNotNull().alias("bom"), (F.coalesce("encoding", F.lit("")) == "windows-1252").alias("needs_confirmation"), "refusal", evidence.alias("evidence"))


def settled_encoding(spark: SparkSession, path: str) -> str:
    """The one encoding of all files at ``path``; a file that is refused or needs confirmation, or two that differ, are an error."""
    found = detect_encodings(spark, path)
    doubt = found.where("refusal is not null or needs_confirmation").orderBy("file").select("file", "evidence").limit(1).collect()
    if doubt:
        raise ValueError(f"{doubt[0]['file']}: {doubt[0]['evidence']}")
    kinds = [r["encoding"] for r in found.select("encoding").distinct().orderBy("encoding").collect()]  # four at most
    if len(kinds) > 1:
        raise ValueError(f"files in {' and '.join(kinds)}: read them apart")
    return kinds[0] if kinds else "utf-8"


def cp1252_text(raw: Column) -> Column:
    """The text of Windows-1252 bytes; an error where a byte stands for nothing."""
    latin = F.decode(raw, "ISO-8859-1")
    known = {chr(b): c for b, c in _HIGH.items() if c}
    text = F.translate(latin, "".join(known), "".join(known.values()))
    return F.when(latin.rlike(f"[{UNDEFINED}]"), F.raise_error(F.lit("a byte that Windows-1252 doesn't define"))).otherwise(text)


def text_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """file, block (its first byte) and value of every line, in order inside a block, without line ends and byte order mark.

    A UTF-16 file is one block. Bytes that are no text in the encoding are an error.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"not an encoding: {encoding!r}")
    if encoding.startswith("utf-16"):
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
        odd = F.when((F.col("length") > MOST_WHOLE) | (F.col("length") % 2 == 1), F.raise_error(F.concat("file", F.lit(": a UTF-16 file of an odd length, or too long for one task"))))
        text = F.regexp_replace(F.decode(F.coalesce(odd, F.col("content")), {"utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}[encoding]), "^﻿", "")
        lines = F.split(text, "\r\n|\r|\n", -1)
        whole = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
        return files.select("file", F.lit(0).cast("long").alias("block"), F.explode(whole).alias("value"))
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    text = cp1252_text(F.col("value").cast("binary")) if encoding == "windows-1252" else F.validate_utf8("value")
    return raw.select("file", "block", F.regexp_replace(text, "\r\\z", "").alias("value"))
