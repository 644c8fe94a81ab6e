"""Contiguous shards of near-equal bytes by global prefix sums, in DataFrame functions only.

Rows are dealt to ranges of their order; each range's totals are summed (one row a range), running sums of those totals
give where each range starts, and running sums inside a range give where each row stands among all. The shards are that
line cut at equal distances. No task sees more than its own range, and only the totals are ever in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise

LAW = "bytes"
#: Rows of a range, about.
RANGE_ROWS = 250_000


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text).

    size: UTF-8 bytes of the text (null: none) plus 1. Rows stand in order of doc_id (null first), then of the text's
    checksum and size; a row belongs to the shard in which its middle byte lies, so shard sizes differ from their mean by
    less than the largest row. slot counts a shard's rows from 0 without gaps; grown_shard is null, as the law is
    ``bytes``. Repeated rows get slots of their own. A shard that one very large row covers may be empty. No rows give
    no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialise(rows)
    ranges = max(16, rows.count() // RANGE_ROWS)
    dealt = materialise(rows.repartitionByRange(ranges, "doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id()))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(so_far), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(so_far), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("total"))
    inside = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("own_before", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("own_row", F.row_number().over(inside) - 1).join(starts, "part")
    middle = F.expr(f"({shards}L * ((bytes_before + own_before) * 2 + size)) div (2L * total)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("own_row")).alias("row")))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
