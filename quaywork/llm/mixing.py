"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws an exponential key, -ln(u) / weight; the smallest keys of a source are a sample without replacement
in which heavier (better) documents come first more often. A source's budget is first spent on complete epochs; the
rest goes to documents in key order until their sizes fill it.

No source is ever sorted as a whole. Keys are mapped to [0, 1) and cut into bins; sums by (source, bin) say which bin
the budget ends in, that bin alone is cut again, and only the few rows of the last bin are put in order. Each level is
one pre-aggregated sum of at most ``BINS`` rows a source, so a source with a third of all rows costs no more per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise

#: Bins of each of the two levels.
BINS = 4096
#: Sources up to which their targets are broadcast: a row of about 100 bytes each.
BROADCAST_SOURCES = 10_000
#: The words of a text.
WORD = r"[^\x20\x09-\x0D]+"
NO_SOURCE = "\U0010ffff"


def words_of(text):
    """Number of words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(column, seed: int):
    """A number in (0, 1) that depends on the value as text and on the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """source, source_size, target from (source, source_size); sources in code point order, null last, take ``weights``
    in turn. They share ``share`` of all sizes; no target exceeds ``most`` times its source, what is over going to the
    others by weight until none is above. That limit is reached in closed form: with sources in order of the level at
    which each is full, the level of those that aren't is what the full ones leave, by the weight of the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    named = sizes.select("source", "source_size").withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    full_at = F.col("cap") / F.col("weight")
    in_turn = Window.orderBy(full_at, F.col("source").isNull(), "source")
    before = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    level = (F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = named.withColumn("full_at", full_at).withColumn("level", level)
    # the first source, by fullness, whose level leaves it room fixes the level of all after it
    fixed = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everyone)["level"]
    return levels.select("source", "source_size", F.least("cap", F.coalesce(fixed * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, quality: str | None = None, seed: int = 17, size: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document; ``taken`` = size * copies.

    ``docs`` needs doc_id, text and source, and ``quality``, if named, a column of positive weights (null or less: 1).
    size: words of the text, 0 where it is null; or what the column named by ``size`` holds, so that what ``docs`` was
    joined with doesn't have to move texts. A source gets floor(target / source_size) complete epochs; of what is
    left, documents in key order are taken while at least half of each still fits, so a source's sum is within half a
    document of its target. Equal keys (repeated rows) go in order of size and doc_id. A source without words takes
    nothing; a null source is one of its own. The same rows give the same mix on every run. No rows give no rows.
    """
    weight = F.lit(1.0) if quality is None else F.when(F.col(f"`{quality}`") > 0, F.col(f"`{quality}`").cast("double")).otherwise(1.0)
    # 1 - u^(1/w) rises with the exponential key -ln(u)/w and lies in [0, 1)
    key = 1 - F.pow(uniform(F.col("`doc_id`"), seed), 1 / weight)
    rows = materialise(docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`source`").alias("source"), (words_of(F.col("`text`")) if size is None else F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long")).alias("size"), key.alias("key")))
    rows = rows.withColumn("first_bin", F.floor(F.col("key") * BINS).cast("int")).withColumn("second_bin", F.floor(F.col("key") * BINS * BINS % BINS).cast("int"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    budget = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    budget = materialise(budget)

    def last_bin(sums: DataFrame, room: DataFrame, bin_name: str) -> DataFrame:
        """For each source the bin in which its room ends and the room left at that bin's start."""
        run = Window.partitionBy("source").orderBy(bin_name)
        reached = sums.join(room, sums["source"].eqNullSafe(room["of"])).withColumn("upto", F.sum("size").over(run)).withColumn("at", F.col("upto") - F.col("size"))
        # the first bin in which the sum passes the room, if any
        return reached.where("upto > room").groupBy("of").agg(F.min(F.struct(bin_name, (F.col("room") - F.col("at")).alias("room"))).alias("m")).select("of", F.col(f"m.{bin_name}").alias(bin_name), "m.room")

    room = budget.select(F.col("source").alias("of"), F.col("rest").alias("room"))
    first = last_bin(rows.groupBy("source", "first_bin").agg(F.sum("size").alias("size")), room, "first_bin")
    first = first.select("of", F.col("first_bin").alias("first_end"), "room")
    inside = rows.join(first, rows["source"].eqNullSafe(first["of"]) & (F.col("first_bin") == F.col("first_end")), "left_semi")
    second = last_bin(inside.groupBy("source", "second_bin").agg(F.sum("size").alias("size")), first.select("of", "room"), "second_bin")
    ends = first.select("of", "first_end").join(second.select(F.col("of").alias("of2"), F.col("second_bin").alias("second_end"), F.col("room").alias("last_room")), F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2")
    ends = budget.join(ends, budget["source"].eqNullSafe(ends["of"]), "left").drop("of").withColumnRenamed("source", "of")
    # a row for each source; beyond the bound Spark chooses, and splits hot sources itself
    if budget.count() <= BROADCAST_SOURCES:
        ends = F.broadcast(ends)

    placed = rows.join(ends, rows["source"].eqNullSafe(ends["of"])).drop("of")
    place = F.when(F.col("first_end").isNull() | (F.col("first_bin") < F.col("first_end")), -1).when(F.col("first_bin") > F.col("first_end"), 1)
    place = place.when(F.col("second_end").isNull() | (F.col("second_bin") < F.col("second_end")), -1).when(F.col("second_bin") > F.col("second_end"), 1).otherwise(0)
    placed = placed.withColumn("place", place)
    last = Window.partitionBy("source").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(last), F.lit(0))
    edge = placed.where("place = 0").withColumn("extra", ((at + F.col("size") / 2.0 <= F.col("last_room")) & (F.col("rest") > 0)).cast("int"))
    plain = placed.where("place <> 0").withColumn("extra", ((F.col("place") < 0) & (F.col("rest") > 0)).cast("int"))
    copies = F.col("epochs") + F.col("extra")
    return plain.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, quality: str | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it. Rows that share a doc_id and size share their copies."""
    return repeated(docs, mix(docs, weights, share, most, quality, seed))


def repeated(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan``, what ``mix`` gave for them, takes it."""
    repeats = plan.where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).toDF(*[f"__mix_{c}" for c in ("id", "source", "size", "copies")])
    sized = docs.withColumn("__mix_words", words_of(F.col("`text`")))
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_words") == F.col("__mix_size"))
    joined = sized.join(repeats, same)
    return joined.withColumn("__mix_copy", F.explode(F.expr("sequence(1, __mix_copies)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
