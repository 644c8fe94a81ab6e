"""Interaction audit of filters: what each removes in every order, and its Shapley share, from counts of failure masks.

Each document fails some of the filters, a mask of bits. With x_i the chance that filter i is applied, the expected number
of documents removed is a polynomial that is linear in every x_i: a document with mask m is removed unless none of m's
filters is applied, 1 - prod(1 - x_i for i in m). Summed over documents, the coefficient of the monomial S is
(-1)^(|S|+1) times the number of documents whose mask holds S. A filter's Shapley value is the integral of the partial
derivative along the diagonal x = (t, ..., t), where the monomial S gives t^(|S|-1): 1/|S|, exact in the fractions
k!/|S| of k!. The polynomial's value at a corner, x_i in {0, 1}, is the number removed by that set of filters, so all orders
are read off 2^k corners. Only masks are counted over documents; the rest works on at most 2^k rows a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialise, pick

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: What is counted in each part: all documents, and those labelled so.
MEASURES = ("all", "good", "toxic")


def text_failures() -> list[Column]:
    """Failures A to D of the column ``text`` (null: empty): few words, repeated words, capitals, marks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, lang and mask (bit i: fails the i-th of FILTERS) of every row of ``docs`` (doc_id, text, lang).

    E, a copy: some row with a smaller doc_id has the same text. Rows without doc_id are no copies and have none. Texts are
    compared by SHA-256. Repeated rows fail alike; a null text is the empty text.
    """
    bits = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_failures())), F.lit(0))
    rows = materialise(pick(docs, "doc_id", "lang", "text").select("doc_id", "lang", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), bits.alias("mask")))
    # a table, so that the join has plain exchanges on both sides and a text with very many copies is split there
    copied = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(copied, "digest", "left").select("doc_id", "lang", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def removal_polynomials(counts: DataFrame, filters: int) -> DataFrame:
    """The coefficients of each part's removal polynomials: part, total, own and coefficients.

    ``counts``: part, mask and a long column for each of MEASURES. coefficients.<measure>[S] belongs to the monomial of set S
    (0 at the empty set); own[m] is the number of documents whose mask is m.
    """
    subsets = F.expr(f"filter(sequence(1, {2**filters - 1}), s -> (s & mask) = s)")
    sign = F.when(F.bit_count("subset") % 2 == 1, 1).otherwise(-1)
    spread = counts.select("*", F.explode_outer(subsets).alias("subset"))
    terms = spread.where("subset is not null").groupBy("part", "subset").agg(*[F.sum(sign * F.col(m)).alias(m) for m in MEASURES])
    listed = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, F.col(value)))).alias(value)
    dense = lambda kept: F.expr(f"transform(sequence(0, {2**filters - 1}), s -> coalesce(try_element_at({kept}, s), 0L))")
    of_masks = counts.groupBy("part").agg(F.sum("all").alias("total"), listed("mask", "all")).select("part", "total", dense("`all`").alias("own"))
    of_terms = terms.groupBy("part").agg(*[listed("subset", m) for m in MEASURES])
    return of_masks.join(of_terms, "part", "left").select("part", "total", "own", F.struct(*[dense(f"`{m}`").alias(m) for m in MEASURES]).alias("coefficients"))


def audit_orders(polynomials: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders."""
    k = len(names)
    corner = lambda m: F.expr(f"transform(sequence(0, {2**k - 1}), t -> aggregate(sequence(0, {2**k - 1}), 0L, (sum, s) -> sum + if((s & t) = s, coefficients.`{m}`[s], 0L)))")
    share = f"aggregate(sequence(1, {2**k - 1}), 0L, (sum, s) -> sum + if(getbit(s, i) = 1, coefficients.`all`[s] * ({factorial(k)} div bit_count(s)), 0L))"
    shares = F.expr(f"transform(sequence(0, {k - 1}), i -> {share})")
    parts = polynomials.select("part", "total", "own", shares.alias("shapley"), *[corner(m).alias(m) for m in MEASURES])
    steps = [(order, n + 1, sum(1 << names.index(c) for c in order[:n]), names.index(order[n])) for order in map("".join, permutations(names)) for n in range(k)]
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(i).alias("i")) for o, s, b, i in steps])
    rows = parts.select("*", F.inline(table))
    bit = F.expr("shiftleft(1, i)")
    at = lambda m, where: F.get(F.col(m), where)
    lost = lambda m: at(m, F.col("before") + bit) - at(m, F.col("before"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - at("all", F.col("before") + bit)).alias("kept"),
        lost("all").alias("removed"),
        (at("all", bit) - lost("all")).alias("redundant"),
        at("own", bit).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        at("shapley", F.col("i")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` (doc_id, text, lang) by lang, with ``labels`` (doc_id, quality, toxic).

    One row for each part, order of the filters and step; a part is a value of lang, null counting as the empty one. A
    document is good or toxic if any of its labels says 1; labels without doc_id count for nothing. All numbers are long.
    Other columns are ignored; no documents give no rows.
    """
    known = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    told = materialise(known.where("good = 1 or toxic = 1"))
    measured = failure_masks(docs).join(told, "doc_id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = measured.groupBy(F.coalesce("lang", F.lit("")).alias("part"), "mask").agg(F.count("*").alias("all"), count("good").alias("good"), count("toxic").alias("toxic"))
    return audit_orders(removal_polynomials(counts, len(FILTERS)), FILTERS)
