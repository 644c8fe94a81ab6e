"""What a raw table's values say: distinct values, presets, currencies, known words, places; all rows count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import presets as ps
from ..functions.text import place_key, trimmed
from .shipments import location_keys, sent_if_few

# Words of sources for the canonical statuses, and words with more than one meaning.
STATUS_WORDS = {
    "in_transit": ("in transit", "shipped", "dispatched", "en route", "on the way", "out for delivery", "departed", "en transito", "unterwegs", "dang van chuyen", "en transit", "en cours"),
    "delivered": ("delivered", "completed", "complete", "received", "pod", "entregado", "geliefert", "da giao", "livre"),
    "pending": ("pending", "booked", "created", "open", "planned", "scheduled", "awaiting pickup", "processing", "new", "pendiente", "offen", "cho xu ly", "en attente"),
    "cancelled": ("cancelled", "canceled", "void", "cancelado", "storniert", "da huy", "annule"),
}
AMBIGUOUS_WORDS = ("arrived", "picked up", "loaded", "on hold", "exception", "delayed", "returned", "partially delivered", "closed", "rejected")


def distinct_values(rows: DataFrame, column: str, order: str = "line", by: Sequence[str] = ()) -> DataFrame:
    """value, count and first (the lowest ``order``) of every trimmed text that isn't blank; for each group of the columns ``by``."""
    # equal texts are counted first; what comes after, filters of values too, is then not worked out for every row
    raw = rows.groupBy(*by, F.col(column).alias("raw")).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return _once(raw, {"value": trimmed(F.col("raw"))}).where("value <> ''").groupBy(*by, "value").agg(F.sum("n").alias("count"), F.min("at").alias("first"))


def _once(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``rows`` with more columns, worked out once a row: the optimizer puts a projection's expressions wherever what follows
    names them, and the code made of that can be too large to compile; it leaves what a generator gives alone."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _marked(values: DataFrame) -> DataFrame:
    """``values`` with bare and mark, by ``marked_number``."""
    ended = _once(_once(values, {"text": trimmed(F.col("value"))}), ps.mark_ends(F.col("text")))
    bare, mark = ps.marked(*[F.col(c) for c in ("text", "negative", "body", "head", "tail")])
    return _once(ended, {"bare": bare, "mark": mark}).drop("text", "negative", "body", "head", "tail")


def _decided(real: DataFrame, normal: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """``by``, kind, preset, among, examined, unfit, distinct, touched of the values that aren't blank (value, count); one row without ``by``.

    ``normal``: what each preset makes of a value. kind: none (nothing fits, or more than half of all don't), mixed (no preset fits
    every usable value), unique, equivalent (several fit and say the same) or ambiguous. All values count; they are aggregated.
    """
    presets = list(normal)
    read = _once(real, normal)
    fits = F.coalesce(*[F.col(p) for p in presets]).isNotNull()
    all_fit = [F.bool_and(F.when(fits, F.col(p).isNotNull())).alias(f"{p}_fits") for p in presets]
    same = [F.bool_and(F.when(fits, F.col(p).eqNullSafe(F.col(q)))).alias(f"{p}_{q}") for i, p in enumerate(presets) for q in presets[i + 1 :]]
    touched = [F.coalesce(F.bool_or(F.when(fits, F.col(p) != F.col("value"))), F.lit(False)).alias(f"{p}_touched") for p in presets]
    sums = read.groupBy(*by).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("examined"), F.coalesce(F.sum(F.when(~fits, F.col("count"))), F.lit(0)).alias("unfit"), F.count("*").alias("distinct"), *all_fit, *same, *touched)
    common = F.array_compact(F.array(*[F.when(F.col(f"{p}_fits"), p) for p in presets]))
    agree = F.lit(True)
    for i, p in enumerate(presets):
        for q in presets[i + 1 :]:
            agree = agree & (~F.col(f"{p}_fits") | ~F.col(f"{q}_fits") | F.col(f"{p}_{q}"))
    usable = (F.col("examined") > F.col("unfit")) & (F.col("unfit") * 2 <= F.col("examined"))
    out = sums.withColumn("among", F.when(usable, common).otherwise(F.array().cast("array<string>")))
    many = F.size("among")
    kind = F.when(~usable, "none").when(many == 0, "mixed").when(many == 1, "unique").when(agree, "equivalent").otherwise("ambiguous")
    out = out.withColumn("kind", kind).withColumn("preset", F.when(F.col("kind").isin("unique", "equivalent"), F.get("among", F.lit(0))))
    chosen = F.coalesce(*[F.when(F.col("preset") == p, F.col(f"{p}_touched")) for p in presets])
    return out.select(*by, "kind", "preset", F.array_join("among", ",").alias("among"), "examined", "unfit", "distinct", F.coalesce(chosen, F.lit(False)).alias("touched"))


def number_preset(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The preset that reads a column of numbers; ``by``: columns that tell one column's values from another's."""
    real = values.where(ps.blank_kind(F.col("value")).isNull())
    return _decided(_marked(real), {p: ps.plain_number(F.col("bare"), p) for p in ps.NUMBER_PRESETS}, by)


def date_preset(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    real = values.where(ps.blank_kind(F.col("value")).isNull())
    return _decided(real, {p: ps.date_text(F.col("value"), p) for p in ps.DATE_PRESETS}, by)


def _currencies(values: DataFrame) -> DataFrame:
    """``values`` with the mark of those that are numbers under some preset, null for others."""
    read = F.coalesce(*[ps.plain_number(F.col("bare"), p) for p in ps.NUMBER_PRESETS])
    return _marked(values).withColumn("mark", F.when(read.isNotNull(), F.col("mark")))


def currency_scan(values: DataFrame) -> DataFrame:
    """mark and how many values carry it, of the values that are numbers under some preset."""
    return _currencies(values).where("mark is not null").groupBy("mark").agg(F.sum("count").alias("values"))


def _judged(seen: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = seen.groupBy(*by).agg(F.array_sort(F.collect_set("mark")).alias("seen"))  # one for each currency
    foreign = F.filter("seen", lambda m: m != "USD")
    return sums.select(*by, F.when(F.size(foreign) == 0, "ok").when(F.size("seen") > 1, "mixed").otherwise("foreign").alias("kind"), F.array_join(foreign, ",").alias("marks"))


def currency_decision(scan: DataFrame) -> DataFrame:
    """One row: ``ok`` if no mark but USD stands in the column, else ``foreign`` or (with others beside it) ``mixed``, and the marks."""
    return _judged(scan, ())


def currency_decisions(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """``currency_decision`` of each column that ``by`` tells from others, those without marks too."""
    return _judged(_currencies(values), by)


def status_map(values: DataFrame) -> DataFrame:
    """value, count, target (a canonical status, null where the user must choose) and ambiguous."""
    words = [F.lit(x) for status, known in STATUS_WORDS.items() for word in known for x in (word, status)]
    key = ps.value_key(F.col("value"))
    target = F.try_element_at(F.create_map(*words), key)
    return values.select("value", "count", target.alias("target"), (target.isNull() & key.isin(*AMBIGUOUS_WORDS)).alias("ambiguous"))


def warehouse_keys(locations: DataFrame) -> DataFrame:
    """key, target, by: what names a warehouse: its code, its code without ``WH-``, or its name, in this order."""
    code = F.col("code")
    ways = F.array(*[F.struct(F.lit(i).alias("rank"), ps.value_key(text).alias("key"), F.lit(by).alias("by")) for i, (by, text) in enumerate((("code", code), ("alias", F.regexp_replace(code, "^WH-", "")), ("name", F.col("name"))))])
    every = locations.where("kind = 'warehouse'").select("code", "_ord", F.inline(ways))
    return every.groupBy("key").agg(F.min_by(F.struct("code", "by"), F.struct("rank", F.col("_ord") * -1)).alias("at")).select("key", F.col("at.code").alias("target"), "at.by")


def warehouse_map(values: DataFrame, locations: DataFrame) -> DataFrame:
    """value, count, target (a warehouse code, null where the user must choose) and by."""
    keys = sent_if_few(warehouse_keys(locations))
    return values.withColumn("key", ps.value_key(F.col("value"))).join(keys, "key", "left").select("value", "count", "target", "by")


def located_values(values: DataFrame, locations: DataFrame) -> DataFrame:
    """value, count, code of the place that a value names, and rewrite (the code that a short form of a warehouse means)."""
    places = sent_if_few(location_keys(locations)).select("place", "code")
    known = values.withColumn("place", place_key(F.col("value"))).join(places, "place", "left")
    other = warehouse_map(known.where("code is null"), locations).select("value", F.col("target").alias("rewrite"))
    return known.join(other, "value", "left").select("value", "count", "first", "code", "rewrite")


def location_summary(located: DataFrame) -> DataFrame:
    """One row: rows, those whose place is known, those that stay unmapped, and distinct unmapped values."""
    open_ = F.col("code").isNull() & F.col("rewrite").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return located.agg(zero(F.sum("count")).alias("rows"), zero(F.sum(F.when(~open_, F.col("count")))).alias("recognized"), zero(F.sum(F.when(open_, F.col("count")))).alias("unmapped"), F.count_if(open_).alias("unmapped_values"))


def column_profile(rows: DataFrame, columns: Sequence[str], order: str = "line") -> DataFrame:
    """Of each text column: rows, filled cells, distinct values and cells by what they look like, average length, top value.

    Cells are counted by column and value first; shapes are then read from distinct values. A date is no number.
    """
    cells = rows.select(F.col(order).alias("at"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), trimmed(F.coalesce(F.col(c), F.lit(""))).alias("value")) for c in columns])))
    counted = cells.groupBy("column", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    value = F.col("value")
    is_date = F.coalesce(*[ps.date_text(value, p) for p in ps.DATE_PRESETS]).isNotNull()
    bare, _ = ps.marked_number(value)
    read = F.array_compact(F.array(*[ps.plain_number(F.col("bare"), p) for p in ps.NUMBER_PRESETS]))
    shaped = counted.withColumn("filled", ps.blank_kind(value).isNull()).withColumn("is_date", F.col("filled") & is_date).withColumn("bare", bare).withColumn("numbers", read)
    shaped = shaped.withColumn("is_number", F.col("filled") & ~F.col("is_date") & (F.size("numbers") > 0))
    some = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    top = F.max_by(F.when(F.col("filled"), value), F.when(F.col("filled"), F.struct(F.col("n"), F.col("first") * -1)))
    return shaped.groupBy("column").agg(
        F.sum("n").alias("rows"), some(F.col("filled")).alias("filled"), F.count_if("filled").alias("distinct"), some(F.col("is_date")).alias("dates"), some(F.col("is_date") & ps.date_text(value, "iso").isNotNull()).alias("iso_dates"),
        some(F.col("is_number")).alias("numbers"), some(F.col("is_number") & F.exists("numbers", lambda x: x.rlike(r"^-?\d+\z"))).alias("integers"),
        some(F.col("filled") & ~F.col("is_number") & ~F.col("is_date") & value.rlike(r"\p{L}")).alias("texts"), some(F.col("filled") & value.rlike(r"^[A-Za-z0-9][A-Za-z0-9-]{2,31}\z")).alias("ids"),
        F.coalesce(F.sum(F.when(F.col("filled"), F.length(value) * F.col("n"))), F.lit(0)).alias("characters"), top.alias("top"),
    )
