"""Size-aware heavy-light join of documents on the Jaccard likeness of their word n-gram sets.

Two sets of sizes a and b reach the threshold just if they share ``need(a, b)`` elements. A *light* set is so small that
listing all its subsets of the needed sizes is cheap; two light sets with a common subset link, without a look at the
rest. A *heavy* set is put in the inverted lists of its rarest elements only (enough of them that any partner shares
one), and lists are scanned with bounds on size and position before sets are compared. Light sets near the boundary
stand in the lists as well, for their heavy partners. The boundary is the size at which the expected work is least.

Only connectivity is asked for, so a list isn't expanded into its pairs: members are first compared with the list's
head, and only members that are then still in different components are compared with one another, unless sizes,
positions or parity sketches of the sets show that they can't link; a long list is dealt to blocks for that. No link
that could join two components is left out, and the groups found are exact (up to 64-bit hashes).

Style: Arrow and numpy make sets and list entries inside map tasks; lists, pairs and comparison are DataFrame joins,
which Spark splits where a key is hot. What is broadcast is bounded (``SLOTS`` counters,
``MOST_BITS`` bits); both only save work and never change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise, pick
from ._text import chain, give_back, mix, slices, word_hashes, words
from .components import connected_components

#: Counters of the frequency sketch that orders elements from rare to common. A hint: any order gives the same result.
SLOTS = 1 << 20
#: Most bits of a filter that keeps rows which nothing can match from being made; fuller filters let more through.
MOST_BITS = 1 << 27
#: 64-bit words of a set's parity sketch.
PARITY = 16
#: Sets above this size, of which parities tell little, also get a sketch of so many counts.
COUNTED_ABOVE, COUNTS = 500, 512
#: Members of a list that one task compares with those of other components.
LIST_BLOCK = 4096
#: No set above this size counts as light, whatever the cost.
MOST_LIGHT = 26


def need(a: int, b: int, percent: int) -> int:
    """Shared elements with which sets of sizes ``a`` and ``b`` have a Jaccard likeness of ``percent`` / 100."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes that can be like a set of size ``n``."""
    return range(-(-n * percent // 100), n * 100 // percent + 1)


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of ``n`` elements lists."""
    return sorted({need(n, m, percent) for m in partners(n, percent)} & set(range(1, n + 1)))


def prefix(n: int, percent: int) -> int:
    """So many of the rarest elements hold one that any partner shares."""
    return n - -(-n * percent // 100) + 1


def light_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size for which listing subsets and scanning lists together cost least.

    ``sizes``: number of sets by size, up to ``MOST_LIGHT``. A listed subset is one entry; a scanned set is its prefix
    entries and, once, the reading of itself and a partner.
    """

    def cost(x: int) -> int:
        total = 0
        for n, count in sizes.items():
            scanned = prefix(n, percent) + 2 * n
            if n <= x:
                total += count * sum(comb(n, c) for c in subset_sizes(n, percent))
                total += count * scanned * (n * 100 // percent > x)
            else:
                total += count * scanned
        return total

    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams; of all its words where they are fewer than ``width``."""
    distinct, index, offsets = words(texts, lower=True)
    hashes = word_hashes(distinct)[index]
    grams = chain([hashes[i : len(hashes) - width + 1 + i] for i in range(width)]) if len(hashes) >= width else hashes[:0]
    bounds = offsets.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield mix(chain([hashes[i : i + 1] for i in range(a, b)]) + np.uint64(b - a))
        else:
            yield grams[:0]


def parity(s: np.ndarray) -> np.ndarray:
    """For each of 64 * ``PARITY`` classes of elements whether the set has an odd number of them.

    Where the sketches of two sets differ, so do the sets: the number of differing bits bounds what they don't share.
    """
    odd = np.bincount(((s >> np.uint64(33)) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def class_counts(s: np.ndarray) -> np.ndarray | None:
    """How many elements of a large set fall into each of ``COUNTS`` classes; None for others.

    The sum of the differences of two sets' counts is no more than what they don't share; a count stops at its type's
    limit, which can only lower that sum.
    """
    if len(s) <= COUNTED_ABOVE:
        return None
    counts = np.bincount(((s >> np.uint64(11)) % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS)
    return np.minimum(counts, np.iinfo(np.int16).max).astype(np.int16)


SKETCH = [f"s{i}" for i in range(PARITY)]


def _sketch(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (doc_id, n, vertex: a hash of the set, parities, counts) and of the frequency sketch (slot, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "vertex", "slot", "count", "counts", *SKETCH]
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text"), width))
                n, vertex = [*map(len, sets)], [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
                counts += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
                rows = len(n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(vertex, dtype=np.uint64).view(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.array([class_counts(s) for s in sets], pa.list_(pa.int16())), *[pa.array(c) for c in np.array([parity(s) for s in sets]).reshape(rows, PARITY).T]], names)
        give_back()
        # a slot that stands out nowhere is a rare one
        slot = np.flatnonzero(counts > 2 * counts.mean() + 2)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(slot), pa.int64()), pa.nulls(len(slot), pa.int64()), pa.nulls(len(slot), pa.int64()), pa.array(slot.astype(np.int32)), pa.array(counts[slot]), pa.nulls(len(slot), pa.list_(pa.int16())), *[pa.nulls(len(slot), pa.int64())] * PARITY], names)

    return docs.mapInArrow(run, "doc_id long, n long, vertex long, slot int, count long, counts array<short>, " + ", ".join(f"{c} long" for c in SKETCH))


def _bits(column: str, rows: DataFrame) -> np.ndarray:
    """A filter of the hashes in ``column``: bit h mod 2^k is set for every hash h; k grows with the rows, up to a bound."""
    size = 1 << min(max(16, (16 * rows.count()).bit_length()), MOST_BITS.bit_length() - 1)
    slot = F.col(column).bitwiseAND(F.lit(size - 1))
    packed = rows.select(slot.alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[packed["w"].to_numpy()] = packed["bits"].to_numpy()
    return bits.view(np.uint64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(64 * len(bits) - 1)
    return ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def _entries(docs: DataFrame, width: int, percent: int, boundary: int, common: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """List entries: key and rank, the entry's place in its list; with ``wanted``, a filter of keys, also the rest.

    pos is the element's place in its set, rare elements first, or the subset's size if the set is light. The head of a
    list, with the lowest rank, has the fewest rarer elements, or is the smallest of light sets.
    """
    from itertools import combinations

    listed = {n: subset_sizes(n, percent) for n in range(1, boundary + 1)}
    scanned = {n: n * 100 // percent > boundary for n in range(1, boundary + 1)}
    names = ["key", "rank"] if wanted is None else ["key", "rank", "light", "vertex", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                rows: list[list[np.ndarray]] = []
                for s in shingle_sets(part.column("text"), width):
                    n = len(s)
                    vertex = xxhash.xxh3_64_intdigest(s.tobytes())
                    if not n or vertex in seen:  # a copy has the same entries
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(vertex)
                    new = []
                    if n <= boundary:
                        for c in listed[n]:
                            of = np.array(list(combinations(range(n), c)))
                            new.append((mix(chain([s[of[:, i]] for i in range(c)]) + np.uint64(c)), True, np.full(len(of), c)))
                    if n > boundary or scanned[n]:
                        p = prefix(n, percent)
                        rare = np.lexsort((s, common[(s >> np.uint64(44)).astype(np.int64)]))[:p]
                        new.append((s[rare], False, np.arange(p)))
                    for key, light, pos in new:
                        if wanted is not None:
                            hit = _passes(wanted, key)
                            key, pos = key[hit], pos[hit]
                        order = np.full(len(key), n) if light else pos
                        rank = (order.astype(np.uint64) << np.uint64(40)) | np.uint64(vertex & ((1 << 40) - 1))
                        rows.append([key, rank, np.full(len(key), light), np.full(len(key), vertex, dtype=np.uint64), np.full(len(key), n, dtype=np.int32), pos.astype(np.int32)][: len(names)])
                if rows:
                    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)
        give_back()

    return docs.mapInArrow(run, "key long, rank long" + ", light boolean, vertex long, n int, pos int" * (wanted is not None))


def _sets_of(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """doc_id, shingles of the documents in ``wanted`` (a column doc_id); a few others may come along."""
    hashed = F.xxhash64("doc_id").alias("hash")
    bits = _bits("hash", wanted.select(hashed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _passes(bits, batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64))
            for part in slices(batch.filter(pa.array(hit))):
                sets = list(shingle_sets(part.column("text"), width))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "shingles"])
        give_back()

    return docs.select("doc_id", "text", hashed).mapInArrow(run, "doc_id long, shingles array<long>")


def _needed(a: str, b: str, percent: int):
    return F.expr(f"({percent}L * ({a} + {b}) + {99 + percent}L) div {100 + percent}L")


def _can_link(a: str, b: str, percent: int):
    """Whether the parities of two sets (columns with these prefixes) leave room for a link."""
    apart = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in SKETCH), F.lit(0))
    return apart <= F.col(f"{a}n") + F.col(f"{b}n") - _needed(f"{a}n", f"{b}n", percent) * 2


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, by Jaccard likeness of distinct word n-grams.

    ``docs`` needs doc_id (integer) and text; other columns are ignored. Words stand between ASCII white space, A-Z are
    lower-cased; a text of fewer than ``width`` words has one n-gram, all of them. Documents link when
    100 * shared >= ``percent`` * united; component_id is the smallest doc_id reachable by links, itself included.
    A null, empty or blank text has an empty set and links with nothing. Rows with a null doc_id come back with a null
    component and link with nothing; rows that share a doc_id count as one document with several texts and come back as
    they are. No rows give no rows.
    """
    source = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    known = source.where("doc_id is not null")
    first = materialise(_sketch(source, width))
    every = first.where("n is not null").select("doc_id", "n", "vertex", *SKETCH)
    sets = every.where("n > 0 and doc_id is not null")
    reps = materialise(sets.groupBy("vertex").agg(F.min("doc_id").alias("doc_id"), F.first("n").cast("int").alias("n"), *[F.first(c).alias(c) for c in SKETCH]))
    sketch = first.where("slot is not null").groupBy("slot").agg(F.sum("count").alias("count")).toArrow()
    common = np.zeros(SLOTS, dtype=np.int64)
    common[sketch["slot"].to_numpy()] = sketch["count"].to_numpy()
    sizes = {r["n"]: r["count"] for r in reps.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    boundary = light_boundary(sizes, percent)

    # first only where each list begins and ends; then the entries of lists with more than one set
    lists = _entries(known, width, percent, boundary, common).groupBy("key").agg(F.min("rank").alias("head_rank"), F.max("rank").alias("last_rank"))
    lists = materialise(lists.where("head_rank < last_rank").select("key", "head_rank"))
    # copies in other tasks made the same entries: one of each is left before lists are looked at
    made = _entries(known, width, percent, boundary, common, _bits("key", lists)).join(lists, "key")
    entries = materialise(made.dropDuplicates(["key", "vertex", "light"]))
    heads = entries.where("rank = head_rank").select("key", F.col("vertex").alias("head"), F.col("n").alias("head_n"), F.col("pos").alias("head_pos"))
    members = materialise(entries.where("rank <> head_rank").drop("rank", "head_rank").join(heads, "key"))

    # light sets with a common subset: the smallest of them needs the fewest shared elements
    light = members.where("light").where(_needed("n", "head_n", percent) <= F.col("pos")).select(F.col("vertex").alias("a"), F.col("head").alias("b"))
    heavy = members.where("not light")
    alike = (F.lit(100) * F.least("n", "head_n") >= F.lit(percent) * F.greatest("n", "head_n")) & (_needed("n", "head_n", percent) <= F.least(F.expr("n - pos"), F.expr("head_n - head_pos")))
    by_head = heavy.where(alike).select(F.col("vertex").alias("a"), F.col("head").alias("b"))

    ids = reps.select("vertex", "doc_id", "n", *SKETCH)

    def side(name: str) -> DataFrame:
        return ids.select(*[F.col(c).alias(f"{name}_{c}") for c in ids.columns])

    def as_ids(pairs: DataFrame) -> DataFrame:
        """Pairs of sets as pairs of documents, without those that the parities rule out."""
        both = pairs.distinct().join(side("x"), F.col("a") == F.col("x_vertex")).join(side("y"), F.col("b") == F.col("y_vertex")).where(_can_link("x_", "y_", percent))
        return materialise(both.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).where("a <> b").distinct())

    counted = first.where("n > 0 and doc_id is not null").select("doc_id", F.col("n").cast("int").alias("n"), "counts")
    differ = F.expr("aggregate(zip_with(x_counts, y_counts, (s, t) -> abs(int(s) - int(t))), 0, (sum, d) -> sum + d)")

    def linked(pairs: DataFrame) -> DataFrame:
        # the sets themselves are only fetched for pairs that the counts leave room to link
        both = pairs.join(counted.toDF("a", "x_n", "x_counts"), "a").join(counted.toDF("b", "y_n", "y_counts"), "b")
        room = differ <= F.col("x_n") + F.col("y_n") - _needed("x_n", "y_n", percent) * 2
        pairs = materialise(both.where(F.coalesce(room, F.lit(True))).select("a", "b").distinct())
        wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        made = _sets_of(known, width, wanted)
        joined = pairs.join(made.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s")), "a").join(made.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t")), "b")
        shared = F.size(F.array_intersect("s", "t"))
        return joined.where(shared * (100 + percent) >= (F.size("s") + F.size("t")) * percent).select("a", "b")

    links = materialise(as_ids(light).unionByName(linked(as_ids(by_head))).distinct())
    if heavy.isEmpty():
        found = connected_components(links)
    else:
        parts = materialise(connected_components(links))
        # what the heads left apart: members of one list in different components
        at = ids.select("vertex", "doc_id").join(parts.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("vertex", F.coalesce("component", "doc_id").alias("component"))
        listed = heavy.select("key", "vertex", "n", "pos").unionByName(heavy.select("key", F.col("head").alias("vertex"), F.col("head_n").alias("n"), F.col("head_pos").alias("pos")).distinct())
        # the smaller of a pair has the element early: without such a member a list has nothing to compare
        early = listed.withColumn("early", _needed("n", "n", percent) <= F.expr("n - pos"))
        useful = early.groupBy("key").agg(F.max("early").alias("some")).where("some").select("key")
        placed = early.join(useful, "key", "left_semi").drop("early").join(at, "vertex")
        kinds = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
        apart = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.max_by("component", F.struct("n", "component")).alias("most")).where("kinds > 1")
        open_lists = placed.join(apart.drop("kinds"), "key").withColumn("blocks", F.ceil(F.col("total") / LIST_BLOCK).cast("int"))
        open_lists = materialise(open_lists.join(ids.select("vertex", *SKETCH), "vertex"))  # only now, for sketches are wide
        # members of a list's largest component need no look at one another: the others are compared with all, block by block
        p = open_lists.where("component <> most").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("p")
        q = open_lists.withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")).alias("q")
        once = (F.col("p.component") < F.col("q.component")) | ((F.col("p.component") > F.col("q.component")) & (F.col("q.component") == F.col("q.most")))
        fit = (F.lit(100) * F.least("p.n", "q.n") >= F.lit(percent) * F.greatest("p.n", "q.n")) & (_needed("p.n", "q.n", percent) <= F.least(F.expr("p.n - p.pos"), F.expr("q.n - q.pos")))
        rest = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.block") == F.col("q.block")) & once & fit & _can_link("p.", "q.", percent)).select(F.col("p.vertex").alias("a"), F.col("q.vertex").alias("b"))
        tried = heavy.where(alike).select(F.col("vertex").alias("a"), F.col("head").alias("b"))
        tried = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        more = linked(as_ids(rest.distinct().join(tried, ["a", "b"], "left_anti")))
        found = connected_components(links.unionByName(more))
    classes = reps.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("vertex", F.coalesce("component", "doc_id").alias("class"))
    out = every.join(classes, "vertex", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("class")), F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows that link with nothing stay.

    Of rows that share a doc_id all stay or go together; rows with a null doc_id stay.
    """
    gone = ngram_join(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
