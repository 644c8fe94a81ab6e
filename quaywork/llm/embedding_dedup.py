"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside cells, one kept of each group.

Equal vectors are first counted as one. Cells come from Lloyd rounds over all vectors, each round a sum by cell. Every
vector is put in its nearest few cells, so that two that are alike share one though a border runs between them. Where
that many cells don't go into every task, the cells of all vectors are split into cells of their own, each by a k-means of
a sample of its vectors. A cell is cut into blocks of bounded size and every two blocks are multiplied in a task of their
own, which counts each pair in the lowest cell that the two share and passes on no pairs, only each vector's number of
links and a spanning forest. So a cell that a third of all vectors fall into means more tasks, not a larger one, and no
group makes more rows than it has vectors in each of them.

Style: numpy products inside grouped Arrow tasks; sums, dealing and components are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise
from .components import connected_components

#: Vectors for each cell, the most cells of a level (their centres go to tasks), cells that a vector is put in, Lloyd
#: rounds, and vectors of a block.
CELL, MOST_CELLS, PROBES, ROUNDS, BLOCK = 1024, 4096, 6, 3, 2048
#: With two levels: cells that a vector is put in on each, and vectors of the sample for each cell of the second.
LEVEL_PROBES, SAMPLE = 3, 16
#: Products of a matrix that are made at once.
PRODUCTS = 1 << 20


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _nearest(unit: np.ndarray, centres: np.ndarray, near: int) -> np.ndarray:
    """The ``near`` centres nearest to each vector, in order of their numbers."""
    step = max(1, PRODUCTS // len(centres))
    parts = [np.argpartition(-(unit[i : i + step] @ centres.T), near - 1, axis=1)[:, :near] for i in range(0, len(unit), step)]
    return np.sort(np.concatenate(parts), axis=1) if parts else np.zeros((0, near), dtype=np.int64)


def _sums(unit: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells with vectors and the sums of their vectors."""
    cell = _nearest(unit, centres, 1)[:, 0]
    order = np.argsort(cell, kind="stable")
    seen, first = np.unique(cell[order], return_index=True)
    return seen, np.add.reduceat(unit[order], first, axis=0) if len(seen) else np.zeros((0, centres.shape[1]))


def _moved(centres: np.ndarray, seen: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centres at the directions of the sums; those without vectors stay."""
    length = np.linalg.norm(sums, axis=1)
    out = centres.copy()
    out[seen[length > 0]] = sums[length > 0] / length[length > 0, None]
    return out


def _centres(vectors: DataFrame, width: int, cells: int) -> np.ndarray:
    """Unit centres of spherical k-means; it starts from the vectors with the lowest hashes of their id."""
    start = vectors.orderBy(F.xxhash64("rep"), "rep").limit(cells).select("vector").toArrow().column("vector").combine_chunks()
    centres = _matrix(start, width)
    for _ in range(ROUNDS if cells > 1 else 0):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros_like(now), np.zeros(len(now), dtype=bool)
            for batch in batches:
                seen, own = _sums(_matrix(batch.column("vector"), width), now)
                total[seen] += own
                some[seen] = True
            seen = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(list(total[seen]), pa.list_(pa.float64()))], ["cell", "total"])

        parts = vectors.select("vector").mapInArrow(sums, "cell int, total array<double>")
        rows = parts.select("cell", F.posexplode("total").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x")).toArrow()
        sums_of = np.zeros_like(now)
        sums_of[rows["cell"].to_numpy(), rows["at"].to_numpy()] = rows["x"].to_numpy()
        centres = _moved(now, np.arange(len(now)), sums_of)
    return centres


def _second_level(placed: DataFrame, width: int) -> DataFrame:
    """rep, cells (longs): ``placed`` (rep, vector, cells) in the cells into which its cells are split.

    The centres of a cell's parts come from about ``SAMPLE`` vectors for each, chosen by a hash of rep.
    """
    rows = placed.select("rep", "vector", F.explode("cells").alias("cell"))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("size"))  # at most MOST_CELLS rows
    sizes = sizes.withColumn("parts", F.least(F.ceil(F.col("size") / CELL), F.lit(MOST_CELLS)).cast("int")).withColumn("blocks", F.ceil(F.col("size") / (4 * BLOCK)).cast("int"))
    sizes = F.broadcast(materialise(sizes))
    place = F.pmod(F.xxhash64("rep", F.lit("part")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(sizes, "cell").where(place * F.col("size") < F.col("parts") * SAMPLE)

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy())
        table = table.take(pa.array(order)).combine_chunks()
        unit = _matrix(table.column("vector").combine_chunks(), width)
        parts = min(table.column("parts")[0].as_py(), len(unit))
        centres = unit[np.random.default_rng(17).permutation(len(unit))[:parts]]
        for _ in range(ROUNDS):
            centres = _moved(centres, *_sums(unit, centres))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "blocks": table.column("blocks")[:1], "centres": pa.array([centres.ravel()], pa.list_(pa.float64()))})

    learned = sample.select("cell", "blocks", "parts", "rep", "vector").groupBy("cell").applyInArrow(learn, "cell int, blocks int, centres array<double>")
    learned = materialise(learned).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "centres")
    dealt = rows.join(sizes.select("cell", "blocks"), "cell").select("cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "vector")

    def assign(key: tuple, table: pa.Table, centres: pa.Table) -> pa.Table:
        # a cell of which no vector fell into the sample stays whole
        of = centres.column("centres").combine_chunks().flatten().to_numpy().reshape(-1, width) if centres.num_rows else np.zeros((1, width))
        near = min(LEVEL_PROBES, len(of))
        best = _nearest(_matrix(table.combine_chunks().column("vector").combine_chunks(), width), of, near)
        return pa.table({"rep": table.column("rep"), "cells": pa.array(list((np.int64(key[0].as_py()) << 32) + best), pa.list_(pa.int64()))})

    parts = dealt.groupBy("cell", "block").cogroup(learned.groupBy("cell", "block")).applyInArrow(assign, "rep long, cells array<long>")
    return parts.groupBy("rep").agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))  # a few for each rep


def local_links(a: np.ndarray, b: np.ndarray | None, least: float) -> np.ndarray:
    """Whether rows of ``a`` and of ``b`` (of ``a`` itself, without the diagonal, if None) have that cosine."""
    hit = a @ (a if b is None else b).T >= least
    if b is None:
        np.fill_diagonal(hit, False)
    return hit


def smallest_reached(hit: np.ndarray) -> np.ndarray:
    """For a symmetric link matrix the smallest index that each row reaches, itself included."""
    label = np.arange(len(hit))
    while True:
        near = np.where(hit, label[None, :], len(hit)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(embeddings: DataFrame, least: float = 0.95, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id, embedding).

    Vectors link at a cosine of ``least`` or more, in double precision. n_links counts the other rows that a row links
    with, copies among them; component_id is the smallest vec_id reachable by links, itself included; kept: they are the
    same. Vectors that are null, empty, zero or have null or non-finite parts link with nothing, nor do rows with a null
    vec_id (component_id null, kept false); shorter vectors count as filled up with zeros. Rows that share a vec_id are
    rows of one document and come back as they are. No rows give no rows; other columns are ignored. All links found
    hold; one between vectors that share none of their ``probes`` nearest cells is missed (see the README for recall).
    Up to CELL * MOST_CELLS * MOST_CELLS vectors (17 billion) cells have a bounded size on the whole; above, they grow.
    """
    parts = F.transform(F.col("`embedding`"), lambda x: x.cast("double"))
    rows = embeddings.select(F.col("`vec_id`").cast("long").alias("vec_id"), parts.alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    keyed = rows.select("vec_id", F.when(sound, F.xxhash64("vector")).alias("k1"), F.when(sound, F.xxhash64(F.lit("second"), "vector")).alias("k2"), F.when(sound, F.col("vector")).alias("vector"))
    vectors = materialise(keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not size["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width, wanted = size["width"], -(-size["n"] // CELL)
    cells = min(MOST_CELLS, wanted)
    centres = _centres(vectors, width, cells)
    near = min(probes if wanted <= MOST_CELLS else LEVEL_PROBES, cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = _nearest(_matrix(batch.column("vector"), width), centres, near)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rep", "copies", "vector")], pa.array(list(best), pa.list_(pa.int64()))], ["rep", "copies", "vector", "cells"])

    placed = materialise(vectors.select("rep", "copies", "vector").mapInArrow(assign, "rep long, copies long, vector array<double>, cells array<long>"))
    if wanted > MOST_CELLS:
        placed = materialise(placed.drop("cells").join(_second_level(placed, width), "rep"))
    exploded = placed.select("rep", "copies", "vector", "cells", F.explode("cells").alias("cell"))
    sizes = exploded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = exploded.join(F.broadcast(sizes) if wanted <= MOST_CELLS else sizes, "cell")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "copies", "vector", "cells")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        cell, low, high = (k.as_py() for k in key)
        table = table.combine_chunks()
        order = np.argsort(table.column("rep").to_numpy())
        table = table.take(pa.array(order))
        rep, copies, own = (table.column(c).to_numpy() for c in ("rep", "copies", "own"))
        unit = _matrix(table.column("vector").combine_chunks(), width)
        lists = table.column("cells").combine_chunks()
        of, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(rep)), np.diff(lists.offsets.to_numpy()))
        kinds, at = np.unique(np.minimum(of, cell), return_inverse=True)
        flags = np.zeros((len(rep), len(kinds)), dtype=np.float32)
        flags[row, at] = 1
        flags = flags[:, kinds < cell]
        hit = local_links(unit, None, least)
        if low != high:  # pairs inside a block are another task's
            hit &= own[:, None] != own[None, :]
        first = hit & (flags @ flags.T == 0)
        links = first @ copies
        root = rep[smallest_reached(hit)]
        some = hit.any(axis=1)
        return pa.table({"rep": pa.array(rep[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(root[some])})

    found = materialise(dealt.groupBy("cell", "low", "high").applyInArrow(compare, "rep long, links long, root long"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    groups = vectors.select("k1", "k2", "rep", "copies").join(linked, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    groups = groups.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "k1", "k2").join(groups, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
