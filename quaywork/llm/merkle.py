"""Merkle manifests of a table: a digest of each row, one subroot a group, one root, and a proof for each row.

Levels are DataFrames. Rows get their place in their group from row numbers of a range-partitioned sort and per-partition
totals; a node's place divided by the fanout is its parent's, whose digest is that of its children in order. A level has a
fanout-th of the rows of the one below and is written before the next is made. Proofs go down the same levels: a run of
children joins its parent's proof by the parent's place, and each child appends its siblings. So every join is by keys that
are unique on both sides, and no task gathers a group, however large: neither the rows of one source nor all sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise, pick

#: Rows of a sorted range, about.
RANGE_ROWS = 250_000
#: monotonically_increasing_id has the partition above so many bits, the row in it below.
ROW_BITS = 33
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a node's run holds to the left and right of it, as text, for each level up to the root.
PROOF = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as bytes that no other value has: ``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of a row's values."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda at, run: F.sha2(F.concat(run["left"], at, run["right"]), 256))


def siblings(proof: Column) -> Column:
    """A proof's digests, level by level and left to right, as one text."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), "")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``ordinal`` (from 0 in each group, by ``order``) and ``n`` (rows of the group).

    ``rows`` should read from a written table. Rows are sorted in ranges of (group, order); what stands before a group's
    part in a range comes from one row for each group and range. Rows equal in group and order are interchangeable.
    """
    ranges = max(16, rows.count() // RANGE_ROWS)
    sort = [group, *order]
    dealt = materialise(rows.repartitionByRange(ranges, *sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()))
    at = {"_part": F.shiftright("_at", ROW_BITS), "_row": F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)}
    dealt = dealt.withColumns(at)
    parts = dealt.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    placed = dealt.join(parts, [group, "_part"])
    return placed.withColumn("ordinal", F.col("_row") + F.col("_shift")).drop("_at", "_part", "_row", "_shift")


def _forest(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of runs from nodes (tree, ordinal, n, child), child a struct that begins with digest; and the trees' tops.

    A run is (tree, ordinal, n, children, digest): the children in order and their parent's digest and place, n the number of
    nodes of its tree on the children's level. tops: tree, height, digest.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    tops = [nodes.where("n = 1").select("tree", F.lit(0).alias("height"), "child.digest")]
    while most > 1:
        of_parent = nodes.where("n > 1").groupBy("tree", F.expr(f"ordinal div {fanout}").alias("ordinal"))
        runs = of_parent.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("ordinal", "child"))).alias("placed"))
        runs = runs.select("tree", "ordinal", "n", F.col("placed.child").alias("children"))
        levels.append(materialise(runs.withColumn("digest", F.sha2(F.array_join("children.digest", ""), 256))))
        tops.append(levels[-1].where(F.col("n") <= fanout).select("tree", F.lit(len(levels)).alias("height"), "digest"))
        nodes = levels[-1].select("tree", "ordinal", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.struct("digest").alias("child"))
        most = -(-most // fanout)
    return levels, reduce(DataFrame.unionByName, tops)


def _proven(levels: list[DataFrame], lone: DataFrame, tops: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """child, proof and ``carried`` of every leaf; lone: tree, child of trees of one leaf; tops: tree, height, proof, ``carried``."""
    found = lone.join(tops.where("height = 0").drop("height"), "tree").select("child", "proof", *carried)
    above = None
    for height in range(len(levels), 0, -1):
        begun = tops.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("ordinal"), "proof", *carried)
        above = begun if above is None else above.unionByName(begun)
        spread = levels[height - 1].select("tree", "ordinal", "children").join(above, ["tree", "ordinal"]).select("*", F.posexplode("children").alias("place", "child"))
        beside = lambda part: F.expr(f"array_join(transform({part}, c -> c.digest), '')")
        run = F.struct(beside("slice(children, 1, place)").alias("left"), beside("slice(children, place + 2, size(children))").alias("right"))
        above = spread.select("tree", F.expr(f"ordinal * {fanout} + place").alias("ordinal"), "child", F.concat(F.array(run), "proof").alias("proof"), *carried)
        if height > 1:
            above = above.drop("child")
    return found if above is None else found.unionByName(above.select("child", "proof", *carried))


def manifest(docs: DataFrame, fanout: int = 3, columns: tuple[str, ...] = COLUMNS, group: str = "source", tampered: Column | None = None) -> DataFrame:
    """The first of ``columns`` (the key), leaf, subroot, root and proof of every row; and tampered_leaf if ``tampered`` is given.

    A leaf is the digest of a row's ``columns``. Leaves of a group stand in order of the key (null first; rows equal in it by
    leaf, and those equal in that are interchangeable); every ``fanout`` consecutive nodes become their digest, a last run of
    fewer, even of one, too, until one node remains: the subroot. Subroots in order of their group (null first, then by
    UTF-8 bytes) become the root likewise. A group of one row has its leaf as subroot, a table of one group its subroot as
    root. proof holds the left and right siblings of each level up to the root; both are empty where a run is of one.
    ``tampered`` is a text that takes the place of the column text in tampered_leaf. A null value is a value of its own, not
    the empty text; repeated rows are leaves of their own; further columns are ignored; no rows give no rows.
    """
    key = columns[0]
    rows = pick(docs, *dict.fromkeys([*columns, group]))
    other = row_digest(*[tampered if c == "text" else F.col(f"`{c}`") for c in columns]) if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = materialise(rows.select(tree.alias("tree"), F.col(f"`{key}`").alias("key"), row_digest(*[F.col(f"`{c}`") for c in columns]).alias("digest"), other.alias("tampered_leaf")))
    nodes = materialise(numbered(leaves, "tree", ["key", "digest"]).select("tree", "ordinal", "n", F.struct("digest", "key", "tampered_leaf").alias("child")))
    levels, tops = _forest(nodes, fanout)
    subroots = materialise(tops.select(F.lit("").alias("tree"), F.struct("digest", F.col("tree").alias("of"), "height").alias("child")).withColumn("name", F.col("child.of")))
    placed = materialise(numbered(subroots, "tree", ["name"]).select("tree", "ordinal", "n", "child"))
    upper, root = _forest(placed, fanout)
    root = root.select("tree", "height", F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    proven = _proven(upper, placed.where("n = 1").select("tree", "child"), root, ["root"], fanout)
    proven = materialise(proven.select(F.col("child.of").alias("tree"), "child.height", F.col("child.digest").alias("subroot"), "root", "proof"))
    found = _proven(levels, nodes.where("n = 1").select("tree", "child"), proven, ["subroot", "root"], fanout)
    out = found.select(F.col("child.key").alias(key), F.col("child.digest").alias("leaf"), "subroot", "root", "proof", F.col("child.tampered_leaf").alias("tampered_leaf"))
    return out if tampered is not None else out.drop("tampered_leaf")


def verify(docs: DataFrame, proofs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The rows of ``docs`` (key, leaf) that the manifest ``proofs`` doesn't hold: changed or added since it was made.

    ``proofs``: leaf, proof and root as ``manifest`` gives them. A row is held if its digest is a leaf whose proof leads to
    the root. Repeated rows are judged alike; a key that is null counts as any other.
    """
    key = columns[0]
    leaves = pick(docs, *columns).select(F.col(f"`{key}`").alias(key), row_digest(*[F.col(f"`{c}`") for c in columns]).alias("leaf"))
    held = proofs.where(folded(F.col("leaf"), F.col("proof")) == F.col("root")).select("leaf").distinct()
    return leaves.join(held, "leaf", "left_anti").select(key, "leaf")


def tampered_proofs(docs: DataFrame, fanout: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents, some tampered with.

    Where the unsigned CRC-32 of the decimal doc_id is even, the text loses its line feeds (a null text stays null; a row
    without doc_id isn't touched); folded_root is what the row as it then is leads to with the siblings of the manifest.
    """
    hit = F.crc32(F.col("`doc_id`").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace(F.col("`text`"), F.lit("\n"), F.lit(""))).otherwise(F.col("`text`"))
    found = manifest(docs, fanout, tampered=text)
    folds = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded(F.col("tampered_leaf"), F.col("proof")).alias("folded_root"))
    return folds.withColumn("verified", F.col("folded_root") == F.col("root"))
