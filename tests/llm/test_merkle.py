"""Merkle manifests against a plain tree, with nulls, repeated rows, lone groups, many levels and hot groups."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quaywork.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text=...):
    doc_id, own, lang, source, n = row
    return h("".join(map(field, (doc_id, source, lang, n, own if text is ... else text))))


def tree(nodes, fanout):
    """The top and, for each node, the (left, right) siblings on its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for leaf, i in enumerate(at):
            run, place = runs[i // fanout], i % fanout
            paths[leaf].append(("".join(run[:place]), "".join(run[place + 1 :])))
        nodes, at = [h("".join(run)) for run in runs], [i // fanout for i in at]
    return nodes[0], paths


def plain(rows, fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in names}
    trees = {s: tree([leaf_of(r) for r in members[s]], fanout) for s in names}
    root, upper = tree([trees[s][0] for s in names], fanout) if names else (None, [])
    out = []
    for s, high in zip(names, upper, strict=True):
        for r, path in zip(members[s], trees[s][1], strict=True):
            path = path + high
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = leaf_of(r, r[1].replace("\n", "") if hit and r[1] is not None else r[1])
            for left, right in path:
                at = h(left + at + right)
            out.append((r[0], leaf_of(r), trees[s][0], root, h("".join(a + b for a, b in path)), at, at == root))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def sample(n, seed, sources):
    rnd = random.Random(seed)
    texts = [None, "", "a\nb", "\n", "é ü\n\n", "plain", "x" * 300_000, "w\n" * 100_000]
    rows = [(i, rnd.choice(texts), rnd.choice([None, "", "en"]), rnd.choice(sources), rnd.choice([None, 0, 7])) for i in range(n)]
    return rows + rows[:5] + [(None, "null id\n", "en", sources[0], 1), (None, None, None, None, None)]


@pytest.mark.parametrize("fanout", [2, 3, 7])
def test_every_row_equals_a_plain_tree(spark, fanout):
    rows = sample(150, fanout, ["a", "a", "a", "a", None, "", "B", "é", "one"]) + [(999, "lone\n", "en", "lone", 4)]
    assert got(merkle.tampered_proofs(spark.createDataFrame(rows, SCHEMA).repartition(5), fanout)) == plain(rows, fanout)


def test_a_hot_group_and_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)  # so that groups span ranges
    rows = [(i, f"t{i}\n", "en", "hot" if i % 3 == 0 else f"s{i:04}", i) for i in range(700)]
    assert got(merkle.tampered_proofs(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a\n", "en", "s", 2)], [(1, "a", "en", "s", 2), (2, "b\n", "en", "t", 2)], [(5, "same", None, None, None)] * 4])
def test_small_tables(spark, rows):
    assert got(merkle.tampered_proofs(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_clashing_columns_and_row_order_change_nothing(spark):
    rows = sample(60, 9, ["a", "b"])
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = docs.withColumns({c: F.lit("x") for c in ("tree", "ordinal", "n", "child", "digest", "leaf", "proof", "root", "height", "_at", "_part", "key", "children", "place")})
    assert got(merkle.tampered_proofs(odd.orderBy(F.desc("doc_id")))) == plain(rows)


def test_verify_names_changed_and_added_rows(spark):
    rows = [(i, f"text {i}", "en", "abc"[i % 3], 6) for i in range(40)]
    proofs = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    changed = [r if r[0] not in (4, 17) else (r[0], r[1] + "!", *r[2:]) for r in rows if r[0] != 9] + [(77, "new", "en", "a", 3)]
    assert sorted(r.doc_id for r in merkle.verify(spark.createDataFrame(changed, SCHEMA), proofs).collect()) == [4, 17, 77]


def test_a_field_is_never_another_ones_text(spark):
    rows = [(1, "a", "b", "c", None), (1, "", "b", "c", None), (1, None, "b", "c", None), (1, "-", "b", "c", None), (1, "1:a", "b", "c", None)]
    leaves = [r.leaf for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(set(leaves)) == len(rows)
