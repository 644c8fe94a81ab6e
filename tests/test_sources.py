"""Strict CSV files, the versioned store and JSON lines."""

import csv
import io
import random

import pytest

from quaywork.sources import delimited
from quaywork.sources.store import StaleUndo, VersionedStore, json_lines


def test_strict_csv_equals_python_s_reader(spark, tmp_path):
    rnd = random.Random(1)
    rows = [["id", "text", "n"]] + [[str(i), "".join(rnd.choice('ab ,"\n') for _ in range(rnd.randrange(12))), ""] for i in range(400)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    text = out.getvalue()
    (tmp_path / "t.csv").write_bytes(("﻿" + text + "\n,,\n").replace("\n", "\r\n", 1).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "700b"):  # one block, and many that cut records
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = delimited.read_strict_csv(spark, str(tmp_path / "t.csv")).orderBy("line").collect()
            assert [r.cells for r in got] == rows
            starts, at = [], 1
            for r in rows:
                starts.append(at)
                at += 1 + sum(c.count("\n") for c in r)
            assert [r.line for r in got] == starts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("text", "line"), [('a,b\n5" pipe,c\n"x,y\n', 2), ('a,b\n"ab"c,d\n', 2), ('a,b\n1,2\n"open,3\nmore\n', 3)])
def test_quotes_out_of_place_are_refused(spark, tmp_path, text, line):
    (tmp_path / "t.csv").write_text(text)
    with pytest.raises(ValueError, match=f"line {line}$"):
        delimited.read_strict_csv(spark, str(tmp_path / "t.csv"))


def plain_records(text, delimiter):
    """(line, cells) of each record by reading one character after the other; None if the last quote stays open."""
    rows, cells, cell, state, line, first = [], [], "", "start", 1, 1
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for c in text + ("" if text.endswith("\n") else "\n"):
        if state == "quoted" and c != '"' or state == "closing" and c == '"':
            cell, state = cell + c, "quoted"
        elif state == "quoted":
            state = "closing"
        elif c == '"' and state == "start":
            state = "quoted"
        elif c in (delimiter, "\n"):
            cells, cell, state = [*cells, cell], "", "start"
            if c == "\n":
                rows.append((first, cells))
                cells, first = [], line + 1
        else:
            cell, state = cell + c, "bare"
        line += c == "\n"
    return None if state == "quoted" else [r for r in rows if any(x.strip() for x in r[1])]


def blocks_of(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize(("delimiter", "seed"), [(",", 1), (";", 2), ("\t", 3), ("|", 4)])
def test_lenient_records_equal_a_plain_parser_at_every_block_size(spark, tmp_path, delimiter, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(f'aé "{delimiter}"{delimiter}\n') for _ in range(rnd.choice([0, 1, 5, 40, 90]))) for _ in range(14)]
    texts = [t + '"' if plain_records(t, delimiter) is None else t for t in texts]
    texts = [t for t in texts if plain_records(t, delimiter) is not None] + [f'a{delimiter}5" pipe{delimiter}"x"y"z{delimiter}"""{delimiter}\r\n\r\n"{delimiter}\rend']
    for i, t in enumerate(texts):
        (tmp_path / f"{i:02}.txt").write_bytes(("﻿" if i % 3 == 0 else "").encode() + t.encode())
    want = [(f"{i:02}", *r) for i, t in enumerate(texts) for r in plain_records(t, delimiter)]
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (usual, "23b", "7b", "3b"):
            blocks_of(spark, size)
            got = delimited.read_records(spark, str(tmp_path), delimiter).collect()
            assert sorted((r.file[-6:-4], r.line, r.cells) for r in got) == want, size
    finally:
        blocks_of(spark, usual)


def test_a_file_cut_anywhere(spark, tmp_path):
    text = 'a;"b""\n;"c\r\n"\n\n";"x;5"\n"";"\n"\n'
    (tmp_path / "t.txt").write_bytes(text.encode())
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in range(1, len(text) + 1):
            blocks_of(spark, f"{size}b")
            assert sorted((r.line, r.cells) for r in delimited.read_records(spark, str(tmp_path / "t.txt"), ";").collect()) == plain_records(text, ";"), size
    finally:
        blocks_of(spark, usual)


def test_records_over_many_blocks_and_a_join_of_their_starts(spark, tmp_path, monkeypatch):
    body = "\n".join(f'{i};"{"x" * (i % 40)}' + '\n'.join(["", 'more ""text""; '] * (i % 7)) + '"' for i in range(300)) + '\n"' + "long; \n" * 400 + '";end\n'
    (tmp_path / "t.txt").write_text(body)
    want = plain_records(body, ";")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (delimited.MOST_BROADCAST, 3):
            monkeypatch.setattr(delimited, "MOST_BROADCAST", most)
            blocks_of(spark, "500b")
            assert sorted((r.line, r.cells) for r in delimited.read_records(spark, str(tmp_path / "t.txt"), ";").collect()) == want
    finally:
        blocks_of(spark, usual)


@pytest.mark.parametrize("size", ["128m", "3b"])
def test_a_quote_that_is_never_closed_is_refused(spark, tmp_path, size):
    (tmp_path / "a.txt").write_text('a;b\n1;2"\n')
    (tmp_path / "b.txt").write_text('a;b\n1;"2\n3;4""\n\n')
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        blocks_of(spark, size)
        with pytest.raises(ValueError, match=r"b\.txt: a quote is never closed on line 2$"):
            delimited.read_records(spark, str(tmp_path), ";")
        assert sorted(r.cells for r in delimited.read_records(spark, str(tmp_path / "a.txt"), ";").collect()) == [["1", '2"'], ["a", "b"]]
    finally:
        blocks_of(spark, usual)
    with pytest.raises(ValueError, match="not a delimiter"):
        delimited.read_records(spark, str(tmp_path), '"')


def test_states_are_maps_one_after_the_other():
    rnd = random.Random(5)
    for n in (0, 1, 2, 50):
        opens, stays = (delimited.np.array([rnd.random() < 0.5 for _ in range(n)], dtype=bool) for _ in range(2))
        for first in (False, True):
            want = [first]
            for o, s in zip(opens, stays):
                want.append(bool(s if want[-1] else o))
            assert delimited.states(opens, stays, first).tolist() == want


def test_store_replaces_and_undoes_once(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    rows = lambda *n: spark.createDataFrame([(x,) for x in n], "n int")
    held = lambda t: sorted(r.n for r in store.read(t).collect())
    assert store.version() == 0 and store.read("inventory") is None
    assert store.replace(inventory=rows(1), shipments=rows(2)) == 1
    with pytest.raises(StaleUndo):
        store.undo(1)
    assert store.replace(inventory=rows(3, 4)) == 2
    assert (held("inventory"), held("shipments")) == ([3, 4], [2])
    with pytest.raises(StaleUndo):
        store.undo(1)
    assert store.undo(2) == 3 and (held("inventory"), held("shipments")) == ([1], [2])
    with pytest.raises(StaleUndo):
        store.undo(3)
    with pytest.raises(ValueError, match="inventory, shipments"):
        store.replace(other=rows(1))


def test_json_lines(spark):
    got = json_lines(spark.createDataFrame([(1, None, 'a"b')], "n int, x string, t string")).collect()
    assert got[0].value == '{"n":1,"x":null,"t":"a\\"b"}'
