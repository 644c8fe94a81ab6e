"""Encodings of files of each kind, lines in each encoding, and formats by name."""

import pytest

from quaywork.sources import delimited, encoding, formats

KINDS = {
    "plain.txt": (b"a;b\n1;\xc3\xa9\n", "utf-8", False, None),
    "no-end.txt": ("ä" * 5000).encode(), 
    "mark.txt": (b"\xef\xbb\xbfa;b\n1;2\n", "utf-8", True, None),
    "mark-no-end.txt": (b"\xef\xbb\xbfa;b\n1;2", "utf-8", True, None),
    "mark-only.txt": (b"\xef\xbb\xbf\n", "utf-8", True, None),
    "le.txt": ("﻿a;é\r\n1;語\n").encode("utf-16le"), 
    "be.txt": ("﻿a;é\n").encode("utf-16be"),
    "le32.txt": ("﻿a;b\n").encode("utf-32le"),
    "be32.txt": ("﻿a;b\n").encode("utf-32be"),
    "nul.txt": (b"a;b\n1;\x00\n", None, False, "binary"),
    "controls.txt": (b"a;b\x01\x02\x03\n" * 40, None, False, "binary"),
    "some-controls.txt": (b"\x01\x02\x7f a;b\n" + b"text;more\n" * 400, "utf-8", False, None),
    "western.txt": (b"a;caf\xe9 \x80\n1;\x93x\x94\n", "windows-1252", False, None),
    "undefined.txt": (b"a;caf\xe9 \x81\n", None, False, "undefined-bytes"),
    "overlong.txt": (b"a;\xc0\xaf\n", "windows-1252", False, None),
}
KINDS |= {"no-end.txt": (KINDS["no-end.txt"], "utf-8", False, None), "le.txt": (KINDS["le.txt"], "utf-16le", True, None), "be.txt": (KINDS["be.txt"], "utf-16be", True, None)}
KINDS |= {n: (KINDS[n], None, True, "utf-32") for n in ("le32.txt", "be32.txt")}


@pytest.mark.parametrize("size", ["128m", "64b"])
def test_files_of_each_kind(spark, tmp_path, size):
    for name, (raw, *_) in KINDS.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "empty.txt").write_bytes(b"")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {r.file.rpartition("/")[2]: (r.encoding, r.bom, r.refusal) for r in encoding.detect_encodings(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert got == {name: tuple(rest) for name, (_, *rest) in KINDS.items()}


def test_records_in_each_encoding(spark, tmp_path):
    text = 'a;"é\n€";ž\r\n1;"x"";y";\r\n'
    want = [(1, ["a", "é\n€", "ž"]), (3, ["1", 'x";y', ""])]
    for name, codec, mark in (("utf-8", "utf-8", "﻿"), ("utf-16le", "utf-16le", "﻿"), ("utf-16be", "utf-16be", "﻿"), ("windows-1252", "cp1252", "")):
        path = tmp_path / f"{name}.txt"
        path.write_bytes((mark + text).encode(codec))
        assert sorted((r.line, r.cells) for r in delimited.read_records(spark, str(path), ";", encoding=name).collect()) == want, name
        if name != "windows-1252":
            assert sorted((r.line, r.cells) for r in delimited.read_records(spark, str(path), ";", encoding=None).collect()) == want, name


@pytest.mark.parametrize(("name", "why"), [("nul.txt", "NUL bytes"), ("western.txt", "needs confirmation"), ("undefined.txt", "undefined in every"), ("le32.txt", "UTF-32")])
def test_a_refused_file_says_why(spark, tmp_path, name, why):
    (tmp_path / name).write_bytes(KINDS[name][0])
    with pytest.raises(ValueError, match=f"{name}: .*{why}"):
        delimited.read_records(spark, str(tmp_path / name), ";", encoding=None)


def test_wrong_bytes_are_an_error(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"a;\xe9\n")
    with pytest.raises(Exception, match="UTF8|UTF-8|malformed"):
        delimited.read_records(spark, str(tmp_path / "t.txt"), ";").collect()
    (tmp_path / "u.txt").write_bytes(b"a;\x81\n")
    with pytest.raises(Exception, match="doesn't define"):
        delimited.read_records(spark, str(tmp_path / "u.txt"), ";", encoding="windows-1252").collect()


def test_formats_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, 5"" y"\n')
    (tmp_path / "t.tsv").write_text('a\tb\n1\t5" y\n')
    known = formats.standard_formats()
    assert known.for_file("/x/T.CSV") == ["strict-csv", "comma-text", "semicolon-text"]
    assert sorted(r.cells for r in known.read(spark, "strict-csv", str(tmp_path / "t.csv")).collect()) == [["1", 'x, 5" y'], ["a", "b"]]
    assert sorted(r.cells for r in known.read(spark, "tab-text", str(tmp_path / "t.tsv")).collect()) == [["1", '5" y'], ["a", "b"]]
    with pytest.raises(ValueError, match="out of place on line 2"):
        known.read(spark, "strict-csv", str(tmp_path / "t.tsv"), delimiter="\t")
    again = formats.Format("tab-text", "1.0.0", "text", delimited.read_records)
    with pytest.raises(formats.FormatError, match='"tab-text" is already registered'):
        known.register(again)
    with pytest.raises(formats.FormatError, match="name must match.*version must look.*family.*ending"):
        known.register(formats.Format("Tab", "1", " ", delimited.read_records, ("tsv",)))
    gone = known.register(formats.Format("sheet", "1.0.0", "spreadsheet", delimited.read_records, (".xlsx",), refusal="Export the sheet as CSV."))
    assert "sheet" in known.names() and "sheet" not in known.supported()
    with pytest.raises(formats.FormatError, match="Export the sheet"):
        known.read(spark, "sheet", "x.xlsx")
    gone()
    assert "sheet" not in known.names()
    known.disable("bar-text")
    for name, said in (("bar-text", "not enabled"), ("none", "no format named")):
        with pytest.raises(formats.FormatError, match=said):
            known.read(spark, name, str(tmp_path))
    with pytest.raises(formats.FormatError, match="no option quote"):
        known.read(spark, "tab-text", str(tmp_path / "t.tsv"), quote="'")
