"""Nested records, structural rows, column maps, cooked cells, and an import as one act, on small tables."""

import pytest
from pyspark.sql import functions as F

from quaywork.operators import canonical as ca
from quaywork.operators import flatten as fl
from quaywork.operators import importing as im
from quaywork.operators import structure as sr
from quaywork.sources import imports
from quaywork.sources.store import SecondWriter, StaleUndo, VersionedStore


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_flatten_odd_records(spark):
    records = [
        (1, '{"a": {"b": {"c": 1.50}}, "x.y": "dotted", "x": {"y": true}, "list": [1, "two"], "kids": [{"n": "k0"}, null, {"m": {"o": null}, "kids": [{"z": 0}]}]}'),
        (2, '{"a": "flat", "kids": []}'), (3, "not json"), (4, None), (5, "[1]"), (6, '{"_key": "own"}'), (7, "{}"),
    ]
    made = fl.flatten(spark.createDataFrame(records, "id int, text string"), "id", "text", "t")
    assert list(made) == ["t", "t.kids", "t.kids.kids"]
    main = made["t"]
    assert set(main.columns) == {"__key", "_key", "a", "list", "x.y", "x.y#2"}
    got = {r["__key"]: r.asDict() for r in main.collect()}
    assert sorted(got) == list("1234567")
    assert (got["1"]["a"], got["2"]["a"], got["1"]["list"], got["6"]["_key"]) == ('{"b":{"c":1.5}}', "flat", '[1,"two"]', "own")
    assert {got["1"]["x.y"], got["1"]["x.y#2"]} == {"dotted", "true"}
    assert all(v is None for i in "3457" for k, v in got[i].items() if k != "__key")
    kids = made["t.kids"]
    assert rows_of(kids.select("_key", "_parent", "_ordinal", "n", "`m.o`")) == [("1.kids[0]", "1", 0, "k0", None), ("1.kids[1]", "1", 1, None, None), ("1.kids[2]", "1", 2, None, None)]
    assert rows_of(made["t.kids.kids"]) == [("1.kids[2].kids[0]", "1.kids[2]", 0, "0")]
    none = fl.flatten(spark.createDataFrame([], "id int, text string"), "id", "text", "t")
    assert list(none) == ["t"] and none["t"].collect() == []
    assert fl.short_headers([("a", "b"), ("c",), ("d", "b")]) == ["a.b", "c", "d.b"]


def sheet(spark, *rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows, 1)], "line int, cells array<string>")


def test_structural_rows(spark):
    raw = sheet(
        spark, ["Report"], ["SKU", "Name", "Qty", "Cost"], ["a", "b", "1", "2"], ["sku", "NAME", "qty", "Cost"], ["Grand-Total", "", "", "€ 1.200,50"], ["Total", "words", "", ""],
        ["", "", "lonely", ""], ["c", "d", "2", "3"], ["note " + "x" * 70, "", "", ""], ["n/a", "", "", "-"], ["", "Summe", "12", ""], ["the end"],
    )
    found = sr.structural_rows(raw, 2)
    assert sorted(map(tuple, found.collect())) == [(4, "repeated-header", "sku"), (5, "total", "Grand-Total"), (9, "footer", "note " + "x" * 54 + "…"), (11, "total", "Summe"), (12, "footer", "the end")]
    header, rows, gone = sr.apply_structure(raw, 2, found)
    assert header == ["SKU", "Name", "Qty", "Cost"] and [r.line for r in rows.orderBy("line").collect()] == [3, 6, 7, 8, 10]
    assert rows_of(sr.excluded_counts(gone, rows.where("line = 10"))) == [("blank", 1), ("footer", 2), ("repeated-header", 1), ("total", 2)]
    chosen = spark.createDataFrame([(5,), (8,), (1,), (5,), (99,)], "line int")
    _, rows, gone = sr.apply_structure(raw, 2, found, chosen)
    assert rows_of(gone) == [(5, "total"), (8, "user")] and 8 not in [r.line for r in rows.collect()]
    assert sr.structural_rows(raw, 50).collect() == [] and sr.structural_rows(raw.where("false"), 1).collect() == []
    narrow = sheet(spark, ["A", "B"], ["1", "2"], ["one"])
    assert sr.structural_rows(narrow, 1).collect() == []  # two columns have no footer


HEADER = ["Ref", "From", "To", "By", "State", "Out", "Paid", "X"]
MAP = ["shipment_id", "origin", "destination", "carrier", "status", "ship_date", "shipping_cost", None]


def test_column_maps(spark):
    told = lambda m, h=HEADER, c=None: [code for code, _ in ca.map_problems(h, im.SHIPMENT_COLUMNS, m, c)]
    assert told(MAP) == []
    assert ca.map_problems(HEADER, im.SHIPMENT_COLUMNS, MAP[:3]) == [("INVALID_MAPPING", "The column mapping lists 3 column(s) but the file header has 8.")]
    assert ca.map_problems(HEADER[:2], im.SHIPMENT_COLUMNS, ["shipment_id", "z" * 50]) == [("INVALID_MAPPING", f'The column mapping uses unknown field "{"z" * 40}…".')]
    assert ca.map_problems(HEADER[:2], im.SHIPMENT_COLUMNS, ["origin", "origin"]) == [("DUPLICATE_COLUMNS", 'Field "origin" is mapped from more than one column.')]
    assert ca.map_problems(HEADER[:2], im.SHIPMENT_COLUMNS, ["shipment_id", None], {"carrier": "A", "origin": "B", "destination": "C", "status": "pending"}) == [("MISSING_COLUMNS", "Missing required column(s): ship_date, shipping_cost. Mapped columns: shipment_id.")]
    assert told(MAP, c={"shipping_cost": "1"}) == told(MAP, c={"status": "gone"}) == told(MAP, c={"carrier": " "}) == ["INVALID_MAPPING"]
    with pytest.raises(ValueError, match="unknown field"):
        ca.plan(["a"], im.SHIPMENT_COLUMNS, ["b"])


def test_cooked_rows_and_their_problems(spark):
    how = ca.plan(HEADER, im.SHIPMENT_COLUMNS, MAP, number_preset="fr", date_preset="iso", date_presets={"ship_date": "dmy_dot"})
    long = "y" * 45
    raw = spark.createDataFrame([
        ("d/f.txt", 2, ["shp-1", "A", "B", "C", "geliefert", "5.3.2026 10:15", "1 234,50", "z"]), ("d/f.txt", 3, ["SHP-1", "A", "B", "C", "frei", "31.2.2026", "1.234,50", ""]),
        ("d/f.txt", 4, ["x"]), ("d/f.txt", 5, [""] * 7 + ["only here"]), ("d/f.txt", 6, ["shp-2", "n/a", "B", "C", long, "2026-03-05", "USD 5", "", " ", "more"]), ("d/f.txt", 7, [None, "A", "B", "C", "open", "1.4.2026", "-", None]),
    ], "file string, line int, cells array<string>")
    cooked = ca.cooked(raw, how, choices={"status": spark.createDataFrame([("frei", "pending"), ("frei", "zz")], "source string, target string")})
    got = {r.line: r for r in cooked.collect()}
    assert got[2].canonical == ["shp-1", "A", "B", "C", "delivered", "2026-03-05", "", "", "1234.50"] and got[2].place == "f.txt, line 2"
    assert got[3].canonical[4:] == ["pending", "31.2.2026", "", "", "1.234,50"]
    assert [(r.ragged, r.blank) for _, r in sorted(got.items())] == [(None, False), (None, False), (1, False), (None, True), (10, False), (None, False)]
    assert got[7].canonical[0] == "" and got[7].raws[8] == "-" == got[7].canonical[8]
    done = ca.dry_run(cooked, how, ["shipment_id"], 'shipment ID "{}"')
    said = {(r.line, r.column): r.message for r in ca.problems(done, how).collect()}
    assert said[3, "shipment_id"] == 'Duplicate shipment ID "SHP-1" (first seen on f.txt, line 2).'
    assert said[3, "ship_date"].startswith('"31.2.2026" is not a valid date.') and said[3, "ship_date"].endswith(" Date format: 15.8.2026 (day.month.year).")
    assert said[3, "shipping_cost"].endswith(" Number format: 1 234,56 (decimal comma, space thousands).")
    assert said[4, None] == "Expected 8 fields but found 1." and said[6, None] == "Expected 8 fields but found 10."
    assert (7, "shipment_id") in said and (7, "shipping_cost") in said and {k[0] for k in said} == {3, 4, 6, 7}
    assert ca.cooked(raw.where("false"), how).collect() == []


def test_long_values_are_quoted_in_part(spark):
    how = ca.plan(HEADER, im.SHIPMENT_COLUMNS, MAP)
    raw = spark.createDataFrame([(2, ["shp-1", "A", "B", "C", "w" * 60, "2026-03-05", "5", ""])], "line int, cells array<string>")
    (one,) = ca.problems(ca.dry_run(ca.cooked(raw, how), how, ["shipment_id"], 'shipment ID "{}"'), how).collect()
    assert one.message.startswith('"' + "w" * 40 + '…" is not a valid status') and one.place == "line 2"


@pytest.fixture
def places(spark):
    return spark.createDataFrame([("WH-1", "Hub One", "warehouse", 0), ("WH-2", "Hub Two", "warehouse", 1), ("C1", "City", "city", 2)], "code string, name string, kind string, _ord int")


def test_an_import_is_one_act(spark, tmp_path, places):
    store = VersionedStore(spark, str(tmp_path / "store"))
    good, bad, words = tmp_path / "good.csv", tmp_path / "bad.csv", tmp_path / "words.txt"
    head = "sku,product_name,category,warehouse,quantity,reorder_point,unit_cost,extra\n"
    good.write_text(head + 'AAA,"Nut, ""M4""",Parts,wh-1,5,2,1.50,x\nBBB,Bolt,Parts,WH-2,7,1,2,\n')
    bad.write_text(head + "AAA,Nut,Parts,WH-9,5,2,1.50,x\nAAA,,Parts,WH-1,5.5,2,1.50,x\n")
    words.write_text("Artikel;Name;Lager;Menge;Min;Preis\nCCC;Mutter 5\" Zoll;hub two;1.200;3;1,5\n")
    done = imports.import_file(store, "inventory", str(good), places)
    assert (done.version, done.row_count, done.problem_count, done.ignored) == (1, 2, 0, ("extra",))
    assert rows_of(store.read("inventory").select("sku", "product_name", "unit_cost_cents")) == [("AAA", 'Nut, "M4"', 150), ("BBB", "Bolt", 200)]
    failed = imports.import_file(store, "inventory", str(bad), places)
    assert failed.version is None and failed.problem_count == 3 == failed.problems.count() and store.version() == 1
    mapped = imports.import_file(store, "inventory", str(words), places, ["sku", "product_name", "warehouse", "quantity", "reorder_point", "unit_cost"], {"category": "Teile"}, format="semicolon-text", presets={"number_preset": "eu"})
    assert mapped.version == 2 and rows_of(store.read("inventory").select("sku", "warehouse", "quantity", "unit_cost_cents", "category")) == [("CCC", "WH-2", 1200, 150, "Teile")]
    assert store.undo(2) == 3 and store.read("inventory").count() == 2
    sample = store.read("inventory")
    assert imports.reset(store, sample, sample.limit(0)) == 4
    with pytest.raises(StaleUndo):
        store.undo(4)
    (tmp_path / "none.csv").write_text(head)
    with pytest.raises(ValueError, match="no data rows"):
        imports.import_file(store, "inventory", str(tmp_path / "none.csv"), places)
    with pytest.raises(ValueError, match="Missing required column"):
        imports.import_file(store, "shipments", str(good), places)
    with pytest.raises(ValueError, match="not a table"):
        imports.import_file(store, "orders", str(good), places)
    assert store.version() == 4


def test_a_second_writer_of_a_version_is_refused(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([(1,)], "n int")
    assert store.replace(inventory=one) == 1
    seen = store._log()
    store.replace(inventory=one)
    late = VersionedStore(spark, str(tmp_path / "store"))
    late._log = lambda: seen  # as read before the other writer's version
    with pytest.raises(SecondWriter):
        late.replace(shipments=one)
    assert store.version() == 2 and store.read("shipments") is None


def test_the_snapshot_of_a_version(spark, tmp_path):
    import json
    from datetime import date

    from quaywork.operators import snapshot as sn

    store = VersionedStore(spark, str(tmp_path / "store"))
    places = spark.createDataFrame([("WH-1", "Hub One DC", "warehouse", 30.0, -90.0, 10, 0), ("C1", "City", "city", 31.0, -95.0, None, 1)], "code string, name string, kind string, lat double, lon double, capacity_units long, _ord int")
    stock = spark.createDataFrame([("AAA", "Nut", "Parts", "WH-1", 12, 2, 150, 1.0, 14)], "sku string, product_name string, category string, warehouse string, quantity long, reorder_point long, unit_cost_cents long, avg_daily_usage double, lead_time_days int")
    sent = spark.createDataFrame([("S1", "WH-1", "C1", "C", "delivered", date(2026, 1, 1), date(2026, 1, 3), date(2026, 1, 5), 500)], "shipment_id string, origin string, destination string, carrier string, status string, ship_date date, estimated_delivery date, actual_delivery date, shipping_cost_cents long")
    store.replace(inventory=stock)
    assert imports.status(store) == {"version": 1, "tables": ["inventory"]}
    with pytest.raises(ValueError, match="both tables"):
        imports.snapshot_of(store, places, date(2026, 1, 10))
    store.replace(shipments=sent)
    rows = imports.snapshot_of(store, places, date(2026, 1, 10)).collect()
    found = {}
    for r in rows:
        found.setdefault(r.section, []).append(json.loads(r.value))
    assert set(found) == {"inventory", "shipments", "alerts", "kpis", "metrics", "utilization", "value_by_warehouse", "value_by_category", "shipments_by_status", "cost_by_month", "ontime_by_month", "lanes", "locations"}
    assert found["kpis"][0]["late"] == 1 and found["shipments"][0]["days_late"] == 2 and found["shipments"][0]["cost_method"] == "none" and found["utilization"][0]["utilization"] == 1.2
    assert {a["type"] for a in found["alerts"]} >= {"shipment_delayed", "invalid_data"} and found["metrics"][0]["supply"]["items"] == 1
    made = sn.snapshot_sections
    try:
        sn.snapshot_sections = imports.snapshot_sections = None  # a second call reads what the first one made
        assert imports.snapshot_of(store, places, date(2026, 1, 10)).count() == len(rows)
    finally:
        sn.snapshot_sections = imports.snapshot_sections = made


def test_header_problems():
    assert im.header_problems([" SKU", "sku"], im.inventory_columns([])) == [("DUPLICATE_COLUMNS", 'Column "sku" appears more than once.')]
    assert im.header_problems(["Shipment-ID"], im.SHIPMENT_COLUMNS)[0][1].startswith("Missing required column(s): origin, destination") and im.header_problems([], im.SHIPMENT_COLUMNS)[0][1].endswith("Found columns: (none).")


def test_other_locations_change_what_is_mapped(spark):
    from datetime import date

    from quaywork.operators.shipments import enrich_shipments

    sent = spark.createDataFrame([("S1", " hub  one", "c1", "C", "pending", date(2026, 1, 1), None, None, 500)], "shipment_id string, origin string, destination string, carrier string, status string, ship_date date, estimated_delivery date, actual_delivery date, shipping_cost_cents long")
    where = lambda *rows: spark.createDataFrame(list(rows), "code string, name string, kind string, lat double, lon double, capacity_units long, _ord int")
    known = enrich_shipments(sent, where(("WH-1", "Hub One", "warehouse", 1.0, 2.0, 5, 0), ("C1", "City", "city", 1.0, 3.0, None, 1)), date(2026, 1, 2)).first()
    none = enrich_shipments(sent, where(("ZZ", "Elsewhere", "city", 1.0, 3.0, None, 0)), date(2026, 1, 2)).first()
    assert known.route_key == "WH-1>C1" and known.distance_miles is not None
    assert none.route_key == "HUB ONE>C1" and none.distance_miles is None


def _plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_structural_rows_read_the_table_once(spark):
    """What is returned reads the rows that were written, not the table again for each kind."""
    raw = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["1", "2", "3"]), (3, ["A", "b", "C"]), (4, ["total", "", "5"]), (5, ["1", "2", ""]), (6, ["note", "", ""])], "line long, cells array<string>")
    found = sr.structural_rows(raw, 1)
    assert "LogicalRDD" not in _plan(found) and "LocalRelation" not in _plan(found)
    assert [tuple(r) for r in found.orderBy("line").collect()] == [(3, "repeated-header", "A"), (4, "total", "total"), (6, "footer", "note")]


def test_rows_are_parsed_once_for_their_problems(spark):
    """No filter on all of a row's problems stands before they are told apart, no join brings their keys back."""
    raw = spark.createDataFrame([(i, [k, "a", "b", "c", "pending", "2020-01-02", "", "", "5"]) for i, k in [(4, "abc-1"), (2, "ABC-1"), (3, "x"), (5, "x"), (7, "abc-1")]], "line long, cells array<string>")
    rows = im.check_shipments(raw, [c.name for c in im.SHIPMENT_COLUMNS])
    plan = _plan(im.issues(rows))
    assert "Join" not in plan and "size(problems" not in plan and plan.count("INVALID_STATUS") == 1
    found = {(r["line"], r["code"], r["message"][-9:]) for r in im.issues(rows).where("code = 'DUPLICATE_ID'").collect()}
    assert found == {(4, "DUPLICATE_ID", " line 2)."), (7, "DUPLICATE_ID", " line 2).")}
    assert im.accepted(rows).count() == 0 and im.accepted(rows.where("line = 2")).count() == 1


def test_a_small_file_of_parts_is_dealt_to_all_tasks(spark):
    from quaywork.plans import ingest_queries as iq

    assert iq.stock_words(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
