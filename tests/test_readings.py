"""Queries read their large tables no more often than they need."""

import pytest

from quaywork.operators import profiling as pr
from quaywork.plans import all_queries as supply

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["currency_decisions", "number_decisions", "date_decisions"])
def test_lines_of_all_columns_are_made_once(spark, name):
    plan = supply.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan  # only the written lines are read


def test_code_of_the_decisions_compiles(spark):
    """A function of more than 64 KB can't be compiled and its rows are then worked on one expression at a time."""
    found = supply.queries()["currency_decisions"](spark, SMALL)
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert found.count() == 6
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_columns_are_decided_apart(spark):
    values = spark.createDataFrame([("a", "$1", 1), ("a", "2 eur", 3), ("b", "7", 1), ("c", "€5", 2), ("c", "€ much", 1)], "source string, value string, count long")
    assert {tuple(r) for r in pr.currency_decisions(values, ["source"]).collect()} == {("a", "mixed", "EUR"), ("b", "ok", ""), ("c", "foreign", "€")}
    told = {r["source"]: (r["kind"], r["examined"], r["unfit"]) for r in pr.number_preset(values, ["source"]).collect()}
    assert told == {"a": ("equivalent", 4, 0), "b": ("equivalent", 1, 0), "c": ("equivalent", 3, 1)}


def test_a_page_is_cut_from_its_groups():
    from quaywork.operators.alerts import groups_of_page

    counts = {("info", "missing_info"): 9, ("critical", "shipment_delayed"): 4, ("critical", "low_stock"): 30, ("warning", "low_stock"): 40}
    assert groups_of_page(counts, 25, 25) == ([("critical", "low_stock"), ("critical", "shipment_delayed"), ("warning", "low_stock")], 0)
    assert groups_of_page(counts, 34, 25) == ([("warning", "low_stock")], 34)
    assert groups_of_page(counts, 75, 25) == ([("info", "missing_info")], 74)
    assert groups_of_page({}, 0, 25) == ([], 0)


def test_counts_of_alerts_make_no_texts(spark):
    plan = supply.queries()["alert_counts"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Data issue" not in plan and "Out of stock" not in plan and "SortMergeJoin" not in plan


def test_lanes_without_peers_are_not_joined(spark):
    from quaywork.operators.shipments import cost_statistics

    rows = [("A>B", "x", "delivered", c, 100.0) for c in range(100, 108)] + [("C>D", "x", "delivered", 5, 100.0)]
    shipments = spark.createDataFrame(rows, "route_key string, carrier string, status string, shipping_cost_cents long, distance_miles double")
    assert [r["route_key"] for r in cost_statistics(shipments)[0].collect()] == ["A>B"]
