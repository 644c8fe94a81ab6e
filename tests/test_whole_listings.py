"""Sorts and searches without a limit have all rows of their SQL, sorts in its order too."""

import pytest

from quaywork.plans import queries as supply
from tests.oracle import compare, database, plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def in_order(spark, con, name):
    frame = supply.queries()[name](spark, SF)
    got = [tuple(map(plain, r)) for r in frame.collect()]
    found = con.execute(supply.oracle_sql()[name])
    assert frame.columns == [c[0] for c in found.description]
    assert got == [tuple(map(plain, r)) for r in found.fetchall()]
    return got


def test_sort_goes_down_to_the_nulls(spark, con):
    values = [r[1] for r in in_order(spark, con, "sort_nulls_last")]
    assert len(values) == supply.inventory(spark, SF).count()
    known = [v is not None for v in values]
    assert True in known[50:] and False in known and known == sorted(known, reverse=True)


def test_attention_has_every_rank(spark, con):
    ranks = [r[1] for r in in_order(spark, con, "attention_first")]
    assert {3, 2, 0} <= {*ranks} and ranks == sorted(ranks, reverse=True) and len(ranks) == supply.inventory(spark, SF).count()


def test_search_finds_more_than_one_carrier(spark, con):
    name = "search_shipments"
    said = compare(spark, con, name, supply.queries()[name], supply.oracle_sql()[name], SF)
    assert said.startswith("ok "), said
    found = supply.assessed(spark, SF).join(supply.queries()[name](spark, SF), "shipment_id", "left_semi")
    assert not found.where("not contains(lower(concat_ws(' ', shipment_id, origin, destination, carrier, route_label)), 'carrier 1')").isEmpty()
