"""The queries that the others are made of give the rows of their SQL on the smallest tables."""

import pytest

from quaywork.plans import all_queries as supply
from tests.oracle import compare, database

SMALL = "/root/testdata/sf0.001"
NAMES = """inventory_enriched shipments_enriched cost_assessment data_issue_counts warehouse_utilization kpi_summary supply_metrics
shipping_cost_by_month route_summary alerts_all alert_page_3 transfer_plan action_queue billing_candidates search_shipments sort_nulls_last page_2
import_inventory_issues import_shipment_issues import_first_issues import_refused import_accepted canonical_csv number_preset_unique
number_preset_marked date_preset_ambiguous currency_decision status_words location_summary column_profile shipment_figures lane_labels
transit_dots import_impact snapshot_json
flatten_records flatten_children flatten_grandchildren structural_rows excluded_counts cooked_cells dry_run_problems problems_csv cooked_accepted canonical_file
spelling_pairs event_draws snapshot metrics_whole import_gate number_decisions date_decisions currency_decisions pages mapped_lanes reference_lanes alias_keys idle_items""".split()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, con, name):
    said = compare(spark, con, name, supply.queries()[name], supply.oracle_sql()[name], SMALL)
    assert said.startswith("ok "), said


def test_every_query_has_sql():
    assert set(supply.queries()) == set(supply.oracle_sql())


def test_lines_are_dealt_once_by_order(spark):
    """The aggregate of lines finds them where the join with orders left them, whatever is too large to broadcast."""
    import re

    from quaywork.plans import standins as st

    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = st.shipments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    dealt = re.findall(r"Exchange hashpartitioning\((l_\w+)#\d+L?(, l_)?", plan)
    assert dealt.count(("l_orderkey", "")) == 1 and ("l_orderkey", ", l_") not in dealt
