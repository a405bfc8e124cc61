"""Ties: customers with the same orders are alike, in whatever order the orders come."""

from __future__ import annotations

import datetime as dt

from panelkit.plans import domain


def _write(spark, folder, orders):
    spark.createDataFrame([(c, "BUILDING") for c in sorted({o[0] for o in orders})], "c_custkey long, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    rows = [(i, c, price, dt.datetime(1996, 5, 1 + i), "1-URGENT") for i, (c, price) in enumerate(orders)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{folder}/orders.parquet")


def test_sums_of_prices_do_not_hang_on_their_order(spark, tmp_path):
    prices = [0.1, 0.2, 0.3]  # doubles give 0.6000000000000001 one way and 0.6 the other
    _write(spark, tmp_path, [(1, p) for p in prices] + [(2, p) for p in prices[::-1]])
    spend = {r["id"]: r["spend"] for r in domain.panel_cy(spark, str(tmp_path)).where("year = 1996").collect()}
    assert spend == {1: 0.6, 2: 0.6}


def test_prices_that_no_decimal_holds_are_summed_as_they_are(spark, tmp_path):
    _write(spark, tmp_path, [(1, 1e30), (1, 2.5), (2, float("inf")), (2, 1.0), (3, None), (3, 4.25)])
    spend = {r["id"]: r["spend"] for r in domain.panel_cy(spark, str(tmp_path)).where("year = 1996").collect()}
    assert spend == {1: 1e30, 2: float("inf"), 3: 4.25}
