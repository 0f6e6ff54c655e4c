"""Steps that shuffle their rows once: same rows as plain Python, and no second shuffle in the plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seatgrid.operators.asof import carry_last
from seatgrid.operators.lookups import near
from seatgrid.plans.sql_surface import FUNCTIONS
from seatgrid.sources.domain import Domain


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_keys", [1, 400])
def test_last_values_are_carried_over_batches_and_ranges(spark, n_keys):
    rng = random.Random(n_keys)
    rows = [(rng.randrange(n_keys), None if rng.random() < .02 else rng.randrange(1000), i, None if rng.random() < .9 else str(i)) for i in range(1500)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        df = spark.createDataFrame(rows, "k bigint, at bigint, i bigint, v string").repartition(4)
        out = carry_last(df, ["k"], ["at", "i"], F.when(F.col("v").isNotNull(), F.struct("v")), "o")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, held = {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2])):
        want[i] = held.get(k)
        held[k] = v or held.get(k)
    assert {r["i"]: r["o"] and r["o"]["v"] for r in out.collect()} == want
    assert not re.search(r"hashpartitioning\(_pid#\w+, \w+#", plan(out))  # rows by range and key


def _tables(spark, path):
    rng = random.Random(2)
    orders = [(o, rng.randrange(3), "OPF"[o % 3], f"2024-01-0{1 + o % 4}", ) for o in range(12)] + [(4, 1, "O", "2024-01-01"), (None, 1, "O", None)]
    lines = [(rng.randrange(13), rng.randrange(4), rng.randrange(2), rng.randrange(2), float(rng.randrange(3)), float(rng.randrange(99)),
              "ANR"[rng.randrange(3)] if i % 9 else None, "OF"[i % 2], f"2024-02-0{1 + i % 5}") for i in range(150)]
    lines += lines[:10]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_extendedprice double, "
                          "l_returnflag string, l_linestatus string, l_shipdate string").write.parquet(f"{path}/lineitem.parquet")
    return orders, lines


def _least(rows):
    return min(rows, key=lambda r: [(x is not None, x) for x in r])  # nulls first


def test_the_first_line_of_a_user_and_session_registers(spark, tmp_path):
    orders, lines = _tables(spark, str(tmp_path))
    groups = {}
    for ok, part, supp, no, qty, price, rf, ls, ship in lines:
        for o, cust, status, day in orders:
            if o == ok:
                groups.setdefault((cust, part), []).append((day, ok, no, qty, price, ship, supp, rf, ls, status))
    want = {}
    for key, rows in groups.items():
        day, _, _, _, price, _, _, rf, ls, status = _least(rows)
        paid = "REFUNDED" if rf == "R" else "PENDING" if status == "P" else "FAILED" if status == "O" and rf == "A" else "COMPLETED"
        want[key] = (day, paid, "CANCELLED" if rf == "R" else "WAITLIST" if ls == "O" and rf == "A" else "CONFIRMED", price)
    got = {(r["user_id"], r["event_id"]): (str(r["registration_date"]), r["payment_status"], r["registration_status"], float(r["amount_paid"]))
           for r in Domain(spark, str(tmp_path)).registrations.collect()}
    assert got == want


def test_lines_of_an_order_are_grouped_where_the_join_left_them(spark, tmp_path, no_broadcast):
    orders, lines = _tables(spark, str(tmp_path))
    shop = Domain(spark, str(tmp_path))._shop_lines(1)
    assert plan(shop).count("Exchange hashpartitioning") == 2  # the two sides of the join
    kept = {(o[0] // 2, x[1]) for o in orders for x in lines if o[0] is not None and o[0] % 2 == 1 and x[0] == o[0]}
    assert sorted((r[0], r[1]) for r in shop.select("user_id", "event_id").collect()) == sorted(kept)


def test_only_requests_on_a_date_with_something_are_searched(spark):
    ask = spark.createDataFrame([(1, 1, "d"), (2, 1, "e"), (3, 2, "d"), (4, None, "d"), (4, 1, "d")], "request_id bigint, user_id bigint, event_date string")
    held = spark.createDataFrame([(1, "d"), (1, "d"), (1, "x")], "user_id bigint, event_date string")
    cart = spark.createDataFrame([(2, "d"), (2, "e")], "user_id bigint, event_date string")
    asked, in_held, in_cart = near(ask, held, cart)
    assert sorted(r[0] for r in asked.select("request_id").collect()) == [1, 3, 4]
    assert [in_held.count(), in_cart.count()] == [2, 1]


def test_a_conflict_call_meets_only_its_user_and_date(spark):
    held = [(1, "2024-01-01", [("09:00", "10:30", 2), ("10:00", "12:00", 3), (None, "23:00", 9)]), (2, "2024-01-01", [("00:00", "23:00", 7)])]
    spark.createDataFrame(held, "user_id bigint, event_date string, spans array<struct<start_time: string, end_time: string, times: bigint>>") \
        .selectExpr("user_id", "CAST(event_date AS DATE) AS event_date", "spans").createOrReplaceTempView("held_days")
    for name in ("fn_overlaps_among", "fn_check_time_conflict"):
        _, params, result, body = next(f for f in FUNCTIONS if f[0] == name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    asks = [(1, 1, "10:30", "11:00"), (2, 1, "08:00", "09:00"), (3, 1, "09:30", "10:15"), (4, 3, "08:00", "20:00"), (5, 1, None, "20:00"), (6, None, "08:00", "20:00")]
    spark.createDataFrame(asks, "id bigint, u bigint, s string, e string").createOrReplaceTempView("conflict_asks")
    out = spark.sql("SELECT id, fn_check_time_conflict(u, DATE '2024-01-01', s, e) AS n FROM conflict_asks")
    assert {r["id"]: r["n"] for r in out.collect()} == {1: 3, 2: 0, 3: 5, 4: 0, 5: 0, 6: 0}
    assert not re.search(r"Join.*<(?!=)", out._jdf.queryExecution().optimizedPlan().toString())
