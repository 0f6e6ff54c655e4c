"""Overlap join, global ranking, data quality and streaming = batch."""

import datetime as dt
import os
import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from seatgrid.operators import overlap
from seatgrid.operators.overlap import overlap_pairs
from seatgrid.operators.quality import constraint_violations
from seatgrid.operators.ranking import ordered_positions, rank_by


def test_overlap_pairs_brute_force(spark):
    rng = random.Random(3)
    times = ["08:00", "09:15", "09:59", "10:00", "12:30", "13:00", "23:59", "9:00", "24:00"]
    rows = []
    for i in range(60):
        a, b = rng.choice(times), rng.choice(times)
        rows.append((i, rng.randint(0, 2), dt.date(2024, 1, 1 + rng.randint(0, 1)), a, b))
    df = spark.createDataFrame(rows, "id long, user_id long, event_date date, start_time string, end_time string")
    got = overlap_pairs(df, df, ["user_id", "event_date"], ["user_id", "event_date"], bin_minutes=30,
                        extra=lambda l, r: l["l_id"] < r["r_id"])
    got = sorted((r.l_id, r.r_id) for r in got.collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows
                  if a[0] < b[0] and a[1] == b[1] and a[2] == b[2] and a[3] < b[4] and b[3] < a[4])
    assert got == want


def test_odd_times_in_bins_of_their_own(spark):
    """The same pairs, and two odd intervals share one bin."""
    rng = random.Random(4)
    times = ["08:00", "09:15", "12:30", "23:59", "9:00", "0800", "z", None]
    rows = [(i, rng.randint(0, 1), dt.date(2024, 1, 1), rng.choice(times), rng.choice(times)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, user_id long, event_date date, start_time string, end_time string")
    assert overlap.has_odd(df) and not overlap.has_odd(df.filter("start_time = '08:00' AND end_time IN ('09:15', '12:30') OR end_time IS NULL"))
    keys = ["user_id", "event_date"]
    got = [(r.l_id, r.r_id) for r in overlap_pairs(df, df, keys, keys, bin_minutes=30, odd_right=True).collect()]
    want = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and None not in (*a, *b) and a[3] < b[4] and b[3] < a[4]]
    assert sorted(got) == sorted(want)
    odd = overlap._prefixed(df.filter("start_time = 'z' AND end_time IS NOT NULL"), "x_")
    left, right = (overlap._with_bins(odd, "x_", 30, own).select("_bin").distinct() for own in ("enter", "have"))
    assert left.intersect(right).count() == 1


def test_rank_by_matches_pandas(spark):
    rng = random.Random(5)
    vals = [rng.choice([None, 1, 2, 2, 3, 5, 5, 5, 8]) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v long")
    got = rank_by(df, F.col("v"), rank_col="r", dense_col="d").toPandas().sort_values("id")
    p = pd.DataFrame({"v": vals}, dtype="float")
    # DESC with NULLs first: NULL sorts above every value
    key = p["v"].fillna(float("inf"))
    assert list(got["r"]) == list(key.rank(method="min", ascending=False).astype(int))
    assert list(got["d"]) == list(key.rank(method="dense", ascending=False).astype(int))


def test_ordered_positions_per_key(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3]), rng.randint(0, 50), rng.randint(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long, t long, w int")
    got = ordered_positions(df, [F.col("t").asc(), F.col("id").asc()], keys=["k"], weight=F.col("w"), num_partitions=7)
    got = {r.id: (r._pos, r._before, r._total) for r in got.collect()}
    for k in {r[1] for r in rows}:
        grp = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        acc = 0
        for i, r in enumerate(grp):
            assert got[r[0]] == (i + 1, acc, len(grp))
            acc += r[3]


def test_constraints_null_passes_and_duplicates(spark, seed):
    from decimal import Decimal

    from seatgrid import schema as S
    users, sessions, _, _ = seed
    bad_sessions = spark.createDataFrame(
        [(9, "X", dt.date(2024, 1, 1), "9:00", "10:00", 0, Decimal("-1.00"), None, None)], S.SESSIONS)
    regs = spark.createDataFrame([(1, 1, 1, None, "COMPLETED", "CONFIRMED", None), (2, 1, 1, None, "BAD", None, None),
                                  (3, 77, 1, None, None, None, None)], S.REGISTRATIONS)
    cart = spark.createDataFrame([], S.CART)
    out = constraint_violations(users, sessions.unionByName(bad_sessions), regs, cart)
    v = {(r.table_name, r.constraint_name): r.violations for r in out.collect()}
    assert v[("sessions", "seats_positive")] == 1
    assert v[("sessions", "price_non_negative")] == 1
    assert v[("sessions", "status_check")] == 0  # NULL passes a CHECK
    assert v[("sessions", "start_format")] == 1
    assert v[("registrations", "payment_status_check")] == 1
    assert v[("registrations", "user_event_unique")] == 1
    assert v[("registrations", "fk_user")] == 1
    assert v[("users", "email_unique")] == 0


def test_streams_equal_batch(spark):
    """Split the clickstream into several files: multi-batch stream results equal one batch."""
    from seatgrid.sources.domain import Domain
    from seatgrid.streaming import streams as ST

    src = "/root/testdata/sf0.001"
    d = Domain(spark, src)
    tmp = tempfile.mkdtemp(prefix="seatgrid-stream-")
    import pyarrow.parquet as pq
    ev = pq.read_table(f"{src}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    for i, start in enumerate(range(0, ev.num_rows, 400)):
        path = os.path.join(tmp, f"events_{i:03d}.parquet")
        pq.write_table(ev.slice(start, 400), path)
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    clicks = ST.click_stream(spark, tmp, max_files=1)
    cart = ST.cart_dedupe(spark, clicks)
    assert sorted(map(tuple, cart.collect())) == sorted(map(tuple, d.cart.collect()))
    wl = ST.waitlist(spark, ST.registration_stream(ST.click_stream(spark, tmp, max_files=1)), d.base_sessions)
    one = ST.waitlist(spark, ST.registration_stream(ST.click_stream(spark, src, glob="events.parquet")), d.base_sessions)
    assert sorted(map(tuple, wl.collect())) == sorted(map(tuple, one.collect()))
    sc = ST.seat_counts(spark, ST.registration_stream(ST.click_stream(spark, tmp, max_files=2)))
    want = (d.raw("events").filter("event_type = 'purchase' AND value >= 1")
            .groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("event_id")).count())
    assert sorted(map(tuple, sc.collect())) == sorted(map(tuple, want.collect()))


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_rank_by(spark):
    """RANK and DENSE_RANK over range partitions, nulls first."""
    import seatgrid.operators.ranking as RK
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3, None, 3, 1, 7, 7, 7, 2])], "id long, v long")
    small = {r.id: (r.r, r.d) for r in RK.rank_by(df, F.col("v"), rank_col="r", dense_col="d").collect()}
    assert small[1] == (1, 1) and small[4] == (2, 2) and small[0] == (5, 3) and small[3] == (8, 5)


def test_streams_go_on_after_a_stop(spark, tmp_path):
    """Runs over the same path: each goes on where the last one stopped, and the result is that of one run (R1-R4)."""
    import pyarrow.parquet as pq

    from seatgrid.sources.domain import Domain
    from seatgrid.streaming import streams as ST

    src = "/root/testdata/sf0.001"
    d = Domain(spark, src)
    ev = pq.read_table(f"{src}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    parts = [ev.slice(k, 350) for k in range(0, ev.num_rows, 350)]
    files = tmp_path / "in"
    files.mkdir()

    def clicks():
        return ST.click_stream(spark, str(files), max_files=1)

    runs = {
        "counts": lambda base: ST.seat_counts(spark, ST.registration_stream(clicks()), base),
        "audit": lambda base: ST.audit_log(spark, ST.registration_stream(clicks()), base),
        "waitlist": lambda base: ST.waitlist(spark, ST.registration_stream(clicks()), d.base_sessions, base),
        "cart": lambda base: ST.cart_dedupe(spark, clicks(), base),
    }
    for stop in (2, len(parts)):  # the second round starts after a stop, with more files
        for i, part in enumerate(parts[:stop]):
            path = files / f"events_{i:03d}.parquet"
            if not path.exists():
                pq.write_table(part, path)
                os.utime(path, (1_000_000 + i, 1_000_000 + i))
        got = {k: run(str(tmp_path / k)) for k, run in runs.items()}
    once = {k: run(str(tmp_path / f"{k}-once")) for k, run in runs.items()}
    for k in runs:
        assert sorted(map(repr, got[k].collect())) == sorted(map(repr, once[k].collect())), k
    assert sorted(map(tuple, got["cart"].collect())) == sorted(map(tuple, d.cart.collect()))


def test_damaged_commit_marker_fails_loudly(spark, tmp_path):
    import glob

    import pytest

    from seatgrid.sources import snapshots
    base = str(tmp_path / "s")
    assert snapshots.committed_version(spark, base) is None
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert snapshots.commit(spark, base, {"t": df}) == 0
    for f in glob.glob(f"{base}/_commits/v=0/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"not a table")
    with pytest.raises(Exception):
        snapshots.commit(spark, base, {"t": df.limit(0)})
    assert spark.read.parquet(f"{base}/t/v=0").count() == 2


def test_pair_key(spark):
    from seatgrid.functions.rules import pair_key
    big = 9_000_000_000
    rows = [(0, 0), (0, 1), (1, 0), (1, big), (2, 3), (big, big), (big, 0)]
    got = [int(r[0]) for r in spark.createDataFrame(rows, "a long, b long").select(pair_key(F.col("a"), F.col("b"))).collect()]
    assert got == [a * 10**19 + b for a, b in rows]


def test_defaults_fill_absent_columns_only(spark):
    from seatgrid.operators import changes as C
    ins = spark.createDataFrame([(1, 2, 3, None)], "reg_id long, user_id long, event_id long, payment_status string")
    r = C.apply_defaults(ins, "2024-01-10").first()
    assert r.payment_status is None and r.registration_status == "CONFIRMED" and str(r.registration_date) == "2024-01-10"
    pg = C.apply_defaults(ins.drop("payment_status"), "2024-01-10", payment_status="COMPLETED").first()
    assert pg.payment_status == "COMPLETED"
