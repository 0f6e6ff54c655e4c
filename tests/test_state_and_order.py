"""Stream state, as-of lookups, order statistics and one-pass decisions against plain Python."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from seatgrid import schema as S
from seatgrid.operators import admission as A
from seatgrid.operators import changes as C
from seatgrid.operators import checkout as K
from seatgrid.operators import lookups as L
from seatgrid.operators import quality as Q
from seatgrid.sources import partitioned as P
from seatgrid.streaming import streams as ST
from seatgrid.streaming.state import live_parts

DAY = dt.date(2024, 1, 1)
T0 = dt.datetime(2024, 1, 1)


def test_live_parts_cover_every_batch_once():
    for n in range(200):
        parts = live_parts(n)
        assert [b for a, e in parts for b in range(a, e)] == list(range(n)) and len(parts) <= max(1, n.bit_length())


WRITES = "write_id long, reg_id decimal(38,0), user_id long, event_id long, registration_status string, ts timestamp"


def test_update_log_over_batches_and_a_restart(spark, tmp_path):
    """Seven micro-batches in two runs; one registration takes a third of all writes."""
    rng = random.Random(3)
    rows = [(i, Decimal(1 if rng.random() < 0.34 else rng.randint(2, 30)), 1, 1, rng.choice(["CONFIRMED", "CANCELLED", "WAITLIST", None]),
             T0 + dt.timedelta(minutes=i // 3)) for i in range(210)]
    files = tmp_path / "in"
    files.mkdir()
    stream = lambda: spark.readStream.schema(WRITES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(files))
    for stop in (3, 7):
        for b in range(stop):
            path = files / f"b{b}"
            if not path.exists():
                spark.createDataFrame(rows[30 * b:30 * b + 30], WRITES).coalesce(1).write.parquet(str(path))
                for f in path.glob("*.parquet"):
                    os.utime(f, (1_000_000 + b, 1_000_000 + b))
        got = ST.update_log(spark, stream(), str(tmp_path / "run"))
    last, want = {}, []
    for w, reg, _, _, status, _ in rows:
        if reg in last:
            want.append((w, reg, last[reg], status))
        last[reg] = status
    assert sorted((r.write_id, r.reg_id, r.old_status, r.new_status) for r in got.collect()) == want
    kept = sorted(p for p in os.listdir(tmp_path / "run" / "state") if p.startswith("part"))
    assert len(kept) <= len(live_parts(7)) + len(live_parts(6))  # what others have taken in is gone


def test_stream_ids_are_those_of_one_batch(spark, tmp_path):
    rows = [(i, i % 7, T0 + dt.timedelta(minutes=i)) for i in range(90)]
    for b in range(3):
        path = tmp_path / "in" / f"b{b}"
        spark.createDataFrame(rows[30 * b:30 * b + 30], "click_id long, user_id long, ts timestamp").coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_000_000 + b, 1_000_000 + b))
    stream = spark.readStream.schema("click_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = ST.assign_ids(spark, stream, ["ts", "click_id"], "row_id", 100)
    want = C.assign_ids(spark.createDataFrame(rows, "click_id long, user_id long, ts timestamp"), [F.col("ts"), F.col("click_id")], 100, "row_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_state_as_of(spark):
    rng = random.Random(4)
    log = [(Decimal(1 if rng.random() < 0.4 else rng.randint(2, 9)), DAY + dt.timedelta(rng.randint(0, 9)), i, rng.choice("ABC")) for i in range(150)]
    asks = [(Decimal(k), DAY + dt.timedelta(d)) for k in range(1, 11) for d in range(-1, 11)]
    got = C.state_as_of(spark.createDataFrame(log, "reg_id decimal(38,0), at date, seq long, status string"),
                        spark.createDataFrame(asks, "reg_id decimal(38,0), as_of date"))
    want = {}
    for k, d in asks:
        past = [(at, seq, st) for r, at, seq, st in log if r == k and at <= d]
        want[k, d] = max(past)[2] if past else None
    assert {(r.reg_id, r.as_of): r.registration_status for r in got.collect()} == want


def _sessions(spark, rows):
    return spark.createDataFrame([(e, f"S{e}", d, s, t, 5, Decimal("1.00"), "ACTIVE", 0) for e, d, s, t in rows], S.SESSIONS)


def test_conflict_counts(spark):
    """Also with ends before starts, equal ends, texts that are no times, and nulls."""
    rng = random.Random(5)
    times = ["09:00", "09:30", "10:00", "11:00", "9:00", "noon", "23:59", None]
    sess = [(e, rng.choice([DAY, DAY + dt.timedelta(1), None]), rng.choice(times), rng.choice(times)) for e in range(1, 60)]
    regs = [(Decimal(i), rng.choice([1, 1, 2, 3]), rng.randint(1, 62), DAY, "COMPLETED", rng.choice(["CONFIRMED", "CONFIRMED", "CANCELLED"]), Decimal("1.00"))
            for i in range(200)]
    reqs = [(i, rng.choice([1, 2, 3, 4, None]), rng.randint(1, 64), T0) for i in range(120)]
    s, q = _sessions(spark, sess), spark.createDataFrame(reqs, "request_id long, user_id long, event_id long, ts timestamp")
    r = spark.createDataFrame(regs, "reg_id decimal(38,0), user_id long, event_id long, registration_date date, payment_status string, "
                                    "registration_status string, amount_paid decimal(10,2)")
    got = {x.request_id: x.conflict_count for x in L.conflict_counts(q, s, r).collect()}
    assert got == {x.request_id: x.conflict_count for x in L.time_conflict_count(q, s, r).collect()}
    at = {e: v for e, *v in sess}

    def meets(a, b):
        return None not in (*a, *b) and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]
    assert got == {i: sum(u == x[1] and x[5] == "CONFIRMED" and e in at and x[2] in at and meets(at[e], at[x[2]]) for x in regs) for i, u, e, _ in reqs}
    assert sum(got.values()) > 100


def test_total_revenue_ranges(spark):
    rng = random.Random(6)
    regs = [(i, rng.choice([None, *[DAY + dt.timedelta(k) for k in range(9)]]), rng.choice(["COMPLETED", "PENDING"]), Decimal(rng.randint(1, 9999)) / 100)
            for i in range(80)]
    days = [None, *[DAY + dt.timedelta(k) for k in range(-2, 12)]]
    ranges = [(i, rng.choice(days), rng.choice(days)) for i in range(60)]
    got = L.total_revenue_ranges(spark.createDataFrame(ranges, "range_id long, date_from date, date_to date"),
                                 spark.createDataFrame(regs, "reg_id long, registration_date date, payment_status string, amount_paid decimal(10,2)"))
    want = {i: sum((m for _, d, st, m in regs if st == "COMPLETED" and None not in (a, b, d) and a <= d <= b), Decimal(0)) for i, a, b in ranges}
    assert {r.range_id: r.total_revenue for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _chain(spark, n):
    sessions = spark.createDataFrame([(e, f"S{e}", DAY, "09:00", "10:00", 1, Decimal("1.00"), "ACTIVE", 0) for e in range(1, n + 2)], S.SESSIONS)
    cart = spark.createDataFrame([(2 * u + k, u, u + k, DAY) for u in range(1, n + 1) for k in (0, 1)], S.CART)
    firsts = spark.createDataFrame([(u, u, T0 + dt.timedelta(seconds=u)) for u in range(1, n + 1)], "user_id long, checkout_id long, ts timestamp")
    return firsts, cart, sessions


def test_a_chain_of_ten_thousand_checkouts(spark, monkeypatch):
    """One ordered pass over the component; no round of votes."""
    monkeypatch.setattr(K, "positions_from_tags", lambda *a, **k: pytest.fail("a round of votes"))
    won = {r.checkout_id: r.won for r in K.race(*_chain(spark, 10_000)).collect()}
    assert won == {u: u % 2 == 1 for u in range(1, 10_001)}


def test_large_components_vote_first(spark):
    """Components above the pass's bound go through votes, to the same result."""
    won = {r.checkout_id: r.won for r in K.race(*_chain(spark, 12), walk_rows=8).collect()}
    assert won == {u: u % 2 == 1 for u in range(1, 13)}


def test_full_sessions_tie_nothing(spark, monkeypatch):
    """Whoever asks for a session without a seat loses and leaves the race: what remains competes for nothing here."""
    monkeypatch.setattr(K, "connected_components", lambda edges: pytest.fail("components"))
    seats = {1: 0, 2: 2, 3: -1, 4: 1}  # left
    sessions = spark.createDataFrame([(e, f"S{e}", DAY, "09:00", "10:00", 5, Decimal("1.00"), "ACTIVE", 5 - n) for e, n in seats.items()], S.SESSIONS)
    carts = {1: [1, 2], 2: [2], 3: [2, 3], 4: [2, 4], 5: [1, 4], 6: [3]}
    cart = spark.createDataFrame([(10 * u + e, u, e, DAY) for u, es in carts.items() for e in es], S.CART)
    firsts = spark.createDataFrame([(u, u, T0 + dt.timedelta(seconds=u)) for u in carts], "user_id long, checkout_id long, ts timestamp")
    won = {r.checkout_id: r.won for r in K.race(firsts, cart, sessions).collect()}
    assert won == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_a_session_that_is_there_twice(spark):
    """Its asks, alike in every column, stay with their checkout: one that fails doesn't make the next one fail."""
    sessions = spark.createDataFrame([(e, f"S{e}", DAY, "09:00", "10:00", n, Decimal("1.00"), "ACTIVE", 0) for e, n in ((1, 3), (1, 3), (2, 2))], S.SESSIONS)
    carts = {u: [1, 2] for u in range(1, 41, 2)} | {u: [2] for u in range(2, 41, 2)}
    cart = spark.createDataFrame([(10 * u + e, u, e, DAY) for u, es in carts.items() for e in es], S.CART)
    firsts = spark.createDataFrame([(u, u, T0 + dt.timedelta(seconds=u)) for u in carts], "user_id long, checkout_id long, ts timestamp")
    won = {r.checkout_id: r.won for r in K.race(firsts, cart, sessions).collect()}
    assert won == {u: u in (1, 2) for u in carts}
    walk, got = K.SeatWalk(), []
    for ask in [(9, 1, "U", 2), (9, 1, "U", 2), (9, 1, "U", 2), (9, 1, "U", 2), (8, 1, "U", 1)]:
        got.append(walk.see(*ask))
    assert got == ["", "A", "", "R", "A"]


def test_without_a_limit_nothing_is_counted(spark, monkeypatch):
    _, cart, sessions = _chain(spark, 5)
    checkouts = spark.createDataFrame([(u, u, T0 + dt.timedelta(seconds=u), u != 3) for u in range(1, 7)],
                                      "checkout_id long, user_id long, ts timestamp, payment_ok boolean")
    regs = spark.createDataFrame([(i, 1, 100 + i, DAY, "COMPLETED", "CONFIRMED", Decimal("1.00")) for i in range(4)], S.REGISTRATIONS)
    limited = {r.checkout_id: (r.status, r["items"]) for r in K.all_or_nothing(checkouts, cart, sessions, regs).collect()}
    monkeypatch.setattr(K, "_reg_count", lambda *a: pytest.fail("registrations are counted"))
    free = {r.checkout_id: (r.status, r["items"]) for r in K.all_or_nothing(checkouts, cart, sessions, regs, limit=None).collect()}
    yes, no = ("ACCEPTED", 2), ("REJECTED", 0)
    assert free == {1: yes, 2: no, 3: no, 4: yes, 5: no, 6: ("ACCEPTED", 0)}
    assert limited == {1: no, 2: yes, 3: no, 4: yes, 5: no, 6: ("ACCEPTED", 0)}


def test_a_chain_of_ten_thousand_requests(spark):
    """Each request overlaps only the next one: every second one is accepted."""
    n = 10_000
    sess = [(e, DAY, f"{2 * e:06d}", f"{2 * e + 3:06d}") for e in range(1, n + 1)]
    reqs = spark.createDataFrame([(e, 1, e, T0 + dt.timedelta(seconds=e)) for e in range(1, n + 1)], "request_id long, user_id long, event_id long, ts timestamp")
    got = A.ordered(reqs, _sessions(spark, sess), spark.createDataFrame([], S.REGISTRATIONS), spark.createDataFrame([], S.CART))
    assert {r.request_id: r.status for r in got.select("request_id", "status").collect()} == {
        e: "SUCCESS" if e % 2 else "FAILED" for e in range(1, n + 1)}


def test_quarantine_counts_and_rows_come_from_one_scan(spark, seed):
    users, sessions, _, _ = seed
    regs = spark.createDataFrame([(1, 1, 1, None, "COMPLETED", "CONFIRMED", None), (2, None, 1, None, "BAD", "LOST", None),
                                  (3, 77, 99, None, None, None, None)], S.REGISTRATIONS)
    seen = Observation("registrations")
    marked = Q.with_broken(regs, "registrations", {"users": users, "sessions": sessions}, seen)
    assert {int(r.reg_id): r.broken for r in marked.collect()} == {
        1: [], 2: ["user_not_null", "payment_status_check", "registration_status_check"], 3: ["fk_user", "fk_event"]}
    counts = {r.constraint_name: r.violations for r in Q.constraint_violations(users, sessions, regs, spark.createDataFrame([], S.CART))
              .filter("table_name = 'registrations'").collect()}
    assert seen.get["rows"] == 3 and all(seen.get[k] == counts[k] for k in seen.get if k != "rows")


def test_append_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    P.create(spark.createDataFrame([(i, f"m{i % 4}", i) for i in range(40)], "id long, month string, v long"), path, "month")
    files = lambda: {m: sorted(os.listdir(f"{path}/month={m}")) for m in ("m0", "m1", "m2", "m3")}
    before = files()
    new = spark.createDataFrame([(100, "m1", 7), (1, "m1", 8)], "id long, month string, v long")
    for _ in range(2):  # run again after a failure: the same table
        P.append(spark, path, new, "month", ["id"])
        got = {r.id: (r.month, r.v) for r in P.read(spark, path).collect()}
        assert got == {i: (f"m{i % 4}", i) for i in range(40)} | {100: ("m1", 7), 1: ("m1", 8)}
    after = files()
    assert all(after[m] == before[m] for m in ("m0", "m2", "m3")) and after["m1"] != before["m1"]


def test_daily_report_script(spark):
    from seatgrid.plans import sql_surface
    from seatgrid.sources.domain import Domain
    sql_surface.register(spark, Domain(spark, "/root/testdata/sf0.001"))
    assert sql_surface.daily_report(spark, "2024-01-01", 2).count() > 50
    assert sql_surface.daily_report(spark, "2024-01-01", -5).select("event_date").distinct().count() == 1
    assert [r.event_name for r in sql_surface.daily_report(spark, "2024-01-01", "many").collect()] == ["report failed"]
