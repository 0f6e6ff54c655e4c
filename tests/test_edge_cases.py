"""Edge cases of FIXTURES.md section 4."""

import datetime as dt
from decimal import Decimal

from seatgrid import schema as S
from seatgrid.operators import admission as A
from seatgrid.operators import changes as C
from seatgrid.operators import checkout as K
from seatgrid.operators import lookups as L
from seatgrid.operators import reports as R

T0 = dt.datetime(2024, 1, 1, 9, 0)
D = dt.date(2024, 12, 15)


def _sessions(spark, rows):
    return spark.createDataFrame(rows, S.SESSIONS)


def _req(spark, rows):
    return spark.createDataFrame([(i, u, e, T0 + dt.timedelta(minutes=i)) for i, u, e in rows], S.REQUESTS)


def _regs(spark, rows):
    return spark.createDataFrame(rows, S.REGISTRATIONS)


def test_touching_times_do_not_conflict(spark):
    s = _sessions(spark, [(1, "A", D, "10:00", "13:00", 50, Decimal(1), "ACTIVE", 0),
                          (2, "B", D, "13:00", "15:00", 50, Decimal(1), "ACTIVE", 0)])
    assert R.event_conflict_pairs(s).count() == 0
    regs = _regs(spark, [(1, 1, 1, D, "COMPLETED", "CONFIRMED", Decimal(1))])
    c = L.time_conflict_count(_req(spark, [(1, 1, 2)]), s, regs).first()
    assert c.conflict_count == 0


def test_half_full_rule(spark):
    """3 confirmed: a session exactly 50% full is rejected, 49% is admitted at cart add but the
    checkout limit (confirmed + cart > 3) still rejects it."""
    s = _sessions(spark, [(1, "A", D, "08:00", "09:00", 10, Decimal(1), "ACTIVE", 1),
                          (2, "B", D, "09:00", "10:00", 10, Decimal(1), "ACTIVE", 1),
                          (3, "C", D, "10:00", "11:00", 10, Decimal(1), "ACTIVE", 1),
                          (4, "Half", D, "12:00", "13:00", 100, Decimal(1), "ACTIVE", 50),
                          (5, "Less", D, "14:00", "15:00", 100, Decimal(1), "ACTIVE", 49)])
    regs = _regs(spark, [(i, 1, i, D, "COMPLETED", "CONFIRMED", Decimal(1)) for i in (1, 2, 3)])
    empty = spark.createDataFrame([], S.CART)
    got = {r.request_id: r.message for r in A.half_full(A.admission_facts(_req(spark, [(1, 1, 4), (2, 1, 5)]), s, regs, empty)).collect()}
    assert got == {1: A.MSG_JS_LIMIT, 2: A.MSG_JS_ADDED}
    cart = spark.createDataFrame([(9, 1, 5, D)], S.CART)
    co = spark.createDataFrame([(1, 1, T0, "CARD", True)], S.CHECKOUTS)
    msg = K.validate(co, cart, s, regs).first().message
    assert msg.startswith("You can only register for maximum 3 events. You already have 3 confirmed")


def test_unknown_session_by_variant(spark, seed):
    users, sessions, regs, cart = seed
    f = A.admission_facts(_req(spark, [(1, 1, 99)]), sessions, regs, cart)
    assert A.strict(f).first().message == A.MSG_NOT_FOUND
    b = A.basic(f).first()
    assert (b.status, b.message) == ("ERROR", A.MSG_FK)
    fp = L.fill_percentage(_req(spark, [(1, 1, 99)]), sessions).first().fill_percentage
    fz = L.fill_percentage_zero(_req(spark, [(1, 1, 99)]), sessions).first().fill_percentage
    sa = L.seat_availability(_req(spark, [(1, 1, 99)]), sessions).first().seats_available
    sn = L.seat_availability_null(_req(spark, [(1, 1, 99)]), sessions).first().seats_available
    assert (fp, fz, sa, sn) == (None, 0.0, False, None)


def test_reregistration_after_cancel_is_blocked(spark, seed):
    users, sessions, _, cart = seed
    regs = _regs(spark, [(1000001, 1, 1, D, "REFUNDED", "CANCELLED", Decimal(50))])
    got = A.strict(A.admission_facts(_req(spark, [(1, 1, 1)]), sessions, regs, cart)).first()
    assert got.message == A.MSG_REGISTERED


def test_cancel_twice(spark):
    regs = _regs(spark, [(7, 1, 1, D, "COMPLETED", "CONFIRMED", Decimal(50)),
                         (8, 1, 2, D, "PENDING", "CONFIRMED", Decimal(25))])
    cx = spark.createDataFrame([(1, 1, 7, T0), (2, 1, 7, T0 + dt.timedelta(minutes=1)), (3, 1, 8, T0), (4, 1, 99, T0)],
                               "request_id long, user_id long, reg_id long, ts timestamp")
    got = {r.request_id: r.status for r in C.cancel_registrations(regs, cx).collect()}
    assert got == {1: "SUCCESS", 2: "FAILED", 3: "FAILED", 4: "FAILED"}
    after = {r.reg_id: (r.payment_status, r.registration_status)
             for r in C.apply_cancellations(regs, C.cancel_registrations(regs, cx)).collect()}
    assert after[7] == ("REFUNDED", "CANCELLED") and after[8] == ("PENDING", "CONFIRMED")


def test_two_users_one_name_merge(spark, seed):
    _, sessions, _, _ = seed
    users = spark.createDataFrame([(1, "Sam", "a@x", "USER"), (2, "Sam", "b@x", "USER")], S.USERS)
    regs = _regs(spark, [(1, 1, 1, D, "COMPLETED", "CONFIRMED", Decimal(50)),
                         (2, 2, 3, D, "COMPLETED", "CONFIRMED", Decimal(40))])
    rows = R.registration_trend(users, regs, sessions).collect()
    assert len(rows) == 1 and rows[0].registrations == 2
    assert rows[0].events_registered == "Networking Dinner, Tech Conference 2024"


def test_last_seat_goes_to_the_earlier_checkout(spark):
    s = _sessions(spark, [(1, "A", D, "10:00", "11:00", 5, Decimal(1), "ACTIVE", 4)])
    regs = spark.createDataFrame([], S.REGISTRATIONS)
    cart = spark.createDataFrame([(1, 1, 1, D), (2, 2, 1, D)], S.CART)
    co = spark.createDataFrame([(10, 2, T0 + dt.timedelta(minutes=1), "CARD", True), (11, 1, T0, "CARD", True)],
                               S.CHECKOUTS)
    got = {r.checkout_id: r.status for r in K.all_or_nothing(co, cart, s, regs).collect()}
    assert got == {11: "ACCEPTED", 10: "REJECTED"}


def test_snapshot_commit_and_checkout_apply(spark, seed):
    """A checkout's new registrations, seat counts and cart become one committed version."""
    import pytest

    from seatgrid.session import scratch_path
    from seatgrid.sources import snapshots
    users, sessions, regs, _ = seed
    base = scratch_path(spark, "snap")
    assert snapshots.committed_version(spark, base) is None
    cart = spark.createDataFrame([(1, 1, 1, D), (2, 1, 3, D)], S.CART)
    v0 = snapshots.commit(spark, base, {"sessions": sessions, "registrations": regs, "cart": cart})
    co = spark.createDataFrame([(1, 1, T0, "CARD", True)], S.CHECKOUTS)
    dec = K.decision(co, snapshots.read(spark, base, "cart"), sessions, regs, "ora")
    new_regs = K.apply_registrations(dec, co, cart, sessions)
    new_sessions = K.apply_sessions(sessions, new_regs)
    left = K.apply_cart(cart, dec)
    v1 = snapshots.commit(spark, base, {"sessions": new_sessions, "registrations": new_regs, "cart": left})
    assert (v0, v1) == (0, 1)
    assert snapshots.read(spark, base, "cart").count() == 0
    assert snapshots.read(spark, base, "cart", version=0).count() == 2
    got = {r.event_id: r.booked_seats for r in snapshots.read(spark, base, "sessions").collect()}
    assert got[1] == 1 and got[3] == 1 and got[2] == 0
    # an uncommitted half-written version is invisible
    new_regs.write.mode("overwrite").parquet(f"{base}/registrations/v=2")
    assert snapshots.committed_version(spark, base) == 1
    with pytest.raises(Exception):
        from seatgrid.operators.quality import assert_no_overbooking
        bad = spark.createDataFrame([(1, 5, 6)], "event_id long, total_seats int, raw_booked long")
        assert_no_overbooking(bad).collect()



def test_bound_parameter_lookup(spark, seed):
    from seatgrid.plans import sql_surface
    from seatgrid.sources.domain import Domain
    users, sessions, _, cart = seed
    regs = _regs(spark, [(1, 1, 1, D, "COMPLETED", "CONFIRMED", Decimal(50)), (2, 2, 3, D, "COMPLETED", "CONFIRMED", Decimal(40))])
    d = Domain(spark, "/nonexistent")
    for name, df in {"users": users, "sessions": sessions, "registrations": regs, "cart": cart}.items():
        d.__dict__[name] = df
    sql_surface.register(spark, d)
    rows = sql_surface.user_registrations_for(spark, 2).collect()
    assert [r.event_id for r in rows] == [3]
