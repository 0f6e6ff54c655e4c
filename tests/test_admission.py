"""Cart admission, checkout and their in-order forms against plain sequential models."""

import datetime as dt
import random
from decimal import Decimal

from seatgrid import schema as S
from seatgrid.operators import admission as A
from seatgrid.operators import checkout as K

T0 = dt.datetime(2024, 1, 1, 9, 0)


def _req(spark, rows):
    return spark.createDataFrame([(i, u, e, T0 + dt.timedelta(minutes=m)) for i, u, e, m in rows], S.REQUESTS)


def test_seed_story(spark, seed):
    users, sessions, regs, cart = seed
    facts = A.admission_facts(_req(spark, [(1, 1, 1, 0)]), sessions, regs, cart)
    assert [tuple(r)[3:] for r in A.strict(facts).collect()] == [("SUCCESS", A.MSG_ADDED)]
    cart1 = spark.createDataFrame([(1, 1, 1, dt.date(2024, 1, 1))], S.CART)
    co = spark.createDataFrame([(7, 1, T0, "CARD", True)], S.CHECKOUTS)
    dec = K.decision(co, cart1, sessions, regs, "ora").collect()
    assert dec[0].status == "SUCCESS" and float(dec[0].total_amount) == 50.0 and dec[0].items == 1
    newregs = K.apply_registrations(K.decision(co, cart1, sessions, regs, "ora"), co, cart1, sessions)
    assert [(r.user_id, r.event_id, float(r.amount_paid)) for r in newregs.collect()] == [(1, 1, 50.0)]
    seats = K.apply_seats(sessions, newregs).collect()
    assert [(r.event_id, r.booked_after) for r in seats] == [(1, 1)]
    regs2 = spark.createDataFrame([(1000001, 1, 1, dt.date(2024, 1, 1), "COMPLETED", "CONFIRMED", Decimal("50.00"))],
                                  S.REGISTRATIONS)
    empty = spark.createDataFrame([], S.CART)
    out = A.strict(A.admission_facts(_req(spark, [(2, 1, 2, 1), (3, 1, 3, 2), (4, 1, 9, 3)]), sessions, regs2, empty))
    got = {r.request_id: (r.status, r.message) for r in out.collect()}
    assert got == {2: ("FAILED", A.MSG_CONFLICT), 3: ("SUCCESS", A.MSG_ADDED), 4: ("FAILED", A.MSG_NOT_FOUND)}


def _random_world(rng, n_users=4, n_sessions=8, n_regs=6, n_cart=4):
    times = ["09:00", "10:00", "10:30", "11:00", "12:00", "13:00", "14:00"]
    sessions = []
    for e in range(1, n_sessions + 1):
        a, b = sorted(rng.sample(times, 2))
        if rng.random() < 0.1:
            a, b = b, a  # an inverted interval now and then
        total = rng.randint(1, 3)
        sessions.append((e, f"S{e}", dt.date(2024, 1, 1 + rng.randint(0, 1)), a, b, total, Decimal(rng.randint(1, 9)),
                         "ACTIVE", rng.randint(0, total)))
    regs, seen = [], set()
    for i in range(n_regs):
        u, e = rng.randint(1, n_users), rng.randint(1, n_sessions)
        if (u, e) in seen:
            continue
        seen.add((u, e))
        regs.append((u * 100 + e, u, e, dt.date(2024, 1, 1), rng.choice(["COMPLETED", "PENDING"]),
                     rng.choice(["CONFIRMED", "CONFIRMED", "CANCELLED"]), Decimal("1.00")))
    cart, cseen = [], set()
    for i in range(n_cart):
        u, e = rng.randint(1, n_users), rng.randint(1, n_sessions)
        if (u, e) in cseen:
            continue
        cseen.add((u, e))
        cart.append((500 + i, u, e, dt.date(2024, 1, 1)))
    return sessions, regs, cart


def _overlap(a, b):
    return a[2] == b[2] and a[3] < b[4] and b[3] < a[4]


def _js_sequential(sessions, regs, cart, requests):
    sess = {s[0]: s for s in sessions}
    carts = {}
    for c in sorted(cart):
        if c[2] in sess:
            carts.setdefault(c[1], []).append(sess[c[2]])
    in_cart = {(c[1], c[2]) for c in cart}
    out = {}
    for rid, u, e, m in sorted(requests, key=lambda r: (r[3], r[0])):
        ev = sess.get(e)
        if ev is None:
            out[rid] = A.MSG_NOT_FOUND
            continue
        conf = [sess[r[2]] for r in sorted(regs) if r[1] == u and r[5] == "CONFIRMED" and r[2] in sess]
        booked, total = ev[8] or 0, ev[5]
        half = (booked * 2 >= total) and not (total == 0 and booked == 0)
        if len(conf) >= 3 and half:
            out[rid] = A.MSG_JS_LIMIT
            continue
        hit = next((c for c in conf if _overlap(c, ev)), None)
        if hit:
            out[rid] = A.MSG_JS_CONFLICT + hit[1]
            continue
        hit = next((c for c in carts.get(u, []) if _overlap(c, ev)), None)
        if hit:
            out[rid] = A.MSG_JS_CART_CONFLICT + hit[1]
            continue
        if (u, e) in in_cart:
            out[rid] = A.MSG_IN_CART
            continue
        if any(r[1] == u and r[2] == e for r in regs):
            out[rid] = A.MSG_REGISTERED
            continue
        out[rid] = A.MSG_JS_ADDED
        carts.setdefault(u, []).append(ev)
        in_cart.add((u, e))
    return out


def test_ordered_admission_matches_sequential(spark):
    rng = random.Random(7)
    for trial in range(4):
        sessions, regs, cart = _random_world(rng)
        requests = [(i, rng.randint(1, 4), rng.randint(1, 9), rng.randint(0, 30)) for i in range(1, 25)]
        want = _js_sequential(sessions, regs, cart, requests)
        got = A.ordered(_req(spark, requests), spark.createDataFrame(sessions, S.SESSIONS),
                        spark.createDataFrame(regs, S.REGISTRATIONS), spark.createDataFrame(cart, S.CART))
        got = {r.request_id: r.message for r in got.collect()}
        assert got == want, f"trial {trial}"


def _race_sequential(sessions, regs, cart, checkouts, limit):
    left = {s[0]: (s[5] - s[8]) for s in sessions}
    reg_count = {}
    for r in regs:
        if r[5] == "CONFIRMED" and r[4] == "COMPLETED":
            reg_count[r[1]] = reg_count.get(r[1], 0) + 1
    items = {}
    for c in cart:
        items.setdefault(c[1], []).append(c[2])
    first = {}
    for cid, u, ts, _, ok in sorted(checkouts, key=lambda c: (c[2], c[0])):
        if not ok or u in first:
            continue
        if limit is not None and reg_count.get(u, 0) + len(items.get(u, [])) > limit:
            continue
        first[u] = cid
    out = {}
    for cid, u, ts, _, ok in sorted(checkouts, key=lambda c: (c[2], c[0])):
        if first.get(u) != cid:
            continue
        its = [e for e in items.get(u, []) if e in left]
        if all(left[e] > 0 for e in its):
            for e in its:
                left[e] -= 1
            out[cid] = "ACCEPTED"
        else:
            out[cid] = "REJECTED"
    return out


def test_all_or_nothing_matches_sequential(spark):
    rng = random.Random(11)
    for trial in range(5):
        sessions, regs, cart = _random_world(rng, n_users=8, n_sessions=5, n_regs=4, n_cart=20)
        checkouts = [(i, rng.randint(1, 8), T0 + dt.timedelta(minutes=rng.randint(0, 20)), "CARD", rng.random() < 0.8)
                     for i in range(1, 16)]
        for limit in (None, 3):
            want = _race_sequential(sessions, regs, cart, checkouts, limit)
            got = K.all_or_nothing(spark.createDataFrame(checkouts, S.CHECKOUTS), spark.createDataFrame(cart, S.CART),
                                   spark.createDataFrame(sessions, S.SESSIONS), spark.createDataFrame(regs, S.REGISTRATIONS),
                                   limit=limit)
            # one row per checkout; those the model never tries (payment, limit, cart already booked) book nothing
            every = {c[0]: want.get(c[0], "REJECTED") for c in checkouts}
            assert {r.checkout_id: r.status for r in got.collect()} == every, f"trial {trial} limit {limit}"


def test_checkout_sequencing(spark, seed):
    """After a user's first successful checkout the cart is empty: later ones book nothing."""
    users, sessions, regs, _ = seed
    cart = spark.createDataFrame([(1, 1, 1, dt.date(2024, 1, 1)), (2, 1, 3, dt.date(2024, 1, 1))], S.CART)
    co = spark.createDataFrame([(1, 1, T0, "CARD", False), (2, 1, T0 + dt.timedelta(minutes=1), "CARD", True),
                                (3, 1, T0 + dt.timedelta(minutes=2), "CARD", True)], S.CHECKOUTS)
    got = {r.checkout_id: (r.status, r.items) for r in K.decision(co, cart, sessions, regs, "ora").collect()}
    assert got == {1: ("FAILED", 0), 2: ("SUCCESS", 2), 3: ("SUCCESS", 0)}
    js = {r.checkout_id: r.message for r in K.validate(co, cart, sessions, regs).collect()}
    assert js == {1: K.MSG_PAYMENT, 2: K.MSG_JS_OK, 3: K.MSG_EMPTY}


def test_long_chain_of_checkouts(spark):
    """Each checkout shares its only free seat with the next one: every second one books, however long the chain."""
    n = 9
    sessions = [(e, f"S{e}", dt.date(2024, 1, 1), f"{e + 8:02d}:00", f"{e + 8:02d}:30", 1, Decimal("1.00"), "ACTIVE", 0) for e in range(1, n + 2)]
    cart = [(10 * u + k, u, u + k, dt.date(2024, 1, 1)) for u in range(1, n + 1) for k in (0, 1)]
    checkouts = [(u, u, T0 + dt.timedelta(minutes=u), "CARD", True) for u in range(1, n + 1)]
    frames = (spark.createDataFrame(checkouts, S.CHECKOUTS), spark.createDataFrame(cart, S.CART),
              spark.createDataFrame(sessions, S.SESSIONS), spark.createDataFrame([], S.REGISTRATIONS))
    got = {r.checkout_id: r.status for r in K.all_or_nothing(*frames).collect()}
    assert got == {u: "ACCEPTED" if u % 2 else "REJECTED" for u in range(1, n + 1)}


def test_last_seat_is_sold_once(spark):
    sessions = [(1, "S1", dt.date(2024, 1, 1), "09:00", "10:00", 5, Decimal("2.00"), "ACTIVE", 4)]
    frames = (spark.createDataFrame([(1, 1, T0, "CARD", True), (2, 2, T0, "CARD", True), (3, 2, T0 + dt.timedelta(1), "CARD", True)], S.CHECKOUTS),
              spark.createDataFrame([(1, 1, 1, None), (2, 2, 1, None)], S.CART), spark.createDataFrame(sessions, S.SESSIONS),
              spark.createDataFrame([], S.REGISTRATIONS))
    dec = K.decision(*frames)
    assert {r.checkout_id: r.status for r in dec.collect()} == {1: "SUCCESS", 2: "ERROR", 3: "ERROR"}
    new = K.apply_registrations(dec, frames[0], frames[1], frames[2])
    assert [(r.booked_after, r.total_seats) for r in K.apply_seats(frames[2], new).collect()] == [(5, 5)]
    app = {r.checkout_id: r.message for r in K.validate(*frames).collect()}
    assert app == {1: K.MSG_JS_OK, 2: "Event S1 is fully booked", 3: "Event S1 is fully booked"}
    import pytest
    with pytest.raises(Exception, match="Cannot exceed total seat capacity"):
        K.apply_seats(frames[2], new.unionByName(new)).collect()
