"""Bulk state transitions: the reference's one-row procedures and triggers as set jobs.

Each function takes the current tables and a table of requests and returns either a
decision per request or the new rows of a table. Nothing here loops per row: "first
wins" is an aggregate of a (time, id) struct per key, running counts use
``ordered_positions`` (range-partitioned, so a hot key spans many tasks).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatgrid.functions.rules import fill_pct
from seatgrid.operators.asof import carry_last
from seatgrid.operators.ranking import ordered_positions

# Statuses and messages.
MSG_REQUIRED = "Name and email are required"
MSG_EMAIL_TAKEN = "Email already registered"
MSG_EMAIL_EXISTS = "Email already exists"  # what the application's own check says
MSG_USER_OK = "User registered successfully"
MSG_CANCEL_OK = "Registration cancelled and refund processed"
MSG_CANCEL_MISSING = "Registration not found or already cancelled"
MSG_CART_REMOVED = "Removed from cart successfully"
MSG_CART_DUP = "Event already in cart"


def _blank(c: str):
    return F.col(c).isNull() | (F.col(c) == "")


def current_max(df: DataFrame, col: str) -> int:
    """The current maximum key (one scalar aggregate; 0 for an empty table)."""
    v = df.agg(F.max(col)).first()[0]
    return int(v) if v is not None else 0


def assign_ids(df: DataFrame, order: list, start_after: int, id_col: str) -> DataFrame:
    """Dense surrogate keys start_after+1, start_after+2, ... in ``order``, assigned in parallel
    (range partitions number their rows after per-partition offsets; no single-task window)."""
    pos = ordered_positions(df, order)
    return pos.select(*df.columns, (F.lit(start_after) + F.col("_pos")).cast("bigint").alias(id_col))


def ingest_users(users: DataFrame, signups: DataFrame, taken_message: str = MSG_EMAIL_TAKEN) -> DataFrame:
    """Register users: required fields, then unique email (existing users and earlier requests).

    The first valid request per new email wins; winners get dense ids after max(user_id).
    """
    taken = signups.select("request_id", "email").join(users.select("email"), "email", "left_semi") \
        .select("request_id", F.lit(True).alias("_taken"))
    s = signups.join(taken, "request_id", "left")
    valid = ~(_blank("full_name") | _blank("email"))
    first = (s.filter(valid & F.col("_taken").isNull()).groupBy("email")
             .agg(F.min("request_id").alias("_first")))
    d = s.join(first, "email", "left")
    win = valid & F.col("_taken").isNull() & (F.col("request_id") == F.col("_first"))
    decided = d.select(
        "request_id", "full_name", "email",
        F.when(win, "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(~valid, MSG_REQUIRED).when(~win, taken_message).otherwise(MSG_USER_OK).alias("message"))
    winners = decided.filter(F.col("status") == "SUCCESS")
    ids = assign_ids(winners.select("request_id"), [F.col("request_id").asc()],
                     current_max(users, "user_id"), "user_id")
    return decided.join(ids, "request_id", "left")


def ingest_sessions(incoming: DataFrame, existing: DataFrame | None = None,
                    key: tuple[str, ...] = ("event_name", "event_date", "start_time")) -> DataFrame:
    """Insert-or-ignore on a business key: first incoming row per key (by event_id) is
    INSERTED unless the key already exists; the others are IGNORED."""
    k = list(key)
    inc = incoming
    if existing is not None:
        ex = existing.select(*k).distinct().withColumn("_exists", F.lit(True))
        inc = inc.join(ex, k, "left")
    else:
        inc = inc.withColumn("_exists", F.lit(None).cast("boolean"))
    first = inc.groupBy(*k).agg(F.min("event_id").alias("_first"))
    j = inc.join(first, k, "left")
    # NULL key parts never equal anything, so such rows are always inserted
    null_key = F.lit(False)
    for c in k:
        null_key = null_key | F.col(c).isNull()
    ins = null_key | (F.col("_exists").isNull() & (F.col("event_id") == F.col("_first")))
    return j.select("event_id", *k, F.when(ins, "INSERTED").otherwise("IGNORED").alias("status"))


def cart_remove(cart: DataFrame, removals: DataFrame) -> DataFrame:
    """Cart rows left after removing every cart id named by a removal request (unknown and null ids remove nothing)."""
    return cart.join(removals.select("cart_id"), "cart_id", "left_anti")


def cancel_registrations(registrations: DataFrame, cancels: DataFrame) -> DataFrame:
    """Cancel-and-refund: only a COMPLETED registration can be cancelled, once.

    Requests are applied in (ts, request_id) order per registration; the first one on a
    COMPLETED registration succeeds, later ones find it REFUNDED.
    """
    r = registrations.select("reg_id", "payment_status")
    first = cancels.groupBy("reg_id").agg(F.min(F.struct("ts", "request_id")).alias("_f"))
    j = cancels.join(r, "reg_id", "left").join(first, "reg_id", "left")
    ok = F.coalesce(F.col("payment_status") == "COMPLETED", F.lit(False)) & (F.col("request_id") == F.col("_f.request_id"))
    return j.select("request_id", "reg_id", "user_id",
                    F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"),
                    F.when(ok, MSG_CANCEL_OK).otherwise(MSG_CANCEL_MISSING).alias("message"))


def apply_cancellations(registrations: DataFrame, decisions: DataFrame) -> DataFrame:
    """New registrations table: cancelled rows become CANCELLED / REFUNDED."""
    done = decisions.filter(F.col("status") == "SUCCESS").select("reg_id").withColumn("_cx", F.lit(True))
    j = registrations.join(done, "reg_id", "left")
    cx = F.coalesce(F.col("_cx"), F.lit(False))
    return j.select(*[
        F.when(cx, F.lit("CANCELLED")).otherwise(F.col(c)).alias(c) if c == "registration_status"
        else F.when(cx, F.lit("REFUNDED")).otherwise(F.col(c)).alias(c) if c == "payment_status"
        else F.col(c) for c in registrations.columns])


def cancel_seat_delta(sessions: DataFrame, registrations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Seats released per session by successful cancellations, with the new booked count."""
    done = decisions.filter(F.col("status") == "SUCCESS").select("reg_id")
    rel = done.join(registrations.select("reg_id", "event_id"), "reg_id").groupBy("event_id").agg(
        F.count(F.lit(1)).alias("released"))
    j = rel.join(sessions.select("event_id", "booked_seats"), "event_id")
    return j.select("event_id", "released", F.col("booked_seats").alias("booked_before"),
                    (F.col("booked_seats") - F.col("released")).alias("booked_after"))


def audit_updates(before: DataFrame, after: DataFrame, updated_ids: DataFrame, as_of: str) -> DataFrame:
    """One audit row per updated registration (even when the status did not change)."""
    b = before.select("reg_id", F.col("registration_status").alias("old_status"))
    a = after.join(updated_ids.select("reg_id").distinct(), "reg_id").select(
        "reg_id", "user_id", "event_id", F.col("registration_status").alias("new_status"))
    j = a.join(b, "reg_id")
    rows = j.select("reg_id", "user_id", "event_id", F.lit("UPDATE").alias("action"),
                    F.lit(as_of).cast("date").alias("action_date"), "old_status", "new_status")
    return _audit_ids(rows)


def audit_inserts(inserted: DataFrame, as_of: str) -> DataFrame:
    """One audit row per inserted registration: new_status is the payment status, old is NULL."""
    rows = inserted.select("reg_id", "user_id", "event_id", F.lit("INSERT").alias("action"),
                           F.lit(as_of).cast("date").alias("action_date"),
                           F.lit(None).cast("string").alias("old_status"),
                           F.col("payment_status").alias("new_status"))
    return _audit_ids(rows)


def state_as_of(log: DataFrame, asks: DataFrame) -> DataFrame:
    """The audit log replayed: log (reg_id, at, seq, status) and asks (reg_id, as_of) to asks with the status that the
    registration had at the end of that day (null before its first entry). Entries of one day go by ``seq``.

    An as-of join in one order per registration: the last entry is carried over range partitions, so neither a
    registration with many entries nor one with many asks lands in one task."""
    a = asks.filter(F.col("reg_id").isNotNull()).select(
        "reg_id", F.col("as_of").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("status"))
    e = log.filter(F.col("reg_id").isNotNull()).select("reg_id", "at", F.lit(0).alias("ask"), F.col("seq").cast("bigint").alias("seq"), "status")
    value = F.when(F.col("ask") == 0, F.struct("status"))
    carried = carry_last(e.unionByName(a), ["reg_id"], ["at", "ask", "seq"], value, "_last")
    return carried.filter("ask = 1").select("reg_id", F.col("at").alias("as_of"), F.col("_last.status").alias("registration_status"))


def _audit_ids(rows: DataFrame) -> DataFrame:
    pos = ordered_positions(rows, [F.col("reg_id").asc()])
    return pos.select(F.col("_pos").alias("audit_id"), *[c for c in rows.columns if c != "reg_id"])


def seat_counts(sessions: DataFrame, inserted: DataFrame) -> DataFrame:
    """Seat counter: each inserted COMPLETED registration adds one seat to its session."""
    add = inserted.filter(F.col("payment_status") == "COMPLETED").groupBy("event_id").agg(
        F.count(F.lit(1)).alias("_n"))
    j = sessions.select("event_id", "total_seats").join(add, "event_id", "left")
    return j.select("event_id", "total_seats", F.coalesce(F.col("_n"), F.lit(0)).alias("booked_seats"))


def _wants_seat():
    return F.coalesce((F.col("payment_status") == "COMPLETED") & (F.coalesce("registration_status", F.lit("")) != "WAITLIST"), F.lit(False))


def waitlist_assign(sessions: DataFrame, inserted: DataFrame) -> DataFrame:
    """Arrival-order inserts into empty sessions: a row arriving when the paid, seated rows
    before it already fill the session becomes WAITLIST; a waitlisted row takes no seat.

    Rows that arrive with status WAITLIST take no seat either. Once a session is full it stays
    full, so "full" is: seat-taking rows before >= seats. The running count is range-partitioned per session (a hot session spans many tasks).
    """
    r = inserted.select("reg_id", "user_id", "event_id", "registration_date", "payment_status",
                        "registration_status")
    pos = ordered_positions(r, [F.col("registration_date").asc_nulls_first(), F.col("reg_id").asc()],
                            keys=["event_id"], weight=_wants_seat().cast("int"))
    j = pos.join(sessions.select("event_id", "total_seats"), "event_id", "left")
    full = F.coalesce(F.col("_before") >= F.col("total_seats"), F.lit(False))
    return j.select(
        "reg_id", "user_id", "event_id",
        F.when(full, "WAITLIST").otherwise(F.col("registration_status")).alias("registration_status"),
        (_wants_seat() & ~full).alias("takes_seat"))


def cart_dedupe(cart: DataFrame, adds: DataFrame) -> DataFrame:
    """Duplicate-cart guard: an add is rejected if (user, session) is already in the cart or
    an earlier add in the batch (by ts, request_id) named it."""
    ex = adds.select("request_id", "user_id", "event_id").join(cart.select("user_id", "event_id"),
                                                                 ["user_id", "event_id"], "left_semi") \
        .select("request_id", F.lit(True).alias("_in"))
    first = adds.groupBy("user_id", "event_id").agg(F.min(F.struct("ts", "request_id")).alias("_f"))
    j = adds.join(ex, "request_id", "left").join(first, ["user_id", "event_id"], "left")
    ok = F.col("_in").isNull() & (F.col("request_id") == F.col("_f.request_id"))
    return j.select("request_id", "user_id", "event_id", "ts",
                    F.when(ok, "ACCEPTED").otherwise("REJECTED").alias("status"),
                    F.when(ok, F.lit(None)).otherwise(F.lit(MSG_CART_DUP)).alias("message"))


# Column, type and default of each table's insert (a column without default is null; today: the insert's date).
DEFAULTS = {
    "users": [("user_id", "bigint", None), ("full_name", "string", None), ("email", "string", None), ("created_date", "date", "today"),
              ("user_type", "string", "USER")],
    "sessions": [("event_id", "bigint", None), ("event_name", "string", None), ("event_date", "date", None), ("start_time", "string", None),
                 ("end_time", "string", None), ("total_seats", "int", None), ("booked_seats", "int", 0),
                 ("ticket_price", "decimal(10,2)", None), ("event_status", "string", "ACTIVE"), ("created_date", "date", "today")],
    "registrations": [("reg_id", None, None), ("user_id", "bigint", None), ("event_id", "bigint", None),
                      ("registration_date", "date", "today"), ("payment_status", "string", "PENDING"),
                      ("registration_status", "string", "CONFIRMED"), ("payment_method", "string", None),
                      ("amount_paid", "decimal(10,2)", None)],
    "cart": [("cart_id", "bigint", None), ("user_id", "bigint", None), ("event_id", "bigint", None), ("added_date", "date", "today")],
    "audit": [("audit_id", "bigint", None), ("user_id", "bigint", None), ("event_id", "bigint", None), ("action", "string", None),
              ("action_date", "date", "today"), ("old_status", "string", None), ("new_status", "string", None),
              ("performed_by", "string", None)],
}


def apply_defaults(inserts: DataFrame, as_of: str | _dt.date, table: str = "registrations", **other) -> DataFrame:
    """An insert's rows with the table's defaults for the columns it leaves out; a column that is there keeps
    its values, nulls too. ``other`` replaces defaults (``payment_status="COMPLETED"`` for the PostgreSQL variant)."""
    def value(c, t, default):
        if c in inserts.columns:
            return F.col(c)
        default = other.get(c, default)
        return F.lit(str(as_of) if default == "today" else default).cast(t or "bigint").alias(c)
    return inserts.select(*[value(*d) for d in DEFAULTS[table]])


def auto_cancel(sessions: DataFrame, as_of: str | _dt.date, lookahead_days: int = 0) -> DataFrame:
    """Sessions table after the daily rule: sessions dated in (as_of, as_of + lookahead]
    with fill < 10% become CANCELLED. With lookahead 0 nothing changes."""
    d0 = F.lit(str(as_of)).cast("date")
    in_range = (F.col("event_date") > d0) & (F.col("event_date") <= F.date_add(d0, lookahead_days))
    rule = F.coalesce(in_range & (fill_pct() < 10), F.lit(False))
    return sessions.select("event_id", F.col("event_status").alias("old_status"),
                           F.when(rule, "CANCELLED").otherwise(F.col("event_status")).alias("event_status"),
                           rule.alias("changed"))


def cascade_delete(parents_deleted: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Child rows that survive deleting the given parent keys (ON DELETE CASCADE)."""
    return child.join(parents_deleted.select(key).distinct(), key, "left_anti")
