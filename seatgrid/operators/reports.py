"""Named reports over users / sessions / registrations / cart (views V1-V18).

Aggregations run before joins wherever the grouping key is a join key: the registration
side is reduced per session or per user (partial + final hash aggregate, safe under a
hot key), and the reduced side is joined 1:1 to the dimension.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatgrid.functions.rules import desc_first, fill_pct, pct_half_up
from seatgrid.operators.ranking import ordered_positions, rank_by

SESSION_COLS = ["event_id", "event_name", "event_date", "start_time", "end_time",
                "total_seats", "booked_seats", "ticket_price", "event_status"]


def sessions_list(sessions: DataFrame) -> DataFrame:
    """All sessions (``SELECT *``)."""
    return sessions.select(*SESSION_COLS)


def _completed_revenue(registrations: DataFrame) -> DataFrame:
    r = registrations.filter(F.col("payment_status") == "COMPLETED")
    return r.groupBy("event_id").agg(F.sum("amount_paid").alias("_rev"), F.count("reg_id").alias("_nreg"))


def admin_dashboard(sessions: DataFrame, registrations: DataFrame) -> DataFrame:
    """Seats, availability, fill % and completed revenue per session (left join, filter in ON)."""
    agg = _completed_revenue(registrations)
    j = sessions.join(agg, "event_id", "left")
    return j.select(
        "event_id", "event_name", "event_date", "start_time", "end_time", "total_seats",
        F.col("booked_seats").alias("registered_seats"),
        (F.col("total_seats") - F.col("booked_seats")).alias("available_seats"),
        fill_pct().alias("fill_percentage"),
        F.coalesce(F.col("_rev"), F.lit(0).cast("decimal(20,2)")).alias("revenue"),
    )


def fill_pct_or_zero(booked: str = "booked_seats", total: str = "total_seats"):
    """Fill % that is 0 when the session is missing or has 0 seats (NULL booked stays NULL)."""
    return F.when(F.col(total).isNull() | (F.col(total) == 0), F.lit(0.0)).otherwise(fill_pct(booked, total))


def admin_dashboard_counts(sessions: DataFrame, registrations: DataFrame) -> DataFrame:
    """Dashboard variant with the number of completed registrations and 0-default fill %."""
    agg = _completed_revenue(registrations)
    j = sessions.join(agg, "event_id", "left")
    return j.select(
        "event_id", "event_name", "event_date", "total_seats", "booked_seats",
        (F.col("total_seats") - F.col("booked_seats")).alias("available_seats"),
        fill_pct_or_zero().alias("fill_percentage"),
        F.coalesce(F.col("_rev"), F.lit(0).cast("decimal(20,2)")).alias("total_revenue"),
        F.coalesce(F.col("_nreg"), F.lit(0)).alias("registrations_count"),
    )


def event_stats(sessions: DataFrame) -> DataFrame:
    """Per-session statistics; the per-row lookup function becomes a column expression."""
    return sessions.select(
        "event_id", "event_name", "event_date", "start_time", "end_time", "total_seats", "booked_seats",
        (F.col("total_seats") - F.col("booked_seats")).alias("available_seats"),
        fill_pct_or_zero().alias("fill_percentage"), "ticket_price", "event_status",
    )


def user_registration_summary(users: DataFrame, registrations: DataFrame) -> DataFrame:
    """Counts over all statuses; 'confirmed' means payment COMPLETED; spent includes refunds."""
    agg = registrations.groupBy("user_id").agg(
        F.count("reg_id").alias("_n"),
        F.sum(F.when(F.col("payment_status") == "COMPLETED", 1).otherwise(0)).alias("_c"),
        F.sum("amount_paid").alias("_s"),
    )
    j = users.join(agg, "user_id", "left")
    return j.select(
        "user_id", F.col("full_name").alias("user_name"), "email",
        F.coalesce(F.col("_n"), F.lit(0)).alias("total_registrations"),
        F.coalesce(F.col("_c"), F.lit(0)).cast("bigint").alias("confirmed_registrations"),
        F.coalesce(F.col("_s"), F.lit(0).cast("decimal(20,2)")).alias("total_spent"),
    )


def user_summary_completed(users: DataFrame, registrations: DataFrame) -> DataFrame:
    """Completed registrations and spend per user; users with none keep zero rows."""
    r = registrations.filter(F.col("payment_status") == "COMPLETED")
    agg = r.groupBy("user_id").agg(F.count("reg_id").alias("_n"), F.sum("amount_paid").alias("_s"))
    j = users.join(agg, "user_id", "left")
    return j.select(
        "user_id", "full_name", "email",
        F.coalesce(F.col("_n"), F.lit(0)).alias("total_registrations"),
        F.coalesce(F.col("_s"), F.lit(0).cast("decimal(20,2)")).alias("total_spent"),
    )


def event_popularity(sessions: DataFrame) -> DataFrame:
    """RANK by booked seats and DENSE_RANK by fill ratio over ACTIVE sessions (DESC, NULLs first)."""
    s = sessions.filter(F.col("event_status") == "ACTIVE").select(
        F.col("event_id").alias("id"), F.col("event_name").alias("name"), "event_date", "total_seats",
        F.col("booked_seats").alias("registered_seats"))
    r1 = rank_by(s, F.col("registered_seats"), rank_col="popularity_rank")
    ratio = F.try_divide(F.col("registered_seats").cast("double"), F.col("total_seats").cast("double"))
    r2 = rank_by(r1, ratio, rank_col="_r", dense_col="fill_rate_rank").drop("_r")
    return r2


def events_not_full(sessions: DataFrame, registrations: DataFrame) -> DataFrame:
    d = admin_dashboard(sessions, registrations)
    return d.filter(F.col("fill_percentage") < 100).select(
        "event_name", "event_date", "total_seats", "registered_seats", "fill_percentage")


def top_users(users: DataFrame, registrations: DataFrame, k: int = 5) -> DataFrame:
    """Top-k users by registrations (ties broken by user id); k is the feature, not a cap."""
    s = user_registration_summary(users, registrations).filter(F.col("total_registrations") > 0)
    return s.orderBy(F.col("total_registrations").desc(), F.col("user_id").asc()).limit(k)


def users_with_pending_cart(users: DataFrame, cart: DataFrame) -> DataFrame:
    """Cart item counts per (name, email); only users with items (HAVING COUNT > 0)."""
    per_user = cart.groupBy("user_id").agg(F.count("cart_id").alias("_n"))
    j = users.join(per_user, "user_id")
    return (j.groupBy(F.col("full_name").alias("name"), "email")
            .agg(F.sum("_n").alias("cart_items")))


def revenue_by_month(registrations: DataFrame) -> DataFrame:
    r = registrations.filter(F.col("payment_status") == "COMPLETED")
    return (r.groupBy(F.date_format("registration_date", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("total_registrations"), F.sum("amount_paid").alias("total_revenue"))
            .orderBy(desc_first("month")))


def cancellation_rate(sessions: DataFrame, registrations: DataFrame) -> DataFrame:
    """Attempts, cancellations and rate per session *name* (same names merge).

    A session without registrations is one joined row that counts 0 attempts but
    enters the average as 0, exactly as the outer join does.
    """
    per_event = registrations.groupBy("event_id").agg(
        F.count("reg_id").alias("_n"),
        F.sum(F.when(F.col("registration_status") == "CANCELLED", 1).otherwise(0)).alias("_c"))
    j = sessions.select("event_id", "event_name").join(per_event, "event_id", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    g = j.groupBy(F.col("event_name").alias("name")).agg(
        F.sum(n).alias("total_attempts"),
        F.sum(F.coalesce(F.col("_c"), F.lit(0))).cast("bigint").alias("cancelled"),
        F.sum(F.greatest(n, F.lit(1))).alias("_rows"))
    return g.select("name", "total_attempts", "cancelled",
                    pct_half_up("cancelled", "_rows").alias("cancellation_rate"))


def registration_trend(users: DataFrame, registrations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Registrations per user *name* and their session names ordered by date (then name).

    Two levels, same string: per (name, date) the names of that date in order (a hot name
    is split across dates and tasks), then per name the per-date parts in date order, so
    the final buffer of a name holds one entry per date, not one per registration. The
    result is one string per name by definition, so its size still grows with the group.
    """
    r = registrations.select("reg_id", "user_id", "event_id")
    e = sessions.select("event_id", "event_name", "event_date")
    re_ = r.join(e, "event_id", "left")
    j = users.select("user_id", "full_name").join(re_, "user_id", "left")
    per_day = j.groupBy("full_name", "event_date").agg(
        F.count("reg_id").alias("_n"),
        F.expr("listagg(event_name, ', ') WITHIN GROUP (ORDER BY event_name)").alias("_part"))
    return per_day.groupBy(F.col("full_name").alias("name")).agg(
        F.sum("_n").alias("registrations"),
        F.expr("listagg(_part, ', ') WITHIN GROUP (ORDER BY event_date)").alias("events_registered"))


def event_conflict_pairs(sessions: DataFrame, bin_minutes: int = 60) -> DataFrame:
    """Pairs of sessions on the same date whose times overlap (half-open), id1 < id2."""
    from seatgrid.operators.overlap import overlap_pairs
    s = sessions.select("event_id", "event_name", "event_date", "start_time", "end_time")
    p = overlap_pairs(s, s, ["event_date"], ["event_date"], bin_minutes=bin_minutes,
                      extra=lambda a, b: a["l_event_id"] < b["r_event_id"])
    return p.select(
        F.col("l_event_id").alias("event1_id"), F.col("r_event_id").alias("event2_id"),
        F.col("l_event_name").alias("event1"), F.col("r_event_name").alias("event2"),
        F.col("l_event_date").alias("event_date"))


def user_dashboard_profile(users: DataFrame) -> DataFrame:
    return users.select("user_id", "full_name", "email", "created_date", "user_type")


def user_dashboard_registrations(registrations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each user's confirmed registrations with session details, ordered by date per user."""
    r = registrations.filter(F.col("registration_status") == "CONFIRMED")
    j = r.join(sessions, "event_id")
    out = j.select(
        F.col("reg_id").alias("registration_id"), "user_id", "event_name", "event_date",
        "start_time", "end_time", "registration_date", "payment_status",
        F.col("ticket_price").alias("price"), fill_pct().alias("fill_percentage"))
    # a global range sort: a user with many rows spans several tasks
    return out.orderBy("user_id", F.col("event_date").asc_nulls_last(), "registration_id")


def registrations_report(registrations: DataFrame, users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Completed registrations numbered by date (newest first, then id), with the total count."""
    r = registrations.filter(F.col("payment_status") == "COMPLETED")
    j = (r.join(users.select("user_id", "full_name"), "user_id")
         .join(sessions.select("event_id", "event_name"), "event_id"))
    base = j.select("reg_id", "full_name", "event_name", "registration_date", "amount_paid")
    pos = ordered_positions(base, [desc_first("registration_date"), F.col("reg_id").asc()])
    return pos.select(*base.columns, F.col("_pos").alias("row_num"), F.col("_total").alias("total_registrations"))


def daily_event_report(sessions: DataFrame, as_of: str | _dt.date, lookahead_days: int = 0) -> DataFrame:
    """Sessions dated as_of .. as_of + lookahead_days with fill % and the auto-cancel flag.

    The flag is "fill < 10 and date after as_of"; with lookahead 0 it never fires.
    """
    d0 = F.lit(str(as_of)).cast("date")
    s = sessions.filter((F.col("event_date") >= d0) & (F.col("event_date") <= F.date_add(d0, lookahead_days)))
    fp = fill_pct()
    return s.select(
        "event_id", "event_name", "event_date", "booked_seats", "total_seats", fp.alias("fill_percentage"),
        F.coalesce((fp < 10) & (F.col("event_date") > d0), F.lit(False)).alias("auto_cancel"))


def cart_totals(cart: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per user: cart rows and the total price of the items that join a session (the
    cursor loop that sums cart prices, as one aggregate)."""
    j = cart.select("user_id", "event_id").join(sessions.select("event_id", "ticket_price"), "event_id", "left")
    return j.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("cart_count"),
        F.count("ticket_price").alias("priced_items"),
        F.coalesce(F.sum("ticket_price"), F.lit(0).cast("decimal(20,2)")).alias("cart_total"))


def user_cart(cart: DataFrame, sessions: DataFrame) -> DataFrame:
    j = cart.join(sessions, "event_id")
    return j.select("cart_id", "user_id", *SESSION_COLS)


def user_registrations(registrations: DataFrame, sessions: DataFrame) -> DataFrame:
    r = registrations.filter(F.col("registration_status") == "CONFIRMED")
    j = r.join(sessions, "event_id")
    return j.select("user_id", *SESSION_COLS, "registration_date")


def user_details(lookups: DataFrame, users: DataFrame) -> DataFrame:
    """Point lookups as a batch: each lookup keeps its row, ``found`` says if the user exists."""
    j = lookups.select("request_id", "user_id").join(users.withColumn("_hit", F.lit(True)), "user_id", "left")
    return j.select("request_id", "user_id", F.coalesce(F.col("_hit"), F.lit(False)).alias("found"),
                    "full_name", "email", "user_type")

