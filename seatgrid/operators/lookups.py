"""The reference's scalar functions, evaluated for a whole table of arguments at once.

Each per-call lookup (one SELECT per argument) becomes a join of the argument table
with a pre-aggregated fact table, so the work is one shuffle per fact, not one query
per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatgrid.functions.rules import fill_pct
from seatgrid.operators.asof import running_at
from seatgrid.operators.overlap import overlap_pairs
from seatgrid.session import cut_lineage

INTERVAL = ["event_date", "start_time", "end_time"]


def session_facts(sessions: DataFrame) -> DataFrame:
    return sessions.select("event_id", "event_name", "event_date", "start_time", "end_time",
                           "total_seats", "booked_seats", "event_status")


def interval_summary(rows: DataFrame, sessions: DataFrame, order_col: str, with_first: bool = True,
                     only_for: DataFrame | None = None) -> DataFrame:
    """Per (user, date, start, end): how many rows and (optionally) the first one by
    ``order_col`` with its session name.

    This bounds the later overlap join by the distinct intervals of a user on a date,
    not by the user's row count, and it is a partial/final aggregate (hot-user safe).
    Without ``with_first`` it is a plain hash aggregate (count only). ``only_for`` (rows
    with user_id, event_date) keeps just the (user, date) pairs some probe asks about,
    before aggregating: a request batch is far smaller than the registrations table.
    """
    j = rows.select("user_id", "event_id", order_col).join(
        sessions.select("event_id", "event_name", *INTERVAL), "event_id")
    if only_for is not None:
        j = j.join(only_for.select("user_id", "event_date").filter(F.col("event_date").isNotNull()),
                   ["user_id", "event_date"], "left_semi")
    return interval_groups(j, order_col, with_first)


def interval_groups(j: DataFrame, order_col: str, with_first: bool = True) -> DataFrame:
    """:func:`interval_summary` of rows that have their sessions' columns."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if with_first:
        aggs.append(F.min(F.struct(order_col, "event_name")).alias("first"))
    else:
        aggs.append(F.lit(None).cast("struct<k:bigint,event_name:string>").alias("first"))
    return j.groupBy("user_id", *INTERVAL).agg(*aggs)


def near(probes: DataFrame, rows: DataFrame, *more: DataFrame) -> tuple[DataFrame, ...]:
    """The probes of a (user, date) that some of the rows are on, written, then the rows (of each frame) of those: what a search for overlaps
    needs. Few requests are on a date on which their user holds anything, so the others aren't taken through its bins."""
    on = ["user_id", "event_date"]
    days = reduce(DataFrame.unionByName, [r.select(*on) for r in (rows, *more)])
    asked = cut_lineage(probes.join(days, on, "left_semi"))
    return asked, *[r.join(asked.select(*on), on, "left_semi") for r in (rows, *more)]


def conflicts_of(probes: DataFrame, summary: DataFrame, probe_id: str) -> DataFrame:
    """For each probe (user_id, event_date, start_time, end_time) row that overlaps any: overlapping count and first row.

    Returns probe_id, conflict_count, first_conflict (struct)."""
    p = probes.select(probe_id, "user_id", *INTERVAL)
    pairs = overlap_pairs(p, summary, ["user_id", "event_date"], ["user_id", "event_date"])
    return pairs.groupBy(F.col("l_" + probe_id).alias(probe_id)).agg(
        F.sum("r_n").alias("conflict_count"), F.min("r_first").alias("first_conflict"))


def conflicts_with(probes: DataFrame, summary: DataFrame, probe_id: str) -> DataFrame:
    """:func:`conflicts_of` for every probe: conflict_count is 0 and first_conflict null where there is none."""
    out = probes.select(probe_id).join(conflicts_of(probes, summary, probe_id), probe_id, "left")
    return out.select(probe_id, F.coalesce(F.col("conflict_count"), F.lit(0)).alias("conflict_count"),
                      "first_conflict")


def confirmed(registrations: DataFrame) -> DataFrame:
    return registrations.filter(F.col("registration_status") == "CONFIRMED")


def time_conflict_count(requests: DataFrame, sessions: DataFrame, registrations: DataFrame) -> DataFrame:
    """Confirmed registrations of the requesting user that overlap the requested session."""
    s = session_facts(sessions)
    probes = requests.select("request_id", "user_id", "event_id").join(s.select("event_id", *INTERVAL), "event_id", "left")
    summ = interval_summary(confirmed(registrations), sessions, "reg_id", with_first=False, only_for=probes)
    c = conflicts_with(probes, summ, "request_id")
    return requests.select("request_id", "user_id", "event_id").join(c.drop("first_conflict"), "request_id")


def user_reg_count(users: DataFrame, registrations: DataFrame) -> DataFrame:
    """Registrations that are CONFIRMED and paid (COMPLETED), 0 for users without any."""
    r = registrations.filter((F.col("registration_status") == "CONFIRMED") & (F.col("payment_status") == "COMPLETED"))
    agg = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    return users.select("user_id").join(agg, "user_id", "left").select(
        "user_id", F.coalesce(F.col("_n"), F.lit(0)).alias("reg_count"))


def can_register(users: DataFrame, registrations: DataFrame, limit: int = 3) -> DataFrame:
    """True while the user has fewer than ``limit`` COMPLETED registrations."""
    r = registrations.filter(F.col("payment_status") == "COMPLETED")
    agg = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    return users.select("user_id").join(agg, "user_id", "left").select(
        "user_id", (F.coalesce(F.col("_n"), F.lit(0)) < limit).alias("can_register"))


def _lookup(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    s = sessions.select("event_id", "total_seats", "booked_seats").withColumn("_hit", F.lit(True))
    return requests.select("request_id", "event_id").join(s, "event_id", "left")


def fill_percentage(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """round(booked / total * 100, 2) of the requested session; NULL when it does not exist."""
    j = _lookup(requests, sessions)
    return j.select("request_id", "event_id", fill_pct().alias("fill_percentage"))


def fill_percentage_zero(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """As fill_percentage, but 0 when the session is missing or has no seats."""
    j = _lookup(requests, sessions)
    zero = F.col("total_seats").isNull() | (F.col("total_seats") == 0)
    return j.select("request_id", "event_id", F.when(zero, F.lit(0.0)).otherwise(fill_pct()).alias("fill_percentage"))


def seat_availability(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """booked < total; FALSE when the session is missing or the comparison is unknown."""
    j = _lookup(requests, sessions)
    return j.select("request_id", "event_id",
                    F.coalesce(F.col("booked_seats") < F.col("total_seats"), F.lit(False)).alias("seats_available"))


def seat_availability_null(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """booked < total; NULL when the session is missing (three-valued)."""
    j = _lookup(requests, sessions)
    return j.select("request_id", "event_id", (F.col("booked_seats") < F.col("total_seats")).alias("seats_available"))


def total_revenue(registrations: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """NVL(SUM(amount_paid), 0) over COMPLETED registrations, optionally BETWEEN two dates.

    With exactly one bound given, BETWEEN with a NULL bound is unknown for every row,
    so the total is 0 (the reference's defined behaviour).
    """
    r = registrations.filter(F.col("payment_status") == "COMPLETED")
    if date_from is not None or date_to is not None:
        lo = F.lit(date_from).cast("date")
        hi = F.lit(date_to).cast("date")
        r = r.filter(F.col("registration_date").between(lo, hi))
    return r.agg(F.coalesce(F.sum("amount_paid"), F.lit(0).cast("decimal(20,2)")).alias("total_revenue"))


def conflict_counts(requests: DataFrame, sessions: DataFrame, registrations: DataFrame) -> DataFrame:
    """:func:`time_conflict_count` by order statistics, with no pairs and no bins: the registrations of a user on a date that start
    before the request ends, minus those that end when it starts or earlier. Both are running counts over one order
    of all starts, ends and requests of the (user, date), numbered by range partitions, so a user or a date may be hot.

    The difference counts overlaps only where start < end on both sides (then who ends by the request's start has started before
    its end). Rows without, which text comparison can still satisfy, are compared one by one, as distinct intervals.
    """
    keys = ["user_id", "event_date"]
    s = session_facts(sessions).select("event_id", *INTERVAL)
    probes = requests.select(F.col("request_id").cast("string").alias("ask_id"), "user_id", "event_id").join(s, "event_id") \
        .filter(F.col("user_id").isNotNull() & F.col("event_date").isNotNull()).drop("event_id")
    asked = confirmed(registrations).select("user_id", "event_id").join(s, "event_id").join(probes.select(*keys), keys, "left_semi")
    held = asked.groupBy(*INTERVAL, "user_id").agg(F.count(F.lit(1)).alias("n"))
    fine = F.col("start_time") < F.col("end_time")  # null: compares with nothing
    good, odd = held.filter(fine), held.filter(~fine)
    ends = good.select(*keys, F.col("end_time").alias("at"), F.lit(0).alias("place"), F.lit(0).alias("started"), F.col("n").alias("ended"))
    starts = good.select(*keys, F.col("start_time").alias("at"), F.lit(2).alias("place"), F.col("n").alias("started"), F.lit(0).alias("ended"))
    sure = probes.filter(fine)
    from_to = sure.select(*keys, F.explode(F.array(
        F.struct(F.col("start_time").alias("at"), F.concat(F.lit("s"), "ask_id").alias("ask_id")),
        F.struct(F.col("end_time").alias("at"), F.concat(F.lit("e"), "ask_id").alias("ask_id")))).alias("a")) \
        .select(*keys, "a.at", F.lit(1).alias("place"), "a.ask_id")
    at = running_at(ends.unionByName(starts), from_to, keys, ["started", "ended"])
    part = F.when(F.col("ask_id").startswith("e"), F.col("before_started")).otherwise(-F.col("before_ended"))
    counted = at.select(F.expr("substring(ask_id, 2)").alias("ask_id"), part.alias("n"))
    meet = (F.col("p.start_time") < F.col("h.end_time")) & (F.col("h.start_time") < F.col("p.end_time"))
    same = (F.col("p.user_id") == F.col("h.user_id")) & (F.col("p.event_date") == F.col("h.event_date"))
    one_by_one = sure.alias("p").join(odd.alias("h"), same & meet).select("p.ask_id", "h.n") \
        .unionByName(probes.filter(~fine).alias("p").join(held.alias("h"), same & meet).select("p.ask_id", "h.n"))
    total = counted.unionByName(one_by_one).groupBy("ask_id").agg(F.sum("n").alias("n"))
    r = requests.select("request_id", "user_id", "event_id").withColumn("ask_id", F.col("request_id").cast("string"))
    return r.join(total, "ask_id", "left").select("request_id", "user_id", "event_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("conflict_count"))


def total_revenue_ranges(ranges: DataFrame, registrations: DataFrame) -> DataFrame:
    """:func:`total_revenue` for a table of ranges (range_id, date_from, date_to; both days included): the running revenue
    up to the end of date_to minus that before date_from, two places in one order of dates. A range with a null bound, or one that
    ends before it starts, is 0."""
    paid = registrations.filter((F.col("payment_status") == "COMPLETED") & F.col("registration_date").isNotNull())
    days = paid.groupBy(F.col("registration_date").alias("at")).agg(
        F.sum((F.col("amount_paid") * 100).cast("decimal(38,0)")).cast("bigint").alias("cents"))
    r = ranges.select("range_id", "date_from", "date_to").withColumn("ask_id", F.col("range_id").cast("string"))
    real = r.filter(F.col("date_from") <= F.col("date_to"))
    asks = real.select(F.explode(F.array(
        F.struct(F.col("date_from").alias("at"), F.lit(0).alias("place"), F.concat(F.lit("f"), "ask_id").alias("ask_id")),
        F.struct(F.col("date_to").alias("at"), F.lit(2).alias("place"), F.concat(F.lit("t"), "ask_id").alias("ask_id")))).alias("a")).select("a.*")
    at = running_at(days.select("at", F.lit(1).alias("place"), "cents"), asks, [], ["cents"])
    part = F.when(F.col("ask_id").startswith("t"), F.col("before_cents")).otherwise(-F.col("before_cents"))
    total = at.groupBy(F.expr("substring(ask_id, 2)").alias("ask_id")).agg(F.sum(part).alias("cents"))
    return r.join(total, "ask_id", "left").select(
        "range_id", "date_from", "date_to", (F.coalesce("cents", F.lit(0)).cast("decimal(20,0)") / 100).cast("decimal(20,2)").alias("total_revenue"))
