"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir), derives the domain tables from the driver's
parquet tables, and returns the report form of the result (``present``: decimals as
DOUBLE, dates as ISO text) so both engines hand back the same value types.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatgrid.functions.rules import present
from seatgrid.operators import reports as R
from seatgrid.plans.oracle_views import pct, with_views
from seatgrid.session import cut_lineage, scratch_path
from seatgrid.sources.domain import Domain

# Fixed parameters of the registered queries.
AS_OF = "2024-01-10"
LOOKAHEAD_DAYS = 7
REVENUE_FROM = "1996-01-01"
REVENUE_TO = "1997-12-31"

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
ON_DOMAIN: dict[str, Callable[[Domain], DataFrame]] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Domain(spark, sf_dir)))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        QUERIES[name] = build
        ON_DOMAIN[name] = lambda d: present(fn(d))
        if oracle is not None:
            ORACLE[name] = with_views(oracle)
        return fn
    return deco


SESSION_SQL = ("e.event_id, e.event_name, CAST(e.event_date AS VARCHAR) AS event_date, e.start_time, e.end_time, "
               "e.total_seats, e.booked_seats, CAST(e.ticket_price AS DOUBLE) AS ticket_price, e.event_status")

# ---------------------------------------------------------------- sources / reports


@register("sessions_list", f"SELECT {SESSION_SQL} FROM d_sessions e")
def _sessions_list(d: Domain):
    return R.sessions_list(d.sessions)


@register("user_details", """
, q AS (SELECT request_id, CASE request_id % 9 WHEN 0 THEN -user_id WHEN 1 THEN NULL ELSE user_id END AS user_id FROM d_removals)
SELECT q.request_id, q.user_id, u.user_id IS NOT NULL AS found, u.full_name, u.email, u.user_type
FROM q LEFT JOIN d_users u ON q.user_id = u.user_id""")
def _user_details(d: Domain):
    """Lookups by the ids of removal requests; some name nobody."""
    asked = d.removals.withColumn("user_id", F.when(F.col("request_id") % 9 == 0, -F.col("user_id")).when(F.col("request_id") % 9 != 1, F.col("user_id")))
    return R.user_details(asked, d.users)


# Sums per session and per user, taken before any join.
PAID_SQL = """, paid AS (SELECT event_id, CAST(sum(amount_paid) AS DOUBLE) AS paid, count(*) AS n
         FROM d_regs WHERE payment_status = 'COMPLETED' GROUP BY event_id)"""
USER_SUMS_SQL = """, sums AS (
  SELECT user_id, count(*) AS n, count(*) FILTER (WHERE payment_status = 'COMPLETED') AS n_paid,
         CAST(sum(amount_paid) AS DOUBLE) AS spent,
         CAST(sum(amount_paid) FILTER (WHERE payment_status = 'COMPLETED') AS DOUBLE) AS spent_paid
  FROM d_regs GROUP BY user_id)"""

@register("admin_dashboard", PAID_SQL + f"""
SELECT s.event_id, s.event_name, CAST(s.event_date AS VARCHAR) AS event_date, s.start_time, s.end_time, s.total_seats,
       s.booked_seats AS registered_seats, s.total_seats - s.booked_seats AS available_seats,
       {pct('s.booked_seats', 's.total_seats')} AS fill_percentage, coalesce(p.paid, 0.0) AS revenue
FROM d_sessions s LEFT JOIN paid p USING (event_id)""")
def _admin_dashboard(d: Domain):
    return R.admin_dashboard(d.sessions, d.registrations)


PCT_ZERO = f"CASE WHEN e.total_seats IS NULL OR e.total_seats = 0 THEN 0.0 ELSE {pct('e.booked_seats', 'e.total_seats')} END"


@register("admin_dashboard_counts", PAID_SQL + f"""
SELECT e.event_id, e.event_name, CAST(e.event_date AS VARCHAR) AS event_date, e.total_seats, e.booked_seats,
       e.total_seats - e.booked_seats AS available_seats, {PCT_ZERO} AS fill_percentage,
       coalesce(p.paid, 0.0) AS total_revenue, coalesce(p.n, 0) AS registrations_count
FROM d_sessions e LEFT JOIN paid p USING (event_id)""")
def _admin_dashboard_counts(d: Domain):
    return R.admin_dashboard_counts(d.sessions, d.registrations)


@register("event_stats", f"""
SELECT e.event_id, e.event_name, CAST(e.event_date AS VARCHAR) AS event_date, e.start_time, e.end_time, e.total_seats,
       e.booked_seats, e.total_seats - e.booked_seats AS available_seats, {PCT_ZERO} AS fill_percentage,
       CAST(e.ticket_price AS DOUBLE) AS ticket_price, e.event_status
FROM d_sessions e""")
def _event_stats(d: Domain):
    return R.event_stats(d.sessions)


@register("user_registration_summary", USER_SUMS_SQL + """
SELECT x.user_id, x.full_name AS user_name, x.email, coalesce(t.n, 0) AS total_registrations,
       coalesce(t.n_paid, 0) AS confirmed_registrations, coalesce(t.spent, 0.0) AS total_spent
FROM d_users x LEFT JOIN sums t USING (user_id)""")
def _user_registration_summary(d: Domain):
    return R.user_registration_summary(d.users, d.registrations)


@register("user_summary_completed", USER_SUMS_SQL + """
SELECT x.user_id, x.full_name, x.email, coalesce(t.n_paid, 0) AS total_registrations, coalesce(t.spent_paid, 0.0) AS total_spent
FROM d_users x LEFT JOIN sums t USING (user_id)""")
def _user_summary_completed(d: Domain):
    return R.user_summary_completed(d.users, d.registrations)


@register("event_popularity", """
, act AS (SELECT *, CAST(booked_seats AS DOUBLE) / CAST(total_seats AS DOUBLE) AS ratio FROM d_sessions WHERE event_status = 'ACTIVE'),
by_seats AS (SELECT b.booked_seats, 1 + coalesce(sum(a.n), 0) AS r
             FROM (SELECT DISTINCT booked_seats FROM act) b
             LEFT JOIN (SELECT booked_seats, count(*) AS n FROM act GROUP BY booked_seats) a ON a.booked_seats > b.booked_seats
             GROUP BY b.booked_seats),
ratios AS (SELECT ratio, row_number() OVER (ORDER BY ratio DESC) AS r FROM (SELECT DISTINCT ratio FROM act))
SELECT t.event_id AS id, t.event_name AS name, CAST(t.event_date AS VARCHAR) AS event_date, t.total_seats,
       t.booked_seats AS registered_seats, CAST(p.r AS BIGINT) AS popularity_rank, q.r AS fill_rate_rank
FROM act t JOIN by_seats p ON p.booked_seats = t.booked_seats JOIN ratios q ON q.ratio = t.ratio""")
def _event_popularity(d: Domain):
    return R.event_popularity(d.sessions)


@register("events_not_full", """
SELECT s.event_name, CAST(s.event_date AS VARCHAR) AS event_date, s.total_seats, s.booked_seats AS registered_seats,
       CAST(round(CAST(s.booked_seats AS DECIMAL(18,6)) * 100 / s.total_seats, 2) AS DOUBLE) AS fill_percentage
FROM d_sessions s WHERE s.total_seats > 0 AND s.booked_seats * 20000 + s.total_seats < 20000 * s.total_seats""")
def _events_not_full(d: Domain):
    return R.events_not_full(d.sessions, d.registrations)


@register("top_users", USER_SUMS_SQL + """
, best AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) AS place FROM sums WHERE user_id IN (SELECT user_id FROM d_users))
SELECT x.user_id, x.full_name AS user_name, x.email, t.n AS total_registrations, t.n_paid AS confirmed_registrations,
       coalesce(t.spent, 0.0) AS total_spent
FROM best b JOIN d_users x USING (user_id) JOIN sums t USING (user_id) WHERE b.place <= 5""")
def _top_users(d: Domain):
    return R.top_users(d.users, d.registrations)


@register("event_conflict_pairs", """
, days AS (SELECT event_date, list({'id': event_id, 'nm': event_name, 's': start_time, 'e': end_time}) AS l FROM d_sessions GROUP BY event_date),
one AS (SELECT event_date, l, unnest(l) AS a FROM days),
two AS (SELECT event_date, a, unnest(list_filter(l, lambda b: b.id > a.id AND NOT (b.s >= a.e OR a.s >= b.e))) AS b FROM one)
SELECT a.id AS event1_id, b.id AS event2_id, a.nm AS event1, b.nm AS event2, CAST(event_date AS VARCHAR) AS event_date FROM two""")
def _event_conflict_pairs(d: Domain):
    return R.event_conflict_pairs(d.sessions)


@register("users_with_pending_cart", """
, n AS (SELECT user_id, count(*) AS k FROM d_cart WHERE cart_id IS NOT NULL GROUP BY user_id)
SELECT x.full_name AS name, x.email, CAST(sum(n.k) AS BIGINT) AS cart_items
FROM n JOIN d_users x USING (user_id) GROUP BY ALL""")
def _users_with_pending_cart(d: Domain):
    return R.users_with_pending_cart(d.users, d.cart)


@register("revenue_by_month", """
, m AS (SELECT year(registration_date) * 100 + month(registration_date) AS ym, amount_paid FROM d_regs WHERE payment_status = 'COMPLETED')
SELECT CAST(ym // 100 AS VARCHAR) || '-' || right('0' || CAST(ym % 100 AS VARCHAR), 2) AS month, count(*) AS total_registrations,
       CAST(sum(amount_paid) AS DOUBLE) AS total_revenue
FROM m GROUP BY ym""")
def _revenue_by_month(d: Domain):
    return R.revenue_by_month(d.registrations)


@register("cancellation_rate", """
, k AS (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE registration_status = 'CANCELLED') AS c FROM d_regs GROUP BY event_id),
g AS (SELECT s.event_name AS name, CAST(sum(coalesce(k.n, 0)) AS BIGINT) AS total_attempts,
             CAST(sum(coalesce(k.c, 0)) AS BIGINT) AS cancelled, sum(greatest(coalesce(k.n, 0), 1)) AS shown
      FROM d_sessions s LEFT JOIN k USING (event_id) GROUP BY s.event_name)
SELECT name, total_attempts, cancelled, CAST(round(CAST(cancelled AS DECIMAL(18,6)) * 100 / shown, 2) AS DOUBLE) AS cancellation_rate FROM g""")
def _cancellation_rate(d: Domain):
    return R.cancellation_rate(d.sessions, d.registrations)


@register("registration_trend", """
, held AS (SELECT x.full_name AS name, list({'d': s.event_date, 'n': s.event_name}) AS l, count(*) AS k
          FROM d_regs r JOIN d_users x USING (user_id) JOIN d_sessions s USING (event_id) GROUP BY x.full_name)
SELECT n.name, coalesce(held.k, 0) AS registrations,
       array_to_string(list_transform(list_sort(held.l), lambda z: z.n), ', ') AS events_registered
FROM (SELECT DISTINCT full_name AS name FROM d_users) n LEFT JOIN held USING (name)""")
def _registration_trend(d: Domain):
    return R.registration_trend(d.users, d.registrations, d.sessions)


@register("user_dashboard_profile", """
SELECT x.user_id, x.full_name, x.email, CAST((SELECT min(o_orderdate) FROM orders WHERE o_custkey = x.user_id) AS DATE)::VARCHAR AS created_date,
       x.user_type
FROM d_users x""")
def _user_dashboard_profile(d: Domain):
    return R.user_dashboard_profile(d.profiles)


# The held sessions of each user as one list, unfolded again.
HELD_SQL = f""", shown AS (SELECT event_id, {{'n': event_name, 'd': event_date, 's': start_time, 'e': end_time, 'p': ticket_price,
                                     'f': {pct('booked_seats', 'total_seats')}}} AS e FROM d_sessions),
kept AS (SELECT user_id, list({{'r': reg_id, 'on': registration_date, 'pay': payment_status, 'k': event_id}}) AS l
         FROM d_regs WHERE registration_status IN ('CONFIRMED') GROUP BY user_id),
each AS (SELECT user_id, unnest(l) AS g FROM kept)"""


@register("user_dashboard_registrations", HELD_SQL + """
SELECT CAST(g.r AS VARCHAR) AS registration_id, user_id, e.n AS event_name, CAST(e.d AS VARCHAR) AS event_date, e.s AS start_time, e.e AS end_time,
       CAST(g."on" AS VARCHAR) AS registration_date, g.pay AS payment_status, CAST(e.p AS DOUBLE) AS price, e.f AS fill_percentage
FROM each JOIN shown ON shown.event_id = g.k""")
def _user_dashboard_registrations(d: Domain):
    return R.user_dashboard_registrations(d.registrations, d.sessions)


@register("registrations_report", """
, paid AS (SELECT reg_id, user_id, event_id, registration_date AS d, amount_paid FROM d_regs
           WHERE payment_status = 'COMPLETED' AND user_id IN (SELECT user_id FROM d_users) AND event_id IN (SELECT event_id FROM d_sessions)),
per_day AS (SELECT d, count(*) AS n FROM paid GROUP BY d),
ahead AS (SELECT a.d, coalesce(sum(b.n), 0) AS n FROM per_day a LEFT JOIN per_day b ON b.d > a.d OR (b.d IS NULL AND a.d IS NOT NULL) GROUP BY a.d)
SELECT CAST(p.reg_id AS VARCHAR) AS reg_id, (SELECT any_value(full_name) FROM d_users u WHERE u.user_id = p.user_id) AS full_name,
       (SELECT any_value(event_name) FROM d_sessions s WHERE s.event_id = p.event_id) AS event_name, CAST(p.d AS VARCHAR) AS registration_date,
       CAST(p.amount_paid AS DOUBLE) AS amount_paid, CAST(ahead.n + rank() OVER (PARTITION BY p.d ORDER BY p.reg_id) AS BIGINT) AS row_num,
       (SELECT CAST(sum(n) AS BIGINT) FROM per_day) AS total_registrations
FROM paid p JOIN ahead ON ahead.d IS NOT DISTINCT FROM p.d""")
def _registrations_report(d: Domain):
    return R.registrations_report(d.registrations, d.users, d.sessions)


@register("daily_event_report", f"""
SELECT e.event_id, e.event_name, CAST(e.event_date AS VARCHAR) AS event_date, e.booked_seats, e.total_seats,
       {pct('e.booked_seats', 'e.total_seats')} AS fill_percentage,
       coalesce({pct('e.booked_seats', 'e.total_seats')} < 10 AND e.event_date > DATE '{AS_OF}', false) AS auto_cancel
FROM d_sessions e
WHERE e.event_date >= DATE '{AS_OF}' AND e.event_date <= DATE '{AS_OF}' + {LOOKAHEAD_DAYS}""")
def _daily_event_report(d: Domain):
    return R.daily_event_report(d.sessions, AS_OF, LOOKAHEAD_DAYS)


@register("user_cart", f"""
, waiting AS (SELECT event_id, list({{'c': cart_id, 'u': user_id}}) AS l FROM d_cart GROUP BY event_id)
SELECT w.c AS cart_id, w.u AS user_id, {SESSION_SQL} FROM (SELECT event_id, unnest(l) AS w FROM waiting) x, d_sessions e WHERE e.event_id IN (x.event_id)""")
def _user_cart(d: Domain):
    return R.user_cart(d.cart, d.sessions)


@register("cart_totals", """
SELECT c.user_id, count(*) AS cart_count, count(e.ticket_price) AS priced_items,
       CAST(coalesce(sum(e.ticket_price), 0) AS DOUBLE) AS cart_total
FROM d_cart c LEFT JOIN d_sessions e ON c.event_id = e.event_id
GROUP BY c.user_id""")
def _cart_totals(d: Domain):
    return R.cart_totals(d.cart, d.sessions)


@register("user_registrations", f"""
, by_session AS (SELECT event_id, list({{'u': user_id, 'd': registration_date}}) FILTER (WHERE registration_status = 'CONFIRMED') AS l FROM d_regs GROUP BY event_id)
SELECT w.u AS user_id, {SESSION_SQL}, CAST(w.d AS VARCHAR) AS registration_date
FROM (SELECT event_id, unnest(l) AS w FROM by_session) x, d_sessions e WHERE e.event_id IN (x.event_id)""")
def _user_registrations(d: Domain):
    return R.user_registrations(d.registrations, d.sessions)

# ---------------------------------------------------------------- functions (per-argument lookups)

from seatgrid.operators import admission as A  # noqa: E402
from seatgrid.operators import lookups as L  # noqa: E402


@register("time_conflict_count", """
, pts AS (SELECT r.user_id, e.event_date, e.start_time AS s, e.end_time AS t, count(*) AS n
          FROM d_regs r JOIN d_sessions e USING (event_id) WHERE r.registration_status = 'CONFIRMED' GROUP BY ALL),
hit AS (SELECT q.request_id, sum(p.n) AS n FROM d_requests q JOIN d_sessions s USING (event_id)
        JOIN pts p ON p.user_id = q.user_id AND p.event_date = s.event_date WHERE least(p.t, s.end_time) > greatest(p.s, s.start_time) GROUP BY q.request_id)
SELECT q.request_id, q.user_id, q.event_id, CAST(coalesce(hit.n, 0) AS BIGINT) AS conflict_count FROM d_requests q LEFT JOIN hit USING (request_id)""")
def _time_conflict_count(d: Domain):
    return L.time_conflict_count(d.requests, d.sessions, d.registrations)


@register("user_reg_count", """
SELECT u.user_id, (SELECT count(*) FROM d_regs r WHERE r.user_id = u.user_id
                   AND r.registration_status = 'CONFIRMED' AND r.payment_status = 'COMPLETED') AS reg_count
FROM d_users u""")
def _user_reg_count(d: Domain):
    return L.user_reg_count(d.users, d.registrations)


@register("can_register", """
SELECT u.user_id, (SELECT count(*) FROM d_regs r WHERE r.user_id = u.user_id AND r.payment_status = 'COMPLETED') < 3
       AS can_register
FROM d_users u""")
def _can_register(d: Domain):
    return L.can_register(d.users, d.registrations)


@register("fill_percentage", f"""
SELECT q.request_id, q.event_id, {pct('s.booked_seats', 's.total_seats')} AS fill_percentage
FROM d_requests q LEFT JOIN d_sessions s ON q.event_id = s.event_id""")
def _fill_percentage(d: Domain):
    return L.fill_percentage(d.requests, d.sessions)


@register("fill_percentage_zero", f"""
SELECT q.request_id, q.event_id,
       CASE WHEN s.total_seats IS NULL OR s.total_seats = 0 THEN 0.0 ELSE {pct('s.booked_seats', 's.total_seats')} END
         AS fill_percentage
FROM d_requests q LEFT JOIN d_sessions s ON q.event_id = s.event_id""")
def _fill_percentage_zero(d: Domain):
    return L.fill_percentage_zero(d.requests, d.sessions)


@register("seat_availability", """
SELECT q.request_id, q.event_id, coalesce(s.booked_seats < s.total_seats, false) AS seats_available
FROM d_requests q LEFT JOIN d_sessions s ON q.event_id = s.event_id""")
def _seat_availability(d: Domain):
    return L.seat_availability(d.requests, d.sessions)


@register("seat_availability_null", """
SELECT q.request_id, q.event_id, s.booked_seats < s.total_seats AS seats_available
FROM d_requests q LEFT JOIN d_sessions s ON q.event_id = s.event_id""")
def _seat_availability_null(d: Domain):
    return L.seat_availability_null(d.requests, d.sessions)


@register("total_revenue", """
SELECT CAST(coalesce(sum(amount_paid), 0) AS DOUBLE) AS total_revenue FROM d_regs WHERE payment_status = 'COMPLETED'""")
def _total_revenue(d: Domain):
    return L.total_revenue(d.registrations)


@register("total_revenue_between", f"""
SELECT CAST(coalesce(sum(amount_paid), 0) AS DOUBLE) AS total_revenue FROM d_regs
WHERE payment_status = 'COMPLETED' AND registration_date BETWEEN DATE '{REVENUE_FROM}' AND DATE '{REVENUE_TO}'""")
def _total_revenue_between(d: Domain):
    return L.total_revenue(d.registrations, REVENUE_FROM, REVENUE_TO)


@register("conflict_counts", """
, held AS (SELECT r.user_id, e.event_date, list({'s': e.start_time, 'e': e.end_time}) AS l
           FROM d_regs r JOIN d_sessions e USING (event_id) WHERE r.registration_status = 'CONFIRMED' GROUP BY ALL)
SELECT q.request_id, q.user_id, q.event_id,
       CAST(coalesce(len(list_filter(h.l, lambda x: NOT (x.s >= s.end_time OR s.start_time >= x.e))), 0) AS BIGINT) AS conflict_count
FROM d_requests q LEFT JOIN d_sessions s ON s.event_id = q.event_id
LEFT JOIN held h ON h.user_id = q.user_id AND h.event_date = s.event_date""")
def _conflict_counts(d: Domain):
    return L.conflict_counts(d.requests, d.sessions, d.registrations)


@register("total_revenue_ranges", """
, q AS (SELECT o_orderkey AS range_id, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS a,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 10 AS INTEGER) AS b FROM orders),
t AS (SELECT registration_date AS d, sum(amount_paid) AS v FROM d_regs WHERE payment_status = 'COMPLETED' GROUP BY registration_date),
g AS (SELECT q.range_id, sum(t.v) AS v FROM q JOIN t ON t.d >= q.a AND t.d <= q.b GROUP BY q.range_id)
SELECT q.range_id, CAST(q.a AS VARCHAR) AS date_from, CAST(q.b AS VARCHAR) AS date_to, CAST(coalesce(g.v, 0) AS DOUBLE) AS total_revenue
FROM q LEFT JOIN g USING (range_id)""")
def _total_revenue_ranges(d: Domain):
    """The revenue of a range of days for every order: from its date on, some empty, some with no start."""
    o = d.raw("orders").select(F.col("o_orderkey").alias("range_id"), F.col("o_orderdate").cast("date").alias("day"))
    ranges = o.select("range_id", F.when(F.col("range_id") % 50 != 0, F.col("day")).alias("date_from"),
                      F.date_add("day", (F.col("range_id") % 400 - 10).cast("int")).alias("date_to"))
    return L.total_revenue_ranges(ranges, d.registrations)


# ---------------------------------------------------------------- cart admission

FACTS_SQL = """
, seen AS (SELECT event_id, event_date AS d, {'n': event_name, 's': start_time, 'e': end_time} AS v FROM d_sessions),
conf AS (SELECT user_id, d, list({'k': reg_id, 'v': v} ORDER BY reg_id) AS l
         FROM d_regs JOIN seen USING (event_id) WHERE registration_status = 'CONFIRMED' GROUP BY user_id, d),
cartx AS (SELECT user_id, d, list({'k': cart_id, 'v': v} ORDER BY cart_id) AS l FROM d_cart JOIN seen USING (event_id) GROUP BY user_id, d),
held AS (SELECT user_id, count(*) FILTER (WHERE event_id IN (SELECT event_id FROM seen)) AS known,
                count(*) FILTER (WHERE payment_status = 'COMPLETED') AS paid
         FROM d_regs WHERE registration_status = 'CONFIRMED' GROUP BY user_id),
met AS (SELECT q.request_id, q.user_id, q.event_id, s.event_id IS NOT NULL AS found, s.event_status, s.total_seats, s.booked_seats,
               list_filter(c.l, lambda x: NOT (x.v.s >= s.end_time OR s.start_time >= x.v.e)) AS rs,
               list_filter(k.l, lambda x: NOT (x.v.s >= s.end_time OR s.start_time >= x.v.e)) AS cs
        FROM d_requests q LEFT JOIN d_sessions s ON q.event_id = s.event_id
        LEFT JOIN conf c ON c.user_id = q.user_id AND c.d = s.event_date LEFT JOIN cartx k ON k.user_id = q.user_id AND k.d = s.event_date),
f AS (SELECT m.request_id, m.user_id, m.event_id, m.found, m.event_status, m.total_seats, m.booked_seats,
             (m.user_id, m.event_id) IN (SELECT (user_id, event_id) FROM d_cart WHERE event_id IS NOT NULL) AS in_cart,
             (m.user_id, m.event_id) IN (SELECT (user_id, event_id) FROM d_regs) AS registered,
             coalesce(h.known, 0) AS confirmed_count, coalesce(h.paid, 0) AS paid_confirmed_count,
             coalesce(len(m.rs), 0) AS conflict_count, m.rs[1].v.n AS conflict_name,
             coalesce(len(m.cs), 0) AS cart_conflict_count, m.cs[1].v.n AS cart_conflict_name
      FROM met m LEFT JOIN held h USING (user_id))
"""


def _chain_sql(chain: list[tuple[str, str, str]], ok: str) -> str:
    st = " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in chain)
    ms = " ".join(f"WHEN {c} THEN {m}" for c, _, m in chain)
    return (FACTS_SQL + f"SELECT request_id, user_id, event_id, CASE {st} ELSE 'SUCCESS' END AS status, "
            f"CASE {ms} ELSE '{ok}' END AS message FROM f")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SEAT = "NOT coalesce(booked_seats < total_seats, false)"

STRICT_CHAIN = [
    ("NOT found", "FAILED", _q("Event not found")), ("event_status <> 'ACTIVE'", "FAILED", _q("Event is not active")),
    ("in_cart", "FAILED", _q("Event already in cart")), ("registered", "FAILED", _q("Already registered for this event")),
    ("conflict_count > 0", "FAILED", _q("Time conflict with existing registration")), ("paid_confirmed_count >= 3", "FAILED", _q("Maximum 3 registrations allowed")),
    (_SEAT, "FAILED", _q("No seats available"))]


RAW_ADMISSION: dict[str, str] = {}


def _facts(d: Domain, with_names: bool = False):
    return A.admission_facts(d.requests, d.sessions, d.registrations, d.cart, with_names)


RAW_ADMISSION["strict"] = _chain_sql(STRICT_CHAIN, "Added to cart successfully")


@register("cart_admission_strict", RAW_ADMISSION["strict"])
def _cart_admission_strict(d: Domain):
    return A.strict(_facts(d))


RAW_ADMISSION["package"] = _chain_sql([c for c in STRICT_CHAIN if c[0] != "registered"], "Added to cart successfully")


@register("cart_admission_package", RAW_ADMISSION["package"])
def _cart_admission_package(d: Domain):
    return A.package(_facts(d))


RAW_ADMISSION["basic"] = _chain_sql([
    ("in_cart", "FAILED", _q("Event already in cart")), ("registered", "FAILED", _q("Already registered for this event")),
    ("NOT (booked_seats < total_seats)", "FAILED", _q("No seats available")), ("NOT found", "ERROR", _q("insert or update on table cart violates foreign key constraint (event not found)"))],
    "Added to cart successfully")


@register("cart_admission_basic", RAW_ADMISSION["basic"])
def _cart_admission_basic(d: Domain):
    return A.basic(_facts(d))


_HALF = ("coalesce(coalesce(booked_seats, 0) * 2 >= total_seats "
         "AND NOT (total_seats = 0 AND coalesce(booked_seats, 0) = 0), false)")


RAW_ADMISSION["half_full"] = _chain_sql([
    ("NOT found", "FAILED", _q("Event not found")), (f"confirmed_count >= 3 AND {_HALF}", "FAILED", _q("You already have 3 confirmed registrations and this event is more than 50% full")),
    ("conflict_count > 0", "FAILED", f"{_q("Time conflict with event: ")} || conflict_name"),
    ("cart_conflict_count > 0", "FAILED", f"{_q("Time conflict with event in cart: ")} || cart_conflict_name"),
    ("in_cart", "FAILED", _q("Event already in cart")), ("registered", "FAILED", _q("Already registered for this event"))], "Event added to cart successfully")


@register("cart_admission_half_full", RAW_ADMISSION["half_full"])
def _cart_admission_half_full(d: Domain):
    return A.half_full(_facts(d, with_names=True))

def _in_shop(sql: str) -> str:
    """The same oracle over the shop's tables."""
    for a, b in (("d_requests", "shop_requests"), ("d_sessions", "shop_sessions"), ("d_regs", "shop_regs"), ("d_cart", "shop_cart")):
        sql = sql.replace(a, b)
    return sql


# The shop's users hold few registrations, its rooms are small, and some requests name no session: every branch has rows.
for _rule in ("strict", "package", "basic", "half_full"):
    def _shop_admission(d: Domain, rule=_rule):
        facts = A.admission_facts(d.shop_requests, d.shop_sessions, d.shop_registrations, d.shop_cart, with_names=rule == "half_full")
        return getattr(A, rule)(facts)
    _shop_admission.__doc__ = f"Cart admission, {_rule} rules, over the shop's requests."
    register(f"cart_admission_shop_{_rule}")(_shop_admission)
    ORACLE[f"cart_admission_shop_{_rule}"] = with_views(_in_shop(RAW_ADMISSION[_rule]))

# ---------------------------------------------------------------- data quality

from seatgrid.operators import changes as C  # noqa: E402
from seatgrid.operators import quality as Q  # noqa: E402


def _row_rules_sql(table: str, view: str, rules: list[tuple[str, str]]) -> list[str]:
    return [f"SELECT '{table}' AS table_name, '{n}' AS constraint_name, count(*) FILTER (WHERE {p}) AS violations "
            f"FROM {view}" for n, p in rules]


def _unique_sql(table: str, view: str, name: str, keys: list[str]) -> str:
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    ks = ", ".join(keys)
    return (f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations "
            f"FROM (SELECT count(*) AS n FROM {view} WHERE {nn} GROUP BY {ks} HAVING count(*) > 1) t")


def _fk_sql(table: str, view: str, name: str, key: str, parent: str, pkey: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, count(*) AS violations FROM {view} c "
            f"WHERE c.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pkey} = c.{key})")


def _nn(c: str) -> str:
    return f"{c} IS NULL"


def _ck(p: str) -> str:
    return f"coalesce(NOT ({p}), false)"


def _len(c: str, n: int) -> str:
    return f"coalesce(length({c}) > {n}, false)"


_TIME = "regexp_full_match({c}, '[0-9]{{2}}:[0-9]{{2}}')"

CONSTRAINT_SQL = " UNION ALL ".join(
    _row_rules_sql("users", "d_users", [
        ("pk_not_null", _nn("user_id")), ("name_not_null", _nn("full_name")), ("email_not_null", _nn("email")),
        ("user_type_check", _ck("user_type IN ('USER', 'ADMIN')")), ("name_length", _len("full_name", 100)),
        ("email_length", _len("email", 100))])
    + [_unique_sql("users", "d_users", "pk_unique", ["user_id"]), _unique_sql("users", "d_users", "email_unique", ["email"])]
    + _row_rules_sql("sessions", "d_sessions", [
        ("pk_not_null", _nn("event_id")), ("name_not_null", _nn("event_name")), ("date_not_null", _nn("event_date")),
        ("start_not_null", _nn("start_time")), ("end_not_null", _nn("end_time")), ("seats_not_null", _nn("total_seats")),
        ("price_not_null", _nn("ticket_price")), ("seats_positive", _ck("total_seats > 0")),
        ("booked_within_seats", _ck("booked_seats <= total_seats")), ("price_non_negative", _ck("ticket_price >= 0")),
        ("status_check", _ck("event_status IN ('ACTIVE', 'CANCELLED', 'COMPLETED')")),
        ("name_length", _len("event_name", 200)), ("start_length", _len("start_time", 10)),
        ("end_length", _len("end_time", 10)), ("start_format", _ck(_TIME.format(c="start_time"))),
        ("end_format", _ck(_TIME.format(c="end_time")))])
    + [_unique_sql("sessions", "d_sessions", "pk_unique", ["event_id"])]
    + _row_rules_sql("registrations", "d_regs", [
        ("pk_not_null", _nn("reg_id")), ("user_not_null", _nn("user_id")), ("event_not_null", _nn("event_id")),
        ("payment_status_check", _ck("payment_status IN ('PENDING', 'COMPLETED', 'FAILED', 'REFUNDED')")),
        ("registration_status_check", _ck("registration_status IN ('CONFIRMED', 'CANCELLED', 'WAITLIST')"))])
    + [_unique_sql("registrations", "d_regs", "pk_unique", ["reg_id"]),
       _unique_sql("registrations", "d_regs", "user_event_unique", ["user_id", "event_id"]),
       _fk_sql("registrations", "d_regs", "fk_user", "user_id", "d_users", "user_id"),
       _fk_sql("registrations", "d_regs", "fk_event", "event_id", "d_sessions", "event_id")]
    + _row_rules_sql("cart", "d_cart", [
        ("pk_not_null", _nn("cart_id")), ("user_not_null", _nn("user_id")), ("event_not_null", _nn("event_id"))])
    + [_unique_sql("cart", "d_cart", "pk_unique", ["cart_id"]),
       _unique_sql("cart", "d_cart", "user_event_unique", ["user_id", "event_id"]),
       _fk_sql("cart", "d_cart", "fk_user", "user_id", "d_users", "user_id"),
       _fk_sql("cart", "d_cart", "fk_event", "event_id", "d_sessions", "event_id")])


@register("constraint_violations", CONSTRAINT_SQL)
def _constraint_violations(d: Domain):
    return Q.constraint_violations(d.users, d.sessions, d.registrations, d.cart)


# Tables with rows that break every rule, for the same checks.
DIRTY_SQL = """
, x_users AS (SELECT CASE WHEN user_id % 50 = 7 THEN NULL WHEN user_id % 50 = 12 THEN user_id - 1 ELSE user_id END AS user_id,
         CASE user_id % 50 WHEN 8 THEN NULL WHEN 11 THEN repeat('x', 101) ELSE full_name END AS full_name,
         CASE user_id % 50 WHEN 9 THEN 'same@example.com' WHEN 13 THEN NULL WHEN 14 THEN repeat('y', 101) || user_id ELSE email END AS email,
         CASE WHEN user_id % 50 = 10 THEN 'GUEST' ELSE user_type END AS user_type FROM d_users),
x_sessions AS (SELECT CASE event_id % 40 WHEN 15 THEN NULL WHEN 29 THEN event_id - 1 ELSE event_id END AS event_id,
         CASE event_id % 40 WHEN 17 THEN NULL WHEN 18 THEN repeat('z', 201) ELSE event_name END AS event_name,
         CASE WHEN event_id % 40 = 19 THEN NULL ELSE event_date END AS event_date,
         CASE event_id % 40 WHEN 5 THEN '9:00' WHEN 20 THEN NULL WHEN 21 THEN '09:00:00 in the morning' ELSE start_time END AS start_time,
         CASE event_id % 40 WHEN 22 THEN 'noon' WHEN 23 THEN NULL WHEN 24 THEN 'at the end of the day' ELSE end_time END AS end_time,
         CASE event_id % 40 WHEN 1 THEN 0 WHEN 25 THEN NULL ELSE total_seats END AS total_seats,
         CASE event_id % 40 WHEN 2 THEN total_seats + 1 WHEN 26 THEN NULL ELSE booked_seats END AS booked_seats,
         CASE event_id % 40 WHEN 3 THEN -1 WHEN 27 THEN NULL ELSE ticket_price END AS ticket_price,
         CASE event_id % 40 WHEN 4 THEN 'DRAFT' WHEN 6 THEN NULL ELSE event_status END AS event_status FROM d_sessions),
x_regs AS (SELECT CASE (user_id + event_id) % 30 WHEN 6 THEN NULL WHEN 7 THEN 1 ELSE reg_id END AS reg_id,
         CASE (user_id + event_id) % 30 WHEN 4 THEN NULL WHEN 5 THEN -5 ELSE user_id END AS user_id,
         CASE (user_id + event_id) % 30 WHEN 1 THEN NULL WHEN 2 THEN -event_id - 1 WHEN 3 THEN 0 ELSE event_id END AS event_id,
         CASE (user_id + event_id) % 30 WHEN 0 THEN 'UNKNOWN' ELSE payment_status END AS payment_status,
         CASE (user_id + event_id) % 30 WHEN 8 THEN 'LOST' ELSE registration_status END AS registration_status FROM d_regs),
x_cart AS (SELECT CASE cart_id % 20 WHEN 3 THEN NULL WHEN 4 THEN 0 ELSE cart_id END AS cart_id,
         CASE cart_id % 20 WHEN 1 THEN NULL WHEN 5 THEN -9 ELSE user_id END AS user_id,
         CASE cart_id % 20 WHEN 0 THEN NULL WHEN 2 THEN -event_id - 1 WHEN 6 THEN 0 ELSE event_id END AS event_id FROM d_cart)
"""


def _dirty(df, by: str, m: int, broken: dict[str, dict[int, object]]):
    """df with ``broken[column][k]`` (a value or an SQL text) in the rows where ``by`` modulo m is k."""
    from pyspark.sql import functions as F
    key = F.expr(f"({by}) % {m}")
    def column(f):
        out = F.col(f.name)
        for k, text in broken.get(f.name, {}).items():
            out = F.when(key == k, F.expr(text).cast(f.dataType)).otherwise(out)
        return out.alias(f.name)
    return df.select(*[column(f) for f in df.schema.fields])


def _broken_tables(d: Domain) -> dict:
    """The tables with rows that break each rule."""
    users = _dirty(d.users, "user_id", 50, {
        "user_id": {7: "NULL", 12: "user_id - 1"}, "full_name": {8: "NULL", 11: "repeat('x', 101)"}, "user_type": {10: "'GUEST'"},
        "email": {9: "'same@example.com'", 13: "NULL", 14: "repeat('y', 101) || user_id"}})
    sessions = _dirty(d.sessions, "event_id", 40, {
        "event_id": {15: "NULL", 29: "event_id - 1"}, "event_name": {17: "NULL", 18: "repeat('z', 201)"}, "event_date": {19: "NULL"},
        "start_time": {5: "'9:00'", 20: "NULL", 21: "'09:00:00 in the morning'"},
        "end_time": {22: "'noon'", 23: "NULL", 24: "'at the end of the day'"}, "total_seats": {1: "0", 25: "NULL"},
        "booked_seats": {2: "total_seats + 1", 26: "NULL"}, "ticket_price": {3: "-1", 27: "NULL"}, "event_status": {4: "'DRAFT'", 6: "NULL"}})
    regs = _dirty(d.registrations, "user_id + event_id", 30, {
        "reg_id": {6: "NULL", 7: "1"}, "user_id": {4: "NULL", 5: "-5"}, "event_id": {1: "NULL", 2: "-event_id - 1", 3: "0"},
        "payment_status": {0: "'UNKNOWN'"}, "registration_status": {8: "'LOST'"}})
    cart = _dirty(d.cart, "cart_id", 20, {
        "cart_id": {3: "NULL", 4: "0"}, "user_id": {1: "NULL", 5: "-9"}, "event_id": {0: "NULL", 2: "-event_id - 1", 6: "0"}})
    return {"users": users, "sessions": sessions, "registrations": regs, "cart": cart}


@register("constraint_violations_broken", DIRTY_SQL + CONSTRAINT_SQL.replace("FROM d_", "FROM x_"))
def _constraint_violations_broken(d: Domain):
    """The same checks over the same tables with rows that break each rule."""
    return Q.constraint_violations(**_broken_tables(d))


def _quarantine_sql() -> str:
    """Row and FOREIGN KEY rules of every broken table, each rule a text that is there or null."""
    out = []
    for table, view, key, more in (("users", "x_users", "user_id", []), ("sessions", "x_sessions", "event_id", []), *[
            (t, v, k, [("fk_user", "user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM x_users WHERE user_id IS NOT NULL)"),
                       ("fk_event", "event_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM x_sessions WHERE event_id IS NOT NULL)")])
            for t, v, k in (("registrations", "x_regs", "reg_id"), ("cart", "x_cart", "cart_id"))]):
        rules = [re.match(r"SELECT '\w+' AS table_name, '(\w+)' AS constraint_name, count\(\*\) FILTER \(WHERE (.*)\) AS violations FROM", part).groups()
                 for part in CONSTRAINT_SQL.split(" UNION ALL ") if part.startswith(f"SELECT '{table}'") and "FILTER" in part]
        cases = ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in [*rules, *more])
        out.append(f"SELECT '{table}' AS table_name, CAST({key} AS VARCHAR) AS row_key, concat_ws(',', {cases}) AS broken FROM {view}")
    return DIRTY_SQL + "SELECT * FROM (" + " UNION ALL ".join(out) + ") z WHERE broken <> ''"


@register("constraint_quarantine", _quarantine_sql())
def _constraint_quarantine(d: Domain):
    """The rows that break a row or FOREIGN KEY rule, with the rules each breaks."""
    return Q.quarantine(_broken_tables(d))


@register("key_bitmap_violations", DIRTY_SQL + " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, 'pk_unique' AS constraint_name, count({k}) - count(DISTINCT {k}) AS violations FROM x_{t}"
     for t, k in (("users", "user_id"), ("sessions", "event_id"), ("cart", "cart_id"))]
    + [f"SELECT '{t}', 'fk_{n}', count(DISTINCT c.{k}) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{k} = c.{k})) FROM {v} c"
       for t, v in (("registrations", "x_regs"), ("cart", "x_cart")) for n, k, p in (("user", "user_id", "x_users"), ("event", "event_id", "x_sessions"))]))
def _key_bitmap_violations(d: Domain):
    """Key rules over bitmaps (registration ids are pairs of numbers, too wide for a bitmap)."""
    return Q.bitmap_violations(_broken_tables(d))


@register("overbooking_violations", """
SELECT event_id, total_seats, raw_booked AS booked_seats, raw_booked - total_seats AS excess
FROM d_sessions WHERE raw_booked > total_seats""")
def _overbooking_violations(d: Domain):
    return Q.overbooking_violations(d.sessions)


# ---------------------------------------------------------------- bulk state changes


INGEST_USERS_SQL = """
, s AS (SELECT q.*, EXISTS (SELECT 1 FROM d_users u WHERE u.email = q.email) AS taken,
               NOT (q.full_name IS NULL OR q.full_name = '' OR q.email IS NULL OR q.email = '') AS valid
        FROM d_user_signups q),
w AS (SELECT s.*, coalesce(valid AND NOT taken
        AND request_id = min(CASE WHEN valid AND NOT taken THEN request_id END) OVER (PARTITION BY email), false) AS win
      FROM s)
SELECT request_id, full_name, email, CASE WHEN win THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       CASE WHEN NOT valid THEN 'Name and email are required' WHEN NOT win THEN 'Email already registered'
            ELSE 'User registered successfully' END AS message,
       CASE WHEN win THEN (SELECT max(user_id) FROM d_users) + row_number() OVER (PARTITION BY win ORDER BY request_id)
       END AS user_id
FROM w"""


@register("ingest_users", INGEST_USERS_SQL)
def _ingest_users(d: Domain):
    return C.ingest_users(d.users, d.user_signups)


@register("ingest_users_app", INGEST_USERS_SQL.replace("Email already registered", "Email already exists"))
def _ingest_users_app(d: Domain):
    """The application's wording of the duplicate email."""
    return C.ingest_users(d.users, d.user_signups, C.MSG_EMAIL_EXISTS)


@register("ingest_sessions", """
, old AS (SELECT * FROM d_base WHERE event_status <> 'ACTIVE')
SELECT b.event_id, b.event_name, CAST(b.event_date AS VARCHAR) AS event_date, b.start_time,
       CASE WHEN b.event_name IS NULL OR b.event_date IS NULL OR b.start_time IS NULL THEN 'INSERTED'
            WHEN EXISTS (SELECT 1 FROM old o WHERE o.event_name = b.event_name AND o.event_date = b.event_date
                           AND o.start_time = b.start_time) THEN 'IGNORED'
            WHEN EXISTS (SELECT 1 FROM d_base x WHERE x.event_name = b.event_name AND x.event_date = b.event_date
                           AND x.start_time = b.start_time AND x.event_id < b.event_id) THEN 'IGNORED'
            ELSE 'INSERTED' END AS status
FROM d_base b""")
def _ingest_sessions(d: Domain):
    """All sessions arrive again; those that aren't active are there already."""
    from pyspark.sql import functions as F
    return C.ingest_sessions(d.base_sessions, d.base_sessions.filter(F.col("event_status") != "ACTIVE"))


@register("cart_remove", """
SELECT c.cart_id, c.user_id, c.event_id, CAST(c.added_date AS VARCHAR) AS added_date FROM d_cart c
WHERE c.cart_id NOT IN (SELECT r.cart_id FROM d_removals r WHERE r.cart_id IS NOT NULL)""")
def _cart_remove(d: Domain):
    return C.cart_remove(d.cart, d.removals)


CANCEL_SQL = f"""
, cx AS (
  SELECT q.request_id, q.reg_id, q.user_id,
         coalesce(r.payment_status = 'COMPLETED', false)
           AND row_number() OVER (PARTITION BY q.reg_id ORDER BY q.ts, q.request_id) = 1 AS ok
  FROM d_cancellations q LEFT JOIN d_regs r ON q.reg_id = r.reg_id)
"""


def _named(d: Domain) -> DataFrame:
    """The paid registrations that cancellations name, written: the only ones that these can change."""
    named = d.registrations.filter(F.col("payment_status") == "COMPLETED") \
        .select("reg_id", "user_id", "event_id", "registration_status", F.lit("COMPLETED").alias("payment_status"))
    return cut_lineage(named.join(d.cancellations.select("reg_id"), "reg_id", "left_semi"))


@register("cancel_registrations", CANCEL_SQL + f"""
SELECT request_id, CAST(reg_id AS VARCHAR) AS reg_id, user_id, CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       CASE WHEN ok THEN '{C.MSG_CANCEL_OK}' ELSE '{C.MSG_CANCEL_MISSING}' END AS message
FROM cx""")
def _cancel_registrations(d: Domain):
    return C.cancel_registrations(d.registrations, d.cancellations)


@register("cancel_seat_delta", CANCEL_SQL + """
SELECT r.event_id, count(*) AS released, s.booked_seats AS booked_before, s.booked_seats - count(*) AS booked_after
FROM cx JOIN d_regs r ON cx.reg_id = r.reg_id JOIN d_sessions s ON r.event_id = s.event_id
WHERE cx.ok GROUP BY r.event_id, s.booked_seats""")
def _cancel_seat_delta(d: Domain):
    dec = C.cancel_registrations(d.registrations, d.cancellations)
    return C.cancel_seat_delta(d.sessions, d.registrations, dec)


@register("audit_updates", CANCEL_SQL + f"""
SELECT row_number() OVER (ORDER BY r.reg_id) AS audit_id, r.user_id, r.event_id, 'UPDATE' AS action,
       '{AS_OF}' AS action_date, r.registration_status AS old_status, 'CANCELLED' AS new_status
FROM d_regs r WHERE r.reg_id IN (SELECT reg_id FROM cx WHERE ok)""")
def _audit_updates(d: Domain):
    dec = C.cancel_registrations(d.registrations, d.cancellations)
    after = C.apply_cancellations(d.registrations, dec)
    return C.audit_updates(d.registrations, after, dec.filter("status = 'SUCCESS'"), AS_OF)


@register("registration_state_as_of", CANCEL_SQL + f"""
, gone AS (SELECT q.reg_id, CAST(min(q.ts) AS DATE) AS day FROM d_cancellations q JOIN cx USING (request_id) WHERE cx.ok GROUP BY q.reg_id),
days AS (SELECT reg_id, registration_date AS came, unnest([registration_date - 1, registration_date, DATE '{AS_OF}', DATE '2100-01-01']) AS d FROM d_regs)
SELECT CAST(y.reg_id AS VARCHAR) AS reg_id, CAST(CAST(y.d AS DATE) AS VARCHAR) AS as_of,
       CASE WHEN g.day <= y.d THEN 'CANCELLED' WHEN y.came <= y.d THEN r.registration_status END AS registration_status
FROM days y JOIN d_regs r USING (reg_id) LEFT JOIN gone g USING (reg_id)""")
def _registration_state_as_of(d: Domain):
    """The status of every registration before it came, on that day, on a fixed day, and at the end of the log."""
    done = C.cancel_registrations(_named(d), d.cancellations).filter("status = 'SUCCESS'").select("request_id", "reg_id") \
        .join(d.cancellations.select("request_id", "ts"), "request_id")
    log = d.registrations.select("reg_id", F.col("registration_date").alias("at"), F.lit(0).alias("seq"), F.col("registration_status").alias("status")) \
        .unionByName(done.select("reg_id", F.col("ts").cast("date").alias("at"), (F.col("request_id") + 1).alias("seq"), F.lit("CANCELLED").alias("status")))
    came = F.col("registration_date")
    asks = d.registrations.select("reg_id", F.explode(F.array(
        F.date_sub(came, 1), came, F.lit(AS_OF).cast("date"), F.lit("2100-01-01").cast("date"))).alias("as_of"))
    return C.state_as_of(log, asks)


@register("audit_inserts", f"""
SELECT row_number() OVER (ORDER BY reg_id) AS audit_id, user_id, event_id, 'INSERT' AS action,
       '{AS_OF}' AS action_date, CAST(NULL AS VARCHAR) AS old_status, payment_status AS new_status
FROM d_regs""")
def _audit_inserts(d: Domain):
    return C.audit_inserts(d.registrations, AS_OF)


@register("seat_counts", """
SELECT s.event_id, s.total_seats,
       (SELECT count(*) FROM d_regs r WHERE r.event_id = s.event_id AND r.payment_status = 'COMPLETED') AS booked_seats
FROM d_base s""")
def _seat_counts(d: Domain):
    return C.seat_counts(d.base_sessions, d.registrations)


@register("waitlist_assign", """
, b AS (SELECT *, coalesce(sum(CASE WHEN payment_status = 'COMPLETED' AND registration_status <> 'WAITLIST' THEN 1 ELSE 0 END) OVER (
          PARTITION BY event_id ORDER BY registration_date NULLS FIRST, reg_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_paid
        FROM d_regs)
SELECT CAST(b.reg_id AS VARCHAR) AS reg_id, b.user_id, b.event_id,
       CASE WHEN coalesce(b.before_paid >= s.total_seats, false) THEN 'WAITLIST' ELSE b.registration_status END
         AS registration_status,
       b.payment_status = 'COMPLETED' AND b.registration_status <> 'WAITLIST'
         AND NOT coalesce(b.before_paid >= s.total_seats, false) AS takes_seat
FROM b LEFT JOIN d_base s ON b.event_id = s.event_id""")
def _waitlist_assign(d: Domain):
    return C.waitlist_assign(d.base_sessions, d.registrations)


DEDUPE_SQL = """
, dd AS (
  SELECT q.request_id, q.user_id, q.event_id, q.ts,
         NOT EXISTS (SELECT 1 FROM d_cart c WHERE c.user_id = q.user_id AND c.event_id = q.event_id)
           AND row_number() OVER (PARTITION BY q.user_id, q.event_id ORDER BY q.ts, q.request_id) = 1 AS ok
  FROM d_requests q)
"""


@register("cart_dedupe", DEDUPE_SQL + """
SELECT request_id, user_id, event_id, ts, CASE WHEN ok THEN 'ACCEPTED' ELSE 'REJECTED' END AS status,
       CASE WHEN ok THEN NULL ELSE 'Event already in cart' END AS message
FROM dd""")
def _cart_dedupe(d: Domain):
    return C.cart_dedupe(d.cart, d.requests)


@register("assign_ids", DEDUPE_SQL + """
SELECT request_id, (SELECT max(cart_id) FROM d_cart) + row_number() OVER (ORDER BY ts, request_id) AS cart_id
FROM dd WHERE ok""")
def _assign_ids(d: Domain):
    from pyspark.sql import functions as F
    acc = C.cart_dedupe(d.cart, d.requests).filter(F.col("status") == "ACCEPTED").select("request_id", "ts")
    ids = C.assign_ids(acc, [F.col("ts").asc(), F.col("request_id").asc()], C.current_max(d.cart, "cart_id"), "cart_id")
    return ids.select("request_id", "cart_id")


@register("apply_defaults", f"""
SELECT checkout_id AS reg_id, user_id, event_id, '{AS_OF}' AS registration_date,
       CASE WHEN payment_ok THEN 'COMPLETED' END AS payment_status, 'CONFIRMED' AS registration_status,
       payment_method, CAST(NULL AS DOUBLE) AS amount_paid
FROM d_checkouts""")
def _apply_defaults(d: Domain):
    """Checkouts as inserts that name a payment status, null where payment fails: a null that is given stays."""
    from pyspark.sql import functions as F
    ins = d.checkouts.select(F.col("checkout_id").alias("reg_id"), "user_id", "event_id", "payment_method",
                             F.when(F.col("payment_ok"), "COMPLETED").alias("payment_status"))
    return C.apply_defaults(ins, AS_OF)


@register("apply_defaults_tables", f"""
SELECT 'users' AS table_name, user_id AS id, '{AS_OF}' AS insert_date, 'USER' AS status, CAST(NULL AS INTEGER) AS booked FROM d_users
UNION ALL SELECT 'sessions', event_id, '{AS_OF}', 'ACTIVE', 0 FROM d_base
UNION ALL SELECT 'cart', cart_id, '{AS_OF}', CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER) FROM d_cart
UNION ALL SELECT 'registrations_pg', checkout_id, '{AS_OF}', 'COMPLETED', CAST(NULL AS INTEGER) FROM d_checkouts""")
def _apply_defaults_tables(d: Domain):
    """Inserts that leave every defaulted column out, for each table and for the PostgreSQL payment default."""
    from pyspark.sql import functions as F
    u = C.apply_defaults(d.users.select("user_id", "full_name", "email"), AS_OF, "users")
    s = C.apply_defaults(d.base_sessions.select("event_id", "event_name", "total_seats"), AS_OF, "sessions")
    c = C.apply_defaults(d.cart.select("cart_id", "user_id", "event_id"), AS_OF, "cart")
    p = C.apply_defaults(d.checkouts.select(F.col("checkout_id").alias("reg_id"), "user_id"), AS_OF, payment_status="COMPLETED")
    none = F.lit(None).cast("int").alias("booked")
    return (u.select(F.lit("users").alias("table_name"), F.col("user_id").alias("id"), F.col("created_date").alias("insert_date"),
                     F.col("user_type").alias("status"), none)
            .unionAll(s.select(F.lit("sessions"), "event_id", "created_date", "event_status", "booked_seats"))
            .unionAll(c.select(F.lit("cart"), "cart_id", "added_date", F.lit(None).cast("string"), none))
            .unionAll(p.select(F.lit("registrations_pg"), "reg_id", "registration_date", "payment_status", none)))


@register("auto_cancel", f"""
SELECT event_id, event_status AS old_status,
       CASE WHEN coalesce(event_date > DATE '{AS_OF}' AND event_date <= DATE '{AS_OF}' + {LOOKAHEAD_DAYS}
                          AND {pct('booked_seats', 'total_seats')} < 10, false)
            THEN 'CANCELLED' ELSE event_status END AS event_status,
       coalesce(event_date > DATE '{AS_OF}' AND event_date <= DATE '{AS_OF}' + {LOOKAHEAD_DAYS}
                AND {pct('booked_seats', 'total_seats')} < 10, false) AS changed
FROM d_sessions""")
def _auto_cancel(d: Domain):
    return C.auto_cancel(d.sessions, AS_OF, LOOKAHEAD_DAYS)


@register("cascade_delete", """
SELECT CAST(reg_id AS VARCHAR) AS reg_id, user_id, event_id FROM d_regs r
WHERE NOT EXISTS (SELECT 1 FROM d_base s WHERE s.event_id = r.event_id AND s.event_status = 'CANCELLED')""")
def _cascade_delete(d: Domain):
    from pyspark.sql import functions as F
    gone = d.base_sessions.filter(F.col("event_status") == "CANCELLED")
    return C.cascade_delete(gone, d.registrations.select("reg_id", "user_id", "event_id"), "event_id")


@register("cascade_delete_cart", """
SELECT cart_id, user_id, event_id FROM d_cart c
WHERE NOT EXISTS (SELECT 1 FROM d_base s WHERE s.event_id = c.event_id AND s.event_status = 'CANCELLED')""")
def _cascade_delete_cart(d: Domain):
    from pyspark.sql import functions as F
    gone = d.base_sessions.filter(F.col("event_status") == "CANCELLED")
    return C.cascade_delete(gone, d.cart.select("cart_id", "user_id", "event_id"), "event_id")

# ---------------------------------------------------------------- checkout

from seatgrid.operators import checkout as K  # noqa: E402


# The texts the three procedures answer with, written out again for the oracle.
ORACLE_TEXT = {
    "ora": ("You can only register for maximum 3 events", "Registration completed successfully. Payment received: ",
            "Cannot exceed total seat capacity"),
    "package": ("Maximum 3 registrations allowed", "Payment successful. Total: ", "Cannot exceed total seat capacity"),
    "pg": ("Maximum 3 registrations allowed", "Payment successful! Total: ₹", "Cannot exceed total seat capacity!"),
}


def _walk_sql(steps: str) -> str:
    """A walk over the checkouts that pass their user's own guards, one by one in (ts, checkout_id) order, with the users
    that have booked and the seats taken so far. steps: CTEs that end in ``asks`` (checkout_id, user_id, ts, pay) and ``goods``
    (user_id, cart_id, event_id, event_name, lft). Gives rec: full_name (first session without a seat), ok, late (booked before).

    Only sessions that as many users ask for as they have seats can run out on the way (``scarce``), so only users with such
    a session are walked; the others depend on nobody."""
    return steps + """,
askers AS (SELECT DISTINCT user_id FROM asks WHERE pay),
scarce AS (SELECT event_id FROM goods WHERE user_id IN (SELECT user_id FROM askers) GROUP BY event_id, lft HAVING lft > 0 AND count(*) >= lft),
its AS (SELECT user_id, list({'c': cart_id, 'eid': event_id, 'n': event_name, 'lft': lft} ORDER BY cart_id) AS its,
               bool_or(event_id IN (SELECT event_id FROM scarce)) AS tied
        FROM goods WHERE lft <= 0 OR event_id IN (SELECT event_id FROM scarce) GROUP BY user_id),
seq AS (SELECT a.*, row_number() OVER (ORDER BY a.ts, a.checkout_id) AS rn, i.its FROM asks a JOIN its i ON i.user_id = a.user_id WHERE i.tied),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS checkout_id, CAST(NULL AS VARCHAR) AS full_name, CAST(NULL AS BOOLEAN) AS ok,
         CAST(NULL AS BOOLEAN) AS late, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS done
  UNION ALL
  SELECT rn, checkout_id, gone[1].n, pay AND NOT late AND len(gone) = 0, late,
         CASE WHEN pay AND NOT late AND len(gone) = 0 THEN list_concat(used, list_transform(its, lambda i: i.eid)) ELSE used END,
         CASE WHEN pay AND NOT late AND len(gone) = 0 THEN list_append(done, user_id) ELSE done END
  FROM (SELECT s.rn, s.checkout_id, s.user_id, s.pay, s.its, r.used, r.done, list_contains(r.done, s.user_id) AS late,
               list_filter(s.its, lambda i: i.lft <= 0 OR i.lft <= len(list_filter(r.used, lambda a: a = i.eid))) AS gone
        FROM walk r JOIN seq s ON s.rn = r.rn + 1) z),
calm AS (SELECT a.checkout_id, a.pay, i.its[1].n AS full_name,
                coalesce(sum(CASE WHEN a.pay AND i.its IS NULL THEN 1 ELSE 0 END) OVER (
                  PARTITION BY a.user_id ORDER BY a.ts, a.checkout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
         FROM asks a LEFT JOIN its i ON i.user_id = a.user_id WHERE NOT coalesce(i.tied, false)),
rec AS (SELECT checkout_id, full_name, ok, late FROM walk WHERE rn > 0
        UNION ALL SELECT checkout_id, full_name, pay AND full_name IS NULL AND before = 0, before > 0 FROM calm)
"""


def _facts_sql(t: dict[str, str], counted: str, pay: str, limited: bool = True) -> str:
    lim = "coalesce(rc.k, 0) + coalesce(cr.k, 0) > 3" if limited else "false"
    return f"""
, rc AS (SELECT user_id, count(*) AS k FROM {t['regs']} WHERE {counted} GROUP BY user_id),
cr AS (SELECT user_id, count(*) AS k FROM {t['cart']} GROUP BY user_id),
goods AS (SELECT c.user_id, c.cart_id, s.event_id, s.event_name, s.total_seats - coalesce(s.booked_seats, 0) AS lft, s.ticket_price
          FROM {t['cart']} c JOIN {t['sessions']} s ON s.event_id = c.event_id),
sums AS (SELECT user_id, count(*) AS items, sum(ticket_price) AS price FROM goods GROUP BY user_id),
facts AS (SELECT k.checkout_id, k.user_id, k.ts, {pay} AS pay, {lim} AS lim
          FROM {t['checkouts']} k LEFT JOIN rc ON rc.user_id = k.user_id LEFT JOIN cr ON cr.user_id = k.user_id),
asks AS (SELECT checkout_id, user_id, ts, pay FROM facts WHERE NOT lim)"""


SHOP = {"regs": "shop_regs", "cart": "shop_cart", "sessions": "shop_sessions", "checkouts": "shop_checkouts"}
CLICKS = {"regs": "d_regs", "cart": "d_cart", "sessions": "d_sessions", "checkouts": "d_checkouts"}
HELD = "registration_status = 'CONFIRMED' AND payment_status = 'COMPLETED'"


def _decision_sql(variant: str) -> str:
    limit, ok, full = ORACLE_TEXT[variant]
    counted = "payment_status = 'COMPLETED'" if variant == "pg" else HELD
    return _walk_sql(_facts_sql(SHOP, counted, "coalesce(k.payment_ok, false)" if variant == "ora" else "true")) + f"""
, dec AS (
SELECT f.checkout_id, f.user_id,
       CASE WHEN f.lim THEN 'FAILED' WHEN NOT f.pay THEN 'FAILED' WHEN r.late OR r.ok THEN 'SUCCESS' ELSE 'ERROR' END AS status,
       CASE WHEN f.lim THEN '{limit}' WHEN NOT f.pay THEN 'Payment failed. Please try again.' WHEN r.late THEN '{ok}0.00'
            WHEN r.ok THEN '{ok}' || CAST(CAST(coalesce(s.price, 0) AS DECIMAL(18,2)) AS VARCHAR) ELSE '{full}' END AS message,
       CASE WHEN f.pay AND r.late THEN 0.0 WHEN r.ok THEN CAST(coalesce(s.price, 0) AS DOUBLE) END AS total_amount,
       CASE WHEN r.ok THEN coalesce(s.items, 0) ELSE 0 END AS items
FROM facts f LEFT JOIN rec r ON r.checkout_id = f.checkout_id LEFT JOIN sums s ON s.user_id = f.user_id)
"""


for _variant, _name in [("ora", "checkout_decision"), ("package", "checkout_decision_package"),
                        ("pg", "checkout_decision_pg")]:
    def _mk(v):
        def fn(d: Domain):
            return K.decision(d.shop_checkouts, d.shop_cart, d.shop_sessions, d.shop_registrations, v)
        return fn
    register(_name, _decision_sql(_variant) + "SELECT * FROM dec")(_mk(_variant))


def _shop_decision(d: Domain):
    return K.decision(d.shop_checkouts, d.shop_cart, d.shop_sessions, d.shop_registrations, "ora")


@register("checkout_apply_registrations", _decision_sql("ora") + """
SELECT c.checkout_id, c.user_id, g.event_id, 'COMPLETED' AS payment_status, 'CONFIRMED' AS registration_status,
       k.payment_method, CAST(g.ticket_price AS DOUBLE) AS amount_paid
FROM dec c JOIN shop_checkouts k ON k.checkout_id = c.checkout_id JOIN goods g ON g.user_id = c.user_id WHERE c.items > 0""")
def _checkout_apply_registrations(d: Domain):
    return K.apply_registrations(_shop_decision(d), d.shop_checkouts, d.shop_cart, d.shop_sessions)


@register("append_registrations", _decision_sql("ora") + """
, fresh AS (SELECT k.user_id, c.event_id, CAST(k.ts AS DATE) AS day, g.ticket_price FROM dec JOIN shop_checkouts k USING (checkout_id)
            JOIN shop_cart c ON c.user_id = k.user_id JOIN goods g ON g.user_id = c.user_id AND g.event_id = c.event_id WHERE dec.items > 0)
SELECT user_id, event_id, CAST(registration_date AS VARCHAR) AS registration_date, payment_status, registration_status,
       strftime(registration_date, '%Y-%m') AS month
FROM shop_regs r WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.user_id = r.user_id AND f.event_id = r.event_id AND strftime(f.day, '%Y-%m') = strftime(r.registration_date, '%Y-%m'))
UNION ALL SELECT user_id, event_id, CAST(day AS VARCHAR), 'COMPLETED', 'CONFIRMED', strftime(day, '%Y-%m') FROM fresh""")
def _append_registrations(d: Domain):
    """What the checkouts book goes into a registrations table kept by month; only the months it falls into are written again."""
    from seatgrid.sources import partitioned as P
    cols = ["user_id", "event_id", "registration_date", "payment_status", "registration_status"]
    month = F.date_format("registration_date", "yyyy-MM").alias("month")
    path = scratch_path(d.spark, "registrations-by-month")
    P.create(d.shop_registrations.select(*cols, month), path, "month")
    new = K.apply_registrations(_shop_decision(d), d.shop_checkouts, d.shop_cart, d.shop_sessions) \
        .join(d.shop_checkouts.select("checkout_id", F.col("ts").cast("date").alias("registration_date")), "checkout_id")
    P.append(d.spark, path, new.select(*cols, month), "month", ["month", "user_id", "event_id"])
    return P.read(d.spark, path)


@register("checkout_apply_seats", _decision_sql("ora") + """
, taken AS (SELECT g.event_id, count(*) AS added FROM dec c JOIN goods g ON g.user_id = c.user_id WHERE c.items > 0 GROUP BY g.event_id)
SELECT s.event_id, s.total_seats, s.booked_seats AS booked_before, t.added, s.booked_seats + t.added AS booked_after
FROM taken t JOIN shop_sessions s ON s.event_id = t.event_id""")
def _checkout_apply_seats(d: Domain):
    return K.apply_seats(d.shop_sessions, K.apply_registrations(_shop_decision(d), d.shop_checkouts, d.shop_cart, d.shop_sessions))


@register("checkout_apply_sessions", _decision_sql("ora") + """
SELECT s.event_id, s.total_seats, CAST(s.booked_seats + (SELECT count(*) FROM dec c, goods g WHERE g.user_id = c.user_id AND c.items > 0
                                                         AND g.event_id = s.event_id) AS INTEGER) AS booked_seats
FROM shop_sessions s""")
def _checkout_apply_sessions(d: Domain):
    """The whole sessions table after the checkouts."""
    new = K.apply_registrations(_shop_decision(d), d.shop_checkouts, d.shop_cart, d.shop_sessions)
    return K.apply_sessions(d.shop_sessions, new).select("event_id", "total_seats", "booked_seats")


@register("checkout_apply_cart", _decision_sql("ora") + """
SELECT CAST(c.cart_id AS VARCHAR) AS cart_id, c.user_id, c.event_id FROM shop_cart c
WHERE c.user_id NOT IN (SELECT user_id FROM dec WHERE items > 0)""")
def _checkout_apply_cart(d: Domain):
    """The cart rows that the checkouts leave."""
    return K.apply_cart(d.shop_cart, _shop_decision(d)).select("cart_id", "user_id", "event_id")


@register("checkout_validate", _walk_sql("""
, goods AS (SELECT c.user_id, c.cart_id, s.event_id, s.event_name, s.event_date, s.start_time, s.end_time,
                   s.total_seats - coalesce(s.booked_seats, 0) AS lft
            FROM shop_cart c JOIN shop_sessions s ON s.event_id = c.event_id),
held AS (SELECT r.user_id, r.reg_id, s.event_name, s.event_date, s.start_time, s.end_time
         FROM shop_regs r JOIN shop_sessions s ON s.event_id = r.event_id WHERE r.registration_status = 'CONFIRMED'),
nc AS (SELECT user_id, count(*) AS k FROM goods GROUP BY user_id),
nh AS (SELECT user_id, count(*) AS k FROM held GROUP BY user_id),
c1 AS (SELECT g.user_id, g.event_name AS a, h.event_name AS b, row_number() OVER (PARTITION BY g.user_id ORDER BY g.cart_id, h.reg_id) AS rn
       FROM goods g JOIN held h ON h.user_id = g.user_id AND h.event_date = g.event_date
        AND NOT (h.start_time >= g.end_time OR g.start_time >= h.end_time)),
c2 AS (SELECT g.user_id, g.event_name AS a, h.event_name AS b, row_number() OVER (PARTITION BY g.user_id ORDER BY g.cart_id, h.cart_id) AS rn
       FROM goods g JOIN goods h ON h.user_id = g.user_id AND h.cart_id > g.cart_id AND h.event_date = g.event_date
        AND NOT (h.start_time >= g.end_time OR g.start_time >= h.end_time)),
facts AS (SELECT k.checkout_id, k.user_id, k.ts, coalesce(k.payment_ok, false) AS pay, coalesce(nc.k, 0) AS n,
                 CASE WHEN coalesce(nc.k, 0) = 0 THEN 'Cart is empty'
                      WHEN coalesce(nc.k, 0) + coalesce(nh.k, 0) > 3 THEN 'You can only register for maximum 3 events. You already have '
                        || coalesce(nh.k, 0) || ' confirmed registrations and trying to add ' || coalesce(nc.k, 0) || ' more.'
                      WHEN c1.a IS NOT NULL THEN 'Time conflict: ' || c1.a || ' conflicts with your confirmed event ' || c1.b
                      WHEN c2.a IS NOT NULL THEN 'Time conflict between cart items: ' || c2.a || ' and ' || c2.b END AS own
          FROM shop_checkouts k LEFT JOIN nc ON nc.user_id = k.user_id LEFT JOIN nh ON nh.user_id = k.user_id
               LEFT JOIN c1 ON c1.user_id = k.user_id AND c1.rn = 1 LEFT JOIN c2 ON c2.user_id = k.user_id AND c2.rn = 1),
asks AS (SELECT checkout_id, user_id, ts, pay FROM facts WHERE own IS NULL)""") + """
SELECT f.checkout_id, f.user_id, CASE WHEN r.ok THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       CASE WHEN f.own IS NOT NULL THEN f.own WHEN r.late THEN 'Cart is empty'
            WHEN r.full_name IS NOT NULL THEN 'Event ' || r.full_name || ' is fully booked'
            WHEN NOT f.pay THEN 'Payment failed. Please try again.' ELSE 'Payment successful! Registration completed.' END AS message,
       CASE WHEN r.ok THEN f.n ELSE 0 END AS items
FROM facts f LEFT JOIN rec r ON r.checkout_id = f.checkout_id""")
def _checkout_validate(d: Domain):
    return K.validate(d.shop_checkouts, d.shop_cart, d.shop_sessions, d.shop_registrations)


def _outcome_sql(t: dict[str, str], limited: bool) -> str:
    return _walk_sql(_facts_sql(t, HELD, "coalesce(k.payment_ok, false)", limited)) + """
SELECT f.checkout_id, f.user_id, CASE WHEN r.ok THEN 'ACCEPTED' ELSE 'REJECTED' END AS status,
       CASE WHEN r.ok THEN coalesce(s.items, 0) ELSE 0 END AS items
FROM facts f LEFT JOIN rec r ON r.checkout_id = f.checkout_id LEFT JOIN sums s ON s.user_id = f.user_id"""


@register("checkout_all_or_nothing", _outcome_sql(SHOP, True))
def _checkout_all_or_nothing(d: Domain):
    return K.all_or_nothing(d.shop_checkouts, d.shop_cart, d.shop_sessions, d.shop_registrations)


@register("checkout_seat_competition", _outcome_sql(CLICKS, False))
def _checkout_seat_competition(d: Domain):
    """The seat race of the clickstream's checkouts alone (no registration limit)."""
    return K.all_or_nothing(d.checkouts, d.cart, d.sessions, d.registrations, limit=None)


ORDERED_SQL = FACTS_SQL + f"""
, q2 AS (
  SELECT f.*, s.event_name AS ename, s.event_date AS d, s.start_time AS st, s.end_time AS et,
         row_number() OVER (PARTITION BY f.user_id ORDER BY rq.ts, f.request_id) AS rn,
         CASE WHEN NOT f.found THEN {_q("Event not found")}
              WHEN f.confirmed_count >= 3 AND {_HALF.replace("booked_seats", "f.booked_seats").replace("total_seats", "f.total_seats")}
                THEN {_q("You already have 3 confirmed registrations and this event is more than 50% full")}
              WHEN f.conflict_count > 0 THEN {_q("Time conflict with event: ")} || f.conflict_name END AS static
  FROM f JOIN d_requests rq ON rq.request_id = f.request_id LEFT JOIN d_sessions s ON f.event_id = s.event_id),
rec AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS event_id,
         CAST(NULL AS VARCHAR) AS message,
         CAST([] AS STRUCT(eid BIGINT, d DATE, s VARCHAR, e VARCHAR, n VARCHAR)[]) AS acc
  FROM (SELECT DISTINCT user_id FROM q2) u
  UNION ALL
  SELECT user_id, rn, request_id, event_id, message,
         CASE WHEN message IS NULL THEN list_append(acc, {{'eid': event_id, 'd': d, 's': st, 'e': et, 'n': ename}})
              ELSE acc END
  FROM (
    SELECT q.user_id, q.rn, q.request_id, q.event_id, q.d, q.st, q.et, q.ename, r.acc,
      CASE WHEN q.static IS NOT NULL THEN q.static
           WHEN q.cart_conflict_count > 0 THEN {_q("Time conflict with event in cart: ")} || q.cart_conflict_name
           WHEN len(list_filter(r.acc, lambda x: x.d = q.d AND x.s < q.et AND q.st < x.e)) > 0
             THEN {_q("Time conflict with event in cart: ")} || list_filter(r.acc, lambda x: x.d = q.d AND x.s < q.et AND q.st < x.e)[1].n
           WHEN q.in_cart OR list_contains(list_transform(r.acc, lambda x: x.eid), q.event_id) THEN {_q("Event already in cart")}
           WHEN q.registered THEN {_q("Already registered for this event")} END AS message
    FROM rec r JOIN q2 q ON q.user_id = r.user_id AND q.rn = r.rn + 1) z)
SELECT request_id, user_id, event_id, CASE WHEN message IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status,
       coalesce(message, {_q("Event added to cart successfully")}) AS message
FROM rec WHERE rn > 0"""


@register("cart_admission_ordered", ORDERED_SQL)
def _cart_admission_ordered(d: Domain):
    return A.ordered(d.requests, d.sessions, d.registrations, d.cart)

# ---------------------------------------------------------------- streaming (triggers over a stream)

from seatgrid.streaming import streams as S  # noqa: E402


def _stream_source(d: Domain):
    return S.click_stream(d.spark, d.sf_dir, glob="events.parquet")


@register("stream_seat_counts", """
SELECT k AS event_id, count(*) AS booked_seats FROM d_clicks WHERE event_type = 'purchase' AND value >= 1 GROUP BY k""")
def _stream_seat_counts(d: Domain):
    return S.seat_counts(d.spark, S.registration_stream(_stream_source(d)))


@register("stream_audit_log", """
SELECT event_id AS audit_id, user_id, k AS event_id, 'INSERT' AS action, ts AS action_time,
       CAST(NULL AS VARCHAR) AS old_status, CASE WHEN value >= 1 THEN 'COMPLETED' ELSE 'FAILED' END AS new_status
FROM d_clicks WHERE event_type = 'purchase'""")
def _stream_audit_log(d: Domain):
    return S.audit_log(d.spark, S.registration_stream(_stream_source(d)))


@register("stream_audit_updates", CANCEL_SQL + """
SELECT CAST(r.reg_id AS VARCHAR) AS reg_id, r.user_id, r.event_id, 'UPDATE' AS action,
       r.registration_status AS old_status, 'CANCELLED' AS new_status
FROM d_regs r WHERE r.reg_id IN (SELECT reg_id FROM cx WHERE ok)""")
def _stream_audit_updates(d: Domain):
    """The writes of the registrations table as a stream of files: every insert, then what the cancellations update."""
    named = _named(d)
    done = C.cancel_registrations(named, d.cancellations).filter("status = 'SUCCESS'")
    updates = done.select("request_id", "reg_id").join(named, "reg_id").join(d.cancellations.select("request_id", "ts"), "request_id") \
        .select((2 * F.col("request_id") + 1).alias("write_id"), "reg_id", "user_id", "event_id",
                F.lit("CANCELLED").alias("registration_status"), "ts")
    inserts = d.registrations.select((2 * F.monotonically_increasing_id()).alias("write_id"), "reg_id", "user_id", "event_id",
                                     "registration_status", F.col("registration_date").cast("timestamp").alias("ts"))
    source = scratch_path(d.spark, "writes")
    inserts.write.option("compression", "zstd").parquet(source)
    updates.repartition(3, "reg_id").write.mode("append").parquet(source)
    writes = d.spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 4).parquet(source)
    return S.update_log(d.spark, writes).drop("write_id", "action_time")


@register("stream_assign_ids", """
SELECT event_id AS click_id, user_id, row_number() OVER (ORDER BY ts NULLS FIRST, event_id) AS row_id FROM d_clicks WHERE event_type = 'click'""")
def _stream_assign_ids(d: Domain):
    clicks = _stream_source(d).filter(F.col("event_type") == "click").select(F.col("event_id").alias("click_id"), "user_id", "ts")
    return S.assign_ids(d.spark, clicks, ["ts", "click_id"], "row_id").drop("ts")


@register("stream_waitlist", """
, p AS (SELECT event_id AS reg_id, user_id, k AS event_id, ts, value >= 1 AS paid FROM d_clicks WHERE event_type = 'purchase'),
b AS (SELECT *, coalesce(sum(CASE WHEN paid THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY ts NULLS FIRST, reg_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_paid FROM p)
SELECT b.reg_id, b.user_id, b.event_id, b.ts,
       CASE WHEN coalesce(b.before_paid >= s.total_seats, false) THEN 'WAITLIST' ELSE 'CONFIRMED' END AS registration_status,
       b.paid AND NOT coalesce(b.before_paid >= s.total_seats, false) AS takes_seat
FROM b LEFT JOIN d_base s ON b.event_id = s.event_id""")
def _stream_waitlist(d: Domain):
    return S.waitlist(d.spark, S.registration_stream(_stream_source(d)), d.base_sessions)


@register("stream_cart_dedupe", "SELECT cart_id, user_id, event_id, CAST(added_date AS VARCHAR) AS added_date FROM d_cart")
def _stream_cart_dedupe(d: Domain):
    return S.cart_dedupe(d.spark, _stream_source(d))

# ---------------------------------------------------------------- SQL surface (views + SQL functions)

from seatgrid.plans import sql_surface  # noqa: E402


@register("sql_events_not_full")
def _sql_events_not_full(d: Domain):
    """Sessions with seats left, in SQL over the dashboard view."""
    sql_surface.register(d.spark, d)
    return d.spark.table("admin_dashboard_view").selectExpr(
        "event_name", "event_date", "total_seats", "registered_seats", "fill_percentage").where("fill_percentage < 100")


ORACLE["sql_events_not_full"] = ORACLE["events_not_full"]


@register("sql_event_stats")
def _sql_event_stats(d: Domain):
    """Per-row SQL function calls (PG's view), decorrelated by Catalyst."""
    sql_surface.register(d.spark, d)
    return d.spark.sql("SELECT event_id, event_name, event_date, start_time, end_time, total_seats, booked_seats, "
                       "total_seats - booked_seats AS available_seats, fn_fill_percentage(event_id) AS fill_percentage, "
                       "ticket_price, event_status FROM sessions")


ORACLE["sql_event_stats"] = ORACLE["event_stats"]


@register("sql_user_functions")
def _sql_user_functions(d: Domain):
    sql_surface.register(d.spark, d)
    return d.spark.sql("SELECT user_id, fn_get_user_reg_count(user_id) AS reg_count, fn_can_register(user_id) AS can_register "
                       "FROM users")


ORACLE["sql_user_functions"] = with_views("""
SELECT u.user_id,
       (SELECT count(*) FROM d_regs r WHERE r.user_id = u.user_id AND r.registration_status = 'CONFIRMED'
          AND r.payment_status = 'COMPLETED') AS reg_count,
       (SELECT count(*) FROM d_regs r WHERE r.user_id = u.user_id AND r.payment_status = 'COMPLETED') < 3 AS can_register
FROM d_users u""")


@register("sql_session_functions", f"""
SELECT s.event_id, coalesce(s.booked_seats < s.total_seats, false) AS checked, s.booked_seats < s.total_seats AS available,
       {pct('s.booked_seats', 's.total_seats')} AS fill FROM d_sessions s
UNION ALL SELECT -1, false, NULL, NULL""")
def _sql_session_functions(d: Domain):
    """Seat and fill functions for every session and for one that doesn't exist."""
    sql_surface.register(d.spark, d)
    return d.spark.sql("SELECT event_id, fn_check_seat_availability(event_id) AS checked, fn_seats_available(event_id) AS available, "
                       "fn_event_fill_percentage(event_id) AS fill FROM (SELECT event_id FROM sessions UNION ALL SELECT -1)")


@register("sql_user_cart")
def _sql_user_cart(d: Domain):
    """Every user's cart through the table function."""
    sql_surface.register(d.spark, d)
    return d.spark.sql("SELECT c.cart_id, u.user_id, c.* EXCEPT (cart_id) FROM (SELECT DISTINCT user_id FROM cart) u, LATERAL fn_user_cart(u.user_id) c")


@register("sql_user_registrations")
def _sql_user_registrations(d: Domain):
    """Every user's confirmed registrations through the table function."""
    sql_surface.register(d.spark, d)
    return d.spark.sql("SELECT u.user_id, r.* FROM (SELECT DISTINCT user_id FROM registrations) u, LATERAL fn_user_registrations(u.user_id) r")


@register("script_daily_report")
def _script_daily_report(d: Domain):
    """The daily report as a SQL script."""
    sql_surface.register(d.spark, d)
    return sql_surface.daily_report(d.spark, AS_OF, LOOKAHEAD_DAYS)


for _name, _same in (("sql_user_cart", "user_cart"), ("sql_user_registrations", "user_registrations"), ("script_daily_report", "daily_event_report")):
    ORACLE[_name] = ORACLE[_same]


@register("sql_time_conflicts", """
SELECT q.request_id, (SELECT count(*) FROM d_regs r, d_sessions e, d_sessions s
                      WHERE s.event_id = q.event_id AND r.user_id = q.user_id AND e.event_id = r.event_id
                        AND r.registration_status = 'CONFIRMED' AND e.event_date = s.event_date
                        AND NOT (e.start_time >= s.end_time OR s.start_time >= e.end_time)) AS conflicts
FROM d_requests q""")
def _sql_time_conflicts(d: Domain):
    """The conflict function for every request."""
    sql_surface.register(d.spark, d)
    d.requests.join(d.sessions.select("event_id", "event_date", "start_time", "end_time"), "event_id", "left") \
        .createOrReplaceTempView("request_intervals")
    return d.spark.sql("SELECT request_id, fn_check_time_conflict(user_id, event_date, start_time, end_time) AS conflicts "
                       "FROM request_intervals")


@register("sql_event_popularity")
def _sql_event_popularity(d: Domain):
    sql_surface.register(d.spark, d)
    return d.spark.table("event_popularity_view")


ORACLE["sql_event_popularity"] = ORACLE["event_popularity"]
