"""SQL surface: tables and reports as temporary views, scalar functions as SQL functions.

The report views are the DataFrame operators themselves, registered under their public names, so SQL
users get the same aggregate-before-join plans. The function bodies are expressions over three small
helper views (one row per user, one per session, one per user and interval); Catalyst turns a call
per row into a join with the helper, so no query runs per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatgrid.functions.rules import fill_pct
from seatgrid.operators import reports as R
from seatgrid.operators.lookups import INTERVAL, confirmed
from seatgrid.sources.domain import Domain


def report_views(d: Domain) -> dict[str, DataFrame]:
    return {
        "admin_dashboard_view": R.admin_dashboard(d.sessions, d.registrations),
        "vw_admin_dashboard": R.admin_dashboard_counts(d.sessions, d.registrations),
        "vw_event_stats": R.event_stats(d.sessions),
        "event_popularity_view": R.event_popularity(d.sessions),
        "user_registration_summary": R.user_registration_summary(d.users, d.registrations),
        "vw_user_summary": R.user_summary_completed(d.users, d.registrations),
    }


def helper_views(d: Domain) -> dict[str, DataFrame]:
    paid = F.col("payment_status") == "COMPLETED"
    held = F.col("registration_status") == "CONFIRMED"
    intervals = confirmed(d.registrations).select("user_id", "event_id").join(d.sessions.select("event_id", *INTERVAL), "event_id")
    held_intervals = intervals.groupBy("user_id", *INTERVAL).agg(F.count(F.lit(1)).alias("times"))
    return {
        "user_seat_counts": d.registrations.groupBy("user_id").agg(
            F.count_if(paid).alias("paid"), F.count_if(paid & held).alias("paid_and_held")),
        "session_fill": d.sessions.select(
            "event_id", (F.col("booked_seats") < F.col("total_seats")).alias("open"), fill_pct().alias("fill")),
        "held_intervals": held_intervals,
        # a call looks its user and date up and compares the times there: compared in the subquery, every time asked about would
        # be joined with every interval that anybody holds
        "held_days": held_intervals.groupBy("user_id", "event_date").agg(F.collect_list(F.struct("start_time", "end_time", "times")).alias("spans")),
        "paid_by_date": d.registrations.filter(paid).groupBy("registration_date").agg(F.sum("amount_paid").alias("paid")),
    }


# Name, parameters and result of each function are its public interface; bodies are over the helper views.
FUNCTIONS = [
    ("fn_get_user_reg_count", "p_user_id BIGINT", "BIGINT",
     "coalesce((SELECT max(h.paid_and_held) FROM user_seat_counts h WHERE h.user_id = p_user_id), 0)"),
    ("fn_can_register", "p_user_id BIGINT", "BOOLEAN",
     "coalesce((SELECT max(h.paid) FROM user_seat_counts h WHERE h.user_id = p_user_id), 0) < 3"),
    ("fn_event_fill_percentage", "p_event_id BIGINT", "DOUBLE",
     "(SELECT max(h.fill) FROM session_fill h WHERE h.event_id = p_event_id)"),
    ("fn_fill_percentage", "p_event_id BIGINT", "DOUBLE",
     "coalesce((SELECT max(h.fill) FROM session_fill h WHERE h.event_id = p_event_id), 0.0D)"),
    ("fn_check_seat_availability", "p_event_id BIGINT", "BOOLEAN",
     "coalesce((SELECT max(h.open) FROM session_fill h WHERE h.event_id = p_event_id), false)"),
    ("fn_seats_available", "p_event_id BIGINT", "BOOLEAN",
     "(SELECT max(h.open) FROM session_fill h WHERE h.event_id = p_event_id)"),
    ("fn_overlaps_among", "p_spans ARRAY<STRUCT<start_time: STRING, end_time: STRING, times: BIGINT>>, p_start STRING, p_end STRING", "BIGINT",
     "coalesce(aggregate(filter(p_spans, x -> x.start_time < p_end AND p_start < x.end_time), CAST(0 AS BIGINT), (n, x) -> n + x.times), 0)"),
    ("fn_check_time_conflict", "p_user_id BIGINT, p_event_date DATE, p_start_time STRING, p_end_time STRING", "BIGINT",
     "fn_overlaps_among((SELECT any_value(h.spans) FROM held_days h WHERE h.user_id = p_user_id AND h.event_date = p_event_date), "
     "p_start_time, p_end_time)"),
    ("fn_total_revenue", "p_from DATE, p_to DATE", "DECIMAL(30,2)",
     "coalesce((SELECT sum(h.paid) FROM paid_by_date h WHERE (p_from IS NULL AND p_to IS NULL) "
     "OR (h.registration_date >= p_from AND h.registration_date <= p_to)), 0)"),
]


# Table functions: name, parameters, result columns and query; called through LATERAL they become joins.
SESSION_COLUMNS = ("event_id BIGINT, event_name STRING, event_date DATE, start_time STRING, end_time STRING, total_seats INT, "
                   "booked_seats INT, ticket_price DECIMAL(10,2), event_status STRING")
_SESSION = ", ".join(f"s.{c.split()[0]}" for c in SESSION_COLUMNS.replace("(10,2)", "").split(", "))
TABLE_FUNCTIONS = [
    ("fn_user_cart", "p_user_id BIGINT", f"cart_id BIGINT, {SESSION_COLUMNS}",
     f"SELECT c.cart_id, {_SESSION} FROM cart c JOIN sessions s USING (event_id) WHERE c.user_id = p_user_id"),
    ("fn_user_registrations", "p_user_id BIGINT", f"{SESSION_COLUMNS}, registration_date DATE",
     f"SELECT {_SESSION}, r.registration_date FROM registrations r JOIN sessions s USING (event_id) "
     "WHERE r.user_id = p_user_id AND r.registration_status = 'CONFIRMED'"),
]

# The daily report as a script: parameters with checks, a handler, and the report as its result.
DAILY_REPORT = """
BEGIN
  DECLARE as_of DATE;
  DECLARE days INT DEFAULT 0;
  DECLARE EXIT HANDLER FOR SQLEXCEPTION
    SELECT CAST(NULL AS BIGINT) AS event_id, 'report failed' AS event_name, CAST(NULL AS DATE) AS event_date, CAST(NULL AS INT) AS booked_seats,
           CAST(NULL AS INT) AS total_seats, CAST(NULL AS DOUBLE) AS fill_percentage, CAST(NULL AS BOOLEAN) AS auto_cancel;
  SET as_of = DATE '{as_of}';
  SET days = CAST('{days}' AS INT);
  IF days < 0 THEN
    SET days = 0;
  END IF;
  SELECT s.event_id, s.event_name, s.event_date, s.booked_seats, s.total_seats, f.fill AS fill_percentage,
         coalesce(f.fill < 10 AND s.event_date > as_of, false) AS auto_cancel
  FROM sessions s JOIN session_fill f USING (event_id)
  WHERE s.event_date BETWEEN as_of AND date_add(as_of, days);
END
"""


def daily_report(spark: SparkSession, as_of: str, days: int | str) -> DataFrame:
    """The daily report run as a SQL script over the registered views. What can't be read as a number of days, or a date, ends
    in the script's handler: one row that says so."""
    if "'" in f"{as_of}{days}":
        raise ValueError("a date and a number of days")
    return spark.sql(DAILY_REPORT.format(as_of=as_of, days=days))


def register(spark: SparkSession, d: Domain) -> None:
    """Create the temp views (tables, reports, helpers) and the SQL functions in this session."""
    tables = {name: getattr(d, name) for name in ("users", "sessions", "registrations", "cart")}
    for name, df in (tables | report_views(d) | helper_views(d)).items():
        df.createOrReplaceTempView(name)
    for name, params, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    for name, params, columns, body in TABLE_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE({columns}) RETURN {body}")


def user_registrations_for(spark: SparkSession, user_id: int):
    """Point lookup with a bound parameter (no string splicing): one user's confirmed
    registrations with their sessions. Needs :func:`register` first."""
    return spark.sql(
        "SELECT e.*, r.registration_date FROM registrations r JOIN sessions e ON r.event_id = e.event_id "
        "WHERE r.user_id = :uid AND r.registration_status = 'CONFIRMED'", args={"uid": user_id})
