"""Domain views written as plain SQL for the independent DuckDB oracle.

They restate the derivation of ``seatgrid.sources.domain`` in set-SQL form (window
``row_number`` instead of the aggregate-of-struct used on Spark), so the oracle is
an independent formulation, not the same plan twice.
"""

import re

VIEWS = """
d_users AS (
  SELECT c_custkey AS user_id, c_name AS full_name,
         concat(lower(replace(c_name, '#', '.')), '@example.com') AS email,
         CASE WHEN c_nationkey = 0 THEN 'ADMIN' ELSE 'USER' END AS user_type
  FROM customer),
d_base AS (
  SELECT p_partkey AS event_id, p_name AS event_name,
         CAST(DATE '2024-01-01' + CAST(p_partkey // 64 AS INTEGER) AS DATE) AS event_date,
         lpad(CAST(8 + p_size % 10 AS VARCHAR), 2, '0') || ':00' AS start_time,
         lpad(CAST(9 + p_size % 10 + p_partkey % 3 AS VARCHAR), 2, '0') || ':30' AS end_time,
         CAST(10 + p_size AS INTEGER) AS total_seats,
         CAST(p_retailprice AS DECIMAL(10,2)) AS ticket_price,
         CASE p_type WHEN 'PROMO' THEN 'CANCELLED' WHEN 'SMALL' THEN 'COMPLETED' ELSE 'ACTIVE' END AS event_status
  FROM part),
d_regs AS (
  SELECT CAST(o_custkey AS HUGEINT) * 10000000000000000000 + l_partkey AS reg_id, o_custkey AS user_id, l_partkey AS event_id,
         CAST(o_orderdate AS DATE) AS registration_date,
         CASE WHEN l_returnflag = 'R' THEN 'REFUNDED' WHEN o_orderstatus = 'P' THEN 'PENDING'
              WHEN o_orderstatus = 'O' AND l_returnflag = 'A' THEN 'FAILED' ELSE 'COMPLETED' END AS payment_status,
         CASE WHEN l_returnflag = 'R' THEN 'CANCELLED' WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'WAITLIST'
              ELSE 'CONFIRMED' END AS registration_status,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS amount_paid
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, l_partkey
          ORDER BY o_orderdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_suppkey,
                   l_returnflag, l_linestatus, o_orderstatus) AS rn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) z
  WHERE rn = 1),
d_sessions AS (
  SELECT s.*, CAST(least(s.total_seats, coalesce(k.n, 0)) AS INTEGER) AS booked_seats,
         CAST(coalesce(k.n, 0) AS BIGINT) AS raw_booked
  FROM d_base s LEFT JOIN (SELECT event_id, count(*) AS n FROM d_regs WHERE payment_status = 'COMPLETED'
                           GROUP BY event_id) k ON s.event_id = k.event_id),
d_clicks AS (
  SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, value, event_type,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
d_cart AS (
  SELECT event_id AS cart_id, user_id, k AS event_id, CAST(ts AS DATE) AS added_date
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS rn
        FROM d_clicks WHERE event_type = 'click') y
  WHERE rn = 1),
d_requests AS (
  SELECT event_id AS request_id, user_id, k AS event_id, ts FROM d_clicks WHERE event_type = 'signup'),
d_checkouts AS (
  SELECT event_id AS checkout_id, user_id, ts,
         CASE WHEN value < 10 THEN 'UPI' WHEN value < 30 THEN 'CARD' ELSE 'NETBANKING' END AS payment_method,
         value >= 1 AS payment_ok, k AS event_id
  FROM d_clicks WHERE event_type = 'purchase'),
d_cancellations AS (
  SELECT event_id AS request_id, user_id, CAST(user_id AS HUGEINT) * 10000000000000000000 + k AS reg_id, ts
  FROM d_clicks WHERE event_type = 'error'),
d_removals AS (
  SELECT v.event_id AS request_id, v.user_id, v.k AS event_id, v.ts,
         (SELECT c.cart_id FROM d_cart c WHERE c.user_id = v.user_id AND c.event_id = v.k) AS cart_id
  FROM d_clicks v WHERE v.event_type = 'view'),
d_user_signups AS (
  SELECT 2 * s_suppkey AS request_id, s_name AS full_name,
         concat(lower(replace(s_name, '#', '.')), '@example.com') AS email
  FROM supplier
  UNION ALL
  SELECT 2 * c.event_id + 1 AS request_id,
         CASE c.event_id % 7 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE u.full_name END AS full_name,
         CASE c.event_id % 7 WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'shared.' || u.email ELSE u.email END AS email
  FROM d_clicks c JOIN d_users u ON c.user_id = u.user_id WHERE c.event_type = 'signup'),
shop_lines AS (
  SELECT o_orderkey // 2 AS user_id, o_orderkey % 2 AS odd, l_partkey AS event_id, CAST(o_orderdate AS DATE) AS day, o_orderstatus,
         l_returnflag, l_linestatus, l_extendedprice,
         row_number() OVER (PARTITION BY o_orderkey, l_partkey ORDER BY l_linenumber, l_extendedprice, l_returnflag, l_linestatus) AS rn
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
shop_regs AS (
  SELECT CAST(user_id AS HUGEINT) * 10000000000000000000 + event_id AS reg_id, user_id, event_id, day AS registration_date,
         CASE WHEN l_returnflag = 'R' THEN 'REFUNDED' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'COMPLETED' END AS payment_status,
         CASE WHEN l_returnflag = 'R' THEN 'CANCELLED' WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'WAITLIST'
              ELSE 'CONFIRMED' END AS registration_status
  FROM shop_lines WHERE odd = 0 AND rn = 1),
shop_cart AS (
  SELECT CAST(user_id AS HUGEINT) * 10000000000000000000 + event_id AS cart_id, user_id, event_id, day AS added_date
  FROM shop_lines WHERE odd = 1 AND rn = 1 AND l_returnflag = 'N'),
shop_sessions AS (
  SELECT b.event_id, b.event_name, b.event_date, b.start_time, b.end_time, 1 + b.total_seats % 15 AS total_seats, b.ticket_price, b.event_status,
         least(1 + b.total_seats % 15, (SELECT count(*) FROM shop_regs r WHERE r.event_id = b.event_id AND r.payment_status = 'COMPLETED')) AS booked_seats
  FROM d_base b),
shop_requests AS (
  SELECT request_id, user_id, CASE WHEN request_id % 23 = 5 THEN -k ELSE k END AS event_id, CAST(day AS TIMESTAMP) AS ts
  FROM (SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey // 2 AS user_id, min(l_partkey) AS k, min(l_shipdate) AS day
        FROM lineitem GROUP BY ALL) y),
shop_checkouts AS (
  SELECT o_orderkey AS checkout_id, o_orderkey // 2 AS user_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
         CASE o_orderstatus WHEN 'O' THEN 'UPI' ELSE 'CARD' END AS payment_method, o_orderstatus <> 'F' AS payment_ok
  FROM orders)
"""


def pct(num: str, den: str) -> str:
    """DuckDB text of the exact half-up round(100 * num / den, 2) as DOUBLE."""
    n, d = f"CAST(({num}) AS BIGINT)", f"CAST(({den}) AS BIGINT)"
    return f"(CASE WHEN {d} <> 0 THEN CAST((({n} * 20000 + {d}) // ({d} * 2)) AS DOUBLE) / 100 END)"


def with_views(sql: str) -> str:
    """Prefix the domain views. A query text starting with ',' adds its own CTEs."""
    body = sql.strip()
    head = "WITH RECURSIVE " if re.search(r"\b(rec|walk) AS \(\s*SELECT CAST\(0|\brec AS \(", body) else "WITH "  # sequential oracles recurse
    return head + VIEWS.strip() + ("" if body.startswith(",") else "\n") + body
