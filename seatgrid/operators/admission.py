"""Cart admission: a table of (user, session) add requests in, one decision per request out.

The per-request guard sequence of each variant becomes one ordered ``when`` chain over
facts computed set-wise (joins with pre-aggregated registration / cart tables). The
chain order fixes the reported reason, exactly like the guard order of a procedure.
Each request is decided against the same snapshot (see ``ordered`` for in-order
admission where earlier accepted requests count as cart items).
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatgrid.operators.lookups import INTERVAL, confirmed, interval_groups, near
from seatgrid.operators.overlap import has_odd, overlap_pairs
from seatgrid.operators.scan import ordered_pass
from seatgrid.session import cut_lineage

# Decision statuses and messages of the three variants.
SUCCESS, FAILED, ERROR = "SUCCESS", "FAILED", "ERROR"
MSG_NOT_FOUND = "Event not found"
MSG_NOT_ACTIVE = "Event is not active"
MSG_IN_CART = "Event already in cart"
MSG_REGISTERED = "Already registered for this event"
MSG_CONFLICT = "Time conflict with existing registration"
MSG_LIMIT = "Maximum 3 registrations allowed"
MSG_NO_SEATS = "No seats available"
MSG_ADDED = "Added to cart successfully"
MSG_FK = "insert or update on table cart violates foreign key constraint (event not found)"
MSG_JS_LIMIT = "You already have 3 confirmed registrations and this event is more than 50% full"
MSG_JS_CONFLICT = "Time conflict with event: "
MSG_JS_CART_CONFLICT = "Time conflict with event in cart: "
MSG_JS_ADDED = "Event added to cart successfully"
LIMIT = 3
WIDE_BIN = 240  # minutes; a user's distinct intervals of a date are few, so a bin may hold more of them


def admission_facts(requests: DataFrame, sessions: DataFrame, registrations: DataFrame, cart: DataFrame,
                    with_names: bool = True) -> DataFrame:
    """Per request: session facts, cart / registration membership, counts and (with
    ``with_names``) the cart conflicts and the names of the first clashing registration and cart item.

    The requests with their sessions, and what the requesting users hold, are written once; all facts are
    aggregates of these by (user, session), user, or distinct interval.
    """
    s = sessions.select("event_id", "event_name", *INTERVAL, "total_seats", "booked_seats", "event_status") \
        .withColumn("found", F.lit(True))
    q = cut_lineage(requests.select("request_id", "user_id", "event_id").join(s, "event_id", "left")
                    .withColumn("found", F.coalesce(F.col("found"), F.lit(False))))
    asking = q.select("user_id")
    own = s.select("event_id", "event_name", *INTERVAL, F.lit(1).alias("_known"))
    held = cut_lineage(registrations.select("reg_id", "user_id", "event_id", "payment_status", "registration_status")
                       .join(asking, "user_id", "left_semi").join(own, "event_id", "left"))
    items = cart.select("cart_id", "user_id", "event_id").join(asking, "user_id", "left_semi")
    if with_names:
        items = cut_lineage(items.join(own, "event_id", "left"))

    in_cart = items.groupBy("user_id", "event_id").agg(F.lit(True).alias("in_cart"))
    registered = held.groupBy("user_id", "event_id").agg(F.lit(True).alias("registered"))
    conf = confirmed(held)
    # the application counts confirmed rows joined to their session; the procedures count rows
    counts = conf.groupBy("user_id").agg(
        F.count("_known").alias("confirmed_count"),
        F.sum(F.when(F.col("payment_status") == "COMPLETED", 1).otherwise(0)).alias("paid_confirmed_count"))
    asked, *with_days = near(q.select("request_id", "user_id", *INTERVAL), conf.filter("_known = 1"), *([items.filter("_known = 1")] if with_names else []))
    # one search among both: the requests go through the bins once
    summary = interval_groups(with_days[0], "reg_id", with_names)
    if with_names:
        in_carts = interval_groups(with_days[1], "cart_id").withColumnsRenamed({"n": "cart_n", "first": "cart_first"})
        summary = summary.unionByName(in_carts, allowMissingColumns=True)
    pairs = overlap_pairs(asked, summary, ["user_id", "event_date"], ["user_id", "event_date"], bin_minutes=WIDE_BIN)
    found = [("conflict", "r_n", "r_first"), ("cart_conflict", "r_cart_n", "r_cart_first")][:1 + with_names]
    conflicts = pairs.groupBy(F.col("l_request_id").alias("request_id")).agg(
        *[c for name, n, first in found for c in (F.sum(n).alias(f"{name}_count"), F.min(first).alias(f"{name}_first"))])
    conflicts = cut_lineage(conflicts.select("request_id", *[c for name, _, _ in found for c in (
        f"{name}_count", F.col(f"{name}_first.event_name").alias(f"{name}_name"))]))
    f = (q.join(in_cart, ["user_id", "event_id"], "left")
         .join(registered, ["user_id", "event_id"], "left")
         .join(counts, "user_id", "left")
         .join(conflicts, "request_id", "left"))
    if not with_names:
        f = f.withColumn("cart_conflict_count", F.lit(None).cast("bigint")).withColumn("cart_conflict_name", F.lit(None).cast("string"))
    return f.select(
        "request_id", "user_id", "event_id", "found", "event_name", *INTERVAL, "total_seats", "booked_seats", "event_status",
        F.coalesce(F.col("in_cart"), F.lit(False)).alias("in_cart"),
        F.coalesce(F.col("registered"), F.lit(False)).alias("registered"),
        F.coalesce(F.col("confirmed_count"), F.lit(0)).alias("confirmed_count"),
        F.coalesce(F.col("paid_confirmed_count"), F.lit(0)).cast("bigint").alias("paid_confirmed_count"),
        F.coalesce(F.col("conflict_count"), F.lit(0)).alias("conflict_count"), "conflict_name",
        F.coalesce(F.col("cart_conflict_count"), F.lit(0)).alias("cart_conflict_count"), "cart_conflict_name",
    )


def _decide(f: DataFrame, chain: list[tuple[F.Column, str, F.Column | str]], ok_msg: str) -> DataFrame:
    status = None
    message = None
    for cond, st, msg in chain:
        m = msg if isinstance(msg, F.Column) else F.lit(msg)
        status = F.when(cond, F.lit(st)) if status is None else status.when(cond, F.lit(st))
        message = F.when(cond, m) if message is None else message.when(cond, m)
    return f.select("request_id", "user_id", "event_id",
                    status.otherwise(F.lit(SUCCESS)).alias("status"),
                    message.otherwise(F.lit(ok_msg)).alias("message"))


def _seat_free():
    # fn_check_seat_availability: TRUE only if booked < total; unknown counts as FALSE
    return F.coalesce(F.col("booked_seats") < F.col("total_seats"), F.lit(False))


def strict(facts: DataFrame) -> DataFrame:
    """Standalone Oracle procedure: not found, not active, in cart, registered, conflict, limit, seats."""
    c = F.col
    return _decide(facts, [
        (~c("found"), FAILED, MSG_NOT_FOUND),
        (c("event_status") != "ACTIVE", FAILED, MSG_NOT_ACTIVE),
        (c("in_cart"), FAILED, MSG_IN_CART),
        (c("registered"), FAILED, MSG_REGISTERED),
        (c("conflict_count") > 0, FAILED, MSG_CONFLICT),
        (c("paid_confirmed_count") >= LIMIT, FAILED, MSG_LIMIT),
        (~_seat_free(), FAILED, MSG_NO_SEATS),
    ], MSG_ADDED)


def package(facts: DataFrame) -> DataFrame:
    """Package body variant: the same chain without the 'already registered' guard."""
    c = F.col
    return _decide(facts, [
        (~c("found"), FAILED, MSG_NOT_FOUND),
        (c("event_status") != "ACTIVE", FAILED, MSG_NOT_ACTIVE),
        (c("in_cart"), FAILED, MSG_IN_CART),
        (c("conflict_count") > 0, FAILED, MSG_CONFLICT),
        (c("paid_confirmed_count") >= LIMIT, FAILED, MSG_LIMIT),
        (~_seat_free(), FAILED, MSG_NO_SEATS),
    ], MSG_ADDED)


def basic(facts: DataFrame) -> DataFrame:
    """PostgreSQL variant: in cart, registered, seats. An unknown seat answer (NULL) admits;
    a missing session then fails the cart's foreign key -> ERROR."""
    c = F.col
    return _decide(facts, [
        (c("in_cart"), FAILED, MSG_IN_CART),
        (c("registered"), FAILED, MSG_REGISTERED),
        (~(c("booked_seats") < c("total_seats")), FAILED, MSG_NO_SEATS),
        (~c("found"), ERROR, MSG_FK),
    ], MSG_ADDED)


def half_full(facts: DataFrame) -> DataFrame:
    """Application variant: not found, (3 confirmed and >= 50% full), conflict with confirmed,
    conflict with cart, in cart, registered. Conflict messages name the first clashing session."""
    c = F.col
    booked = F.coalesce(c("booked_seats"), F.lit(0))
    total = c("total_seats")
    # (booked / total) * 100 >= 50 with JS number semantics: 0/0 is NaN (false), x/0 is Infinity (true)
    half = F.coalesce((booked * 2 >= total) & ~((total == 0) & (booked == 0)), F.lit(False))
    return _decide(facts, [
        (~c("found"), FAILED, MSG_NOT_FOUND),
        ((c("confirmed_count") >= LIMIT) & half, FAILED, MSG_JS_LIMIT),
        (c("conflict_count") > 0, FAILED, F.concat(F.lit(MSG_JS_CONFLICT), c("conflict_name"))),
        (c("cart_conflict_count") > 0, FAILED, F.concat(F.lit(MSG_JS_CART_CONFLICT), c("cart_conflict_name"))),
        (c("in_cart"), FAILED, MSG_IN_CART),
        (c("registered"), FAILED, MSG_REGISTERED),
    ], MSG_JS_ADDED)


def _earliest_before(probes: DataFrame, rows: DataFrame, with_name: bool = False) -> DataFrame:
    """For each probe (request_id, user_id, date, start, end, _ord): the earliest row of
    ``rows`` (same user and date, overlapping, strictly earlier ``_ord``), or nothing.

    ``rows`` is first reduced to its distinct intervals per (user, date), each keeping its
    earliest row, so the overlap join is bounded by distinct intervals, not by row count.
    """
    payload = F.struct("_ord", "event_name") if with_name else F.struct("_ord")
    summ = rows.groupBy("user_id", *INTERVAL).agg(F.min(payload).alias("m"))
    p = probes.select("request_id", "user_id", *INTERVAL, "_ord")
    pairs = overlap_pairs(p, summ, ["user_id", "event_date"], ["user_id", "event_date"],
                          extra=lambda a, b: b["r_m._ord"] < a["l__ord"], odd_right=has_odd(rows))
    return pairs.groupBy(F.col("l_request_id").alias("request_id")).agg(F.min("r_m").alias("m"))


class TakenIntervals:
    """The accepted intervals of one user and date. Those with start < end are disjoint, so sorted they are searched by bisection."""

    def __init__(self):
        self.starts, self.ends, self.odd = [], [], []

    def see(self, date, start: str | None, end: str | None) -> bool:
        if date is None or start is None or end is None:
            return True  # compares with nothing
        proper = start < end
        if proper:
            i = bisect_left(self.starts, end)  # the accepted ones that start before this one ends
            meets = i > 0 and self.ends[i - 1] > start  # the last of them ends last
        else:
            meets = any(s < end and start < e for s, e in zip(self.starts, self.ends, strict=True))
        if meets or any(s < end and start < e for s, e in self.odd):
            return False
        if proper:
            i = bisect_left(self.starts, start)
            self.starts.insert(i, start)
            self.ends.insert(i, end)
        else:
            self.odd.append((start, end))
        return True


def ordered(requests: DataFrame, sessions: DataFrame, registrations: DataFrame, cart: DataFrame) -> DataFrame:
    """In-order application-style admission: requests of a user are applied by (ts,
    request_id) and an accepted request joins the cart the later ones are checked against.

    Only the cart guards depend on earlier decisions, and only through requests of the
    same user that overlap in time (same date) or name the same session. Of the requests of a user for one
    interval (or, where its start is not before its end, for one session) only the first can be accepted: the
    later ones meet it, or what it was rejected for. So the candidates are at most as many per user and date as there are
    intervals, whatever the number of requests, and one ordered pass per (user, date) decides them against the
    accepted intervals it holds; a chain of requests that each wait for the one before takes no longer. Requests
    without a date or a time overlap nothing.
    """
    c = F.col
    f = admission_facts(requests, sessions, registrations, cart).join(requests.select("request_id", "ts"), "request_id")
    booked = F.coalesce(c("booked_seats"), F.lit(0))
    half = F.coalesce((booked * 2 >= c("total_seats")) & ~((c("total_seats") == 0) & (booked == 0)), F.lit(False))
    static = (F.when(~c("found"), F.lit(MSG_NOT_FOUND))
              .when((c("confirmed_count") >= LIMIT) & half, F.lit(MSG_JS_LIMIT))
              .when(c("conflict_count") > 0, F.concat(F.lit(MSG_JS_CONFLICT), c("conflict_name"))))
    f = f.withColumn("_static", static).withColumn("_ord", F.struct("ts", "request_id"))
    f = cut_lineage(f)
    p13 = f.filter(c("_static").isNull())
    cand = p13.filter((c("cart_conflict_count") == 0) & ~c("in_cart") & ~c("registered"))

    cols = ["request_id", "user_id", "event_id", "event_name", *INTERVAL, "_ord"]
    meets_itself = F.coalesce(c("start_time") < c("end_time"), F.lit(False)) & c("event_date").isNotNull()
    alike = F.struct(F.when(~meets_itself, c("event_id")).alias("event"), "event_date", *[F.when(meets_itself, c(t)).alias(t) for t in INTERVAL[1:]])
    first = cand.groupBy("user_id", alike.alias("_alike")).agg(F.min(F.struct("_ord", *[x for x in cols if x not in ("_ord", "user_id")])).alias("m")) \
        .select("user_id", "m.*").select(*cols)
    group = F.concat_ws("|", c("user_id").cast("string"), F.coalesce(c("event_date").cast("string"), F.lit("-")))
    walked = ordered_pass(first.withColumn("_group", group).withColumn("ts", c("_ord.ts")).drop("_ord"), "_group",
                          [c("ts").asc_nulls_first(), c("request_id").asc()],
                          ["event_date", "start_time", "end_time"], TakenIntervals, "_accepted", "boolean")
    acc = cut_lineage(walked.filter("_accepted").withColumn("_ord", F.struct("ts", "request_id")).select(*cols))
    first_acc_ov = _earliest_before(p13, acc, with_name=True).select("request_id", F.col("m").alias("_ov"))
    acc_same = acc.groupBy("user_id", "event_id").agg(F.min("_ord").alias("_acc_ord"))
    g = (f.join(first_acc_ov, "request_id", "left").join(acc_same, ["user_id", "event_id"], "left"))
    msg = (F.when(c("_static").isNotNull(), c("_static"))
           .when(c("cart_conflict_count") > 0, F.concat(F.lit(MSG_JS_CART_CONFLICT), c("cart_conflict_name")))
           .when(c("_ov").isNotNull(), F.concat(F.lit(MSG_JS_CART_CONFLICT), c("_ov.event_name")))
           .when(c("in_cart") | F.coalesce(c("_acc_ord") < c("_ord"), F.lit(False)), F.lit(MSG_IN_CART))
           .when(c("registered"), F.lit(MSG_REGISTERED)))
    return g.select("request_id", "user_id", "event_id", F.when(msg.isNull(), SUCCESS).otherwise(FAILED).alias("status"),
                    F.coalesce(msg, F.lit(MSG_JS_ADDED)).alias("message"))
