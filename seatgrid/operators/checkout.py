"""Checkout: a table of checkout requests in, decisions and new table state out.

Checkouts are decided as if run one by one in (ts, checkout_id) order. Within one user,
what a checkout sees changes only at that user's first booking (the cart is emptied), and
seats only ever run out, so a user's decisive checkout is the first one that passes the
user's own guards: if its seats are gone, so they are for every later one. Across users
the decisive checkouts compete for seats; ``race`` decides that component by component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatgrid.operators.components import connected_components
from seatgrid.operators.lookups import INTERVAL
from seatgrid.operators.overlap import overlap_pairs
from seatgrid.operators.ranking import ordered_positions, positions_from_tags, tag_ranges
from seatgrid.operators.scan import ordered_pass
from seatgrid.session import cut_lineage

LIMIT = 3
WALK_ROWS = 1_000_000  # asks of a component that one ordered pass may decide
# Messages of the checkout variants.
MSG = {
    "ora": {"limit": "You can only register for maximum 3 events", "ok": "Registration completed successfully. Payment received: ",
            "error": "Cannot exceed total seat capacity"},
    "package": {"limit": "Maximum 3 registrations allowed", "ok": "Payment successful. Total: ",
                "error": "Cannot exceed total seat capacity"},
    "pg": {"limit": "Maximum 3 registrations allowed", "ok": "Payment successful! Total: ₹",
           "error": "Cannot exceed total seat capacity!"},
}
MSG_PAYMENT = "Payment failed. Please try again."
MSG_EMPTY = "Cart is empty"
MSG_JS_OK = "Payment successful! Registration completed."
MSG_JS_LIMIT = "You can only register for maximum 3 events. You already have %d confirmed registrations and trying to add %d more."
MSG_JS_CONFLICT, MSG_JS_WITH = "Time conflict: ", " conflicts with your confirmed event "
MSG_JS_CART_CONFLICT, MSG_JS_AND = "Time conflict between cart items: ", " and "
MSG_JS_FULL, MSG_JS_FULL_END = "Event ", " is fully booked"
MSG_CAPACITY = "Cannot exceed total seat capacity"


def _order(prefix: str = "") -> Column:
    return F.struct(F.col(prefix + "ts"), F.col(prefix + "checkout_id"))


def cart_facts(cart: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per user: cart rows, joined items and total price."""
    s = sessions.select("event_id", "event_name", "ticket_price")
    per = cart.select("user_id", "event_id").join(s, "event_id", "left")
    return per.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("cart_rows"), F.count("event_name").alias("cart_items"), F.sum("ticket_price").alias("cart_total"))


def _reg_count(registrations: DataFrame, variant: str) -> DataFrame:
    if variant == "pg":
        r = registrations.filter(F.col("payment_status") == "COMPLETED")
    else:
        r = registrations.filter((F.col("registration_status") == "CONFIRMED") & (F.col("payment_status") == "COMPLETED"))
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("reg_count"))


class SeatWalk:
    """Seats taken in the sessions of one component, checkout by checkout. A row is a checkout's ask for one session, with the
    verdict of a checkout that is decided and the number of its asks; the answer of the last of them is whether it wins."""

    def __init__(self):
        self.taken, self.asked, self.fits = {}, [], True

    def see(self, event_id: int, seats_left: int, st: str, asks: int) -> str:
        n = self.taken.get(event_id, 0)
        self.asked.append(event_id)
        self.fits = self.fits and n < seats_left
        if len(self.asked) < asks:
            return ""
        wins = st == "A" or self.fits
        if wins:
            for e in self.asked:
                self.taken[e] = self.taken.get(e, 0) + 1
        self.asked, self.fits = [], True
        return "A" if wins else "R"


def _scarce(it: DataFrame) -> DataFrame:
    """The rows of sessions that more live checkouts ask for than they have seats; in the others nobody loses."""
    need = it.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"), F.min("seats_left").alias("_s")).filter("_n > _s").select("event_id")
    return it.join(need, "event_id", "left_semi")


def race(firsts: DataFrame, cart: DataFrame, sessions: DataFrame, walk_rows: int = WALK_ROWS) -> DataFrame:
    """The competition for seats: firsts (user_id, checkout_id, ts), one decisive checkout per user, to
    (checkout_id, won). A checkout takes a seat in every session of its cart or in none, in (ts, checkout_id) order.

    A checkout that asks for a session without a seat loses whatever the order and leaves the race first. After that
    only sessions that more checkouts ask for than they have seats decide anything. They tie checkouts into connected
    components. A component of at most ``walk_rows`` asks is decided in one ordered pass that holds its seat counts (so a chain,
    where each checkout waits for the one before, takes one pass). A larger one first goes through a round of votes: per ask, the
    accepted and the live (accepted or undecided) checkouts before it in its session are counted by range-partitioned running counts.
    A checkout loses once an ask has no seat left after the accepted ones before it, and wins once every ask
    has one even after all live ones before it. What that leaves falls into components again. The earliest undecided
    checkout always decides; a round that decides nothing is an error.
    """
    left = sessions.select("event_id", (F.col("total_seats") - F.coalesce(F.col("booked_seats"), F.lit(0))).alias("seats_left"))
    items = firsts.join(cart.select("user_id", "event_id"), "user_id").join(left, "event_id").filter(F.col("seats_left").isNotNull())
    order = [F.col("ts").asc_nulls_first(), F.col("checkout_id").asc()]
    cols = ["checkout_id", "ts", "event_id", "seats_left", "st"]
    asks = cut_lineage(items.select("checkout_id", "ts", "event_id", "seats_left", F.lit("U").alias("st")))
    # an ask for a session without a seat loses whatever the order, and takes no seat from others
    doomed = cut_lineage(asks.filter("seats_left <= 0 AND checkout_id IS NOT NULL").select("checkout_id").distinct())
    it = cut_lineage(_scarce(asks.join(doomed, "checkout_id", "left_anti")))
    decided, undecided = [doomed.withColumn("now", F.lit("R"))], it.select("checkout_id").distinct().count()
    while undecided:
        # an undecided checkout ties its sessions together; asks of decided ones go with their session
        edges = it.filter("st = 'U'").select(F.concat(F.lit("c"), F.col("checkout_id").cast("string")).alias("a"),
                                             F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("b"))
        part = connected_components(edges).filter("n LIKE 's%'").select(F.expr("CAST(substring(n, 2) AS BIGINT)").alias("event_id"), "c")
        tied = cut_lineage(it.join(part, "event_id"))
        few = tied.groupBy("c").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= walk_rows).select("c")
        small = tied.join(few, "c", "left_semi")
        # a session that is there twice is asked for twice, so asks are counted and none is marked as the last
        n_asks = F.count(F.lit(1)).over(Window.partitionBy("c", "checkout_id"))
        walked = ordered_pass(small.withColumn("asks", n_asks), "c", [*order, F.col("event_id")],
                              ["event_id", "seats_left", "st", "asks"], SeatWalk, "now", "string")
        walked = cut_lineage(walked.filter("now <> '' AND st = 'U'").select("checkout_id", "now"))
        decided.append(walked)
        rest = tied.join(few, "c", "left_anti").select(*cols)
        if not rest.isEmpty():
            pos = positions_from_tags(tag_ranges(rest, order, ["event_id"]), order, ["event_id"],
                                      {"_acc": (F.col("st") == "A").cast("int"), "_live": F.lit(1)})
            votes = pos.filter(F.col("st") == "U").groupBy("checkout_id").agg(
                F.max(F.col("_before_acc") >= F.col("seats_left")).alias("lost"), F.min(F.col("_before_live") < F.col("seats_left")).alias("fits"))
            votes = cut_lineage(votes.select("checkout_id", F.when(F.col("lost"), "R").when(F.col("fits"), "A").otherwise("U").alias("now")))
            decided.append(votes.filter("now <> 'U'"))
            nxt = rest.join(votes, "checkout_id", "left").withColumn("st", F.coalesce("now", "st")).drop("now").filter("st <> 'R'")
            open_sessions = nxt.filter("st = 'U'").select("event_id").distinct()
            # winners stay as asks before others; a checkout whose sessions have become plentiful has won
            it = cut_lineage(_scarce(nxt.join(open_sessions, "event_id", "left_semi").select(*cols)))
        else:
            it = rest
        still = it.filter("st = 'U'").select("checkout_id").distinct().count()
        if still >= undecided:
            raise RuntimeError(f"{still} checkouts can't be decided")
        undecided = still
    won = firsts.select("checkout_id")
    lost = decided[0]
    for verdicts in decided[1:]:
        lost = lost.unionByName(verdicts)
    lost = lost.filter("now = 'R'").select("checkout_id", F.lit(False).alias("won"))
    return won.join(lost, "checkout_id", "left").withColumn("won", F.coalesce("won", F.lit(True)))  # no scarce ask: nothing to lose


def _decisive(base: DataFrame, passes: Column) -> DataFrame:
    """Each user's first checkout that passes: user_id, ts, checkout_id."""
    first = base.filter(passes).groupBy("user_id").agg(F.min(_order()).alias("f"))
    return first.select("user_id", F.col("f.ts").alias("ts"), F.col("f.checkout_id").alias("checkout_id"))


def _with_outcome(base: DataFrame, firsts: DataFrame, won: DataFrame) -> DataFrame:
    """base with books (this checkout books the cart) and after (an earlier one of the user did)."""
    f = firsts.join(won, "checkout_id").select("user_id", F.struct("ts", "checkout_id").alias("_first"), "won")
    j = base.join(f, "user_id", "left")
    hit = F.coalesce(F.col("won"), F.lit(False))
    return j.withColumn("books", hit & F.coalesce(_order() == F.col("_first"), F.lit(False))) \
        .withColumn("after", hit & F.coalesce(_order() > F.col("_first"), F.lit(False)))


def decision(checkouts: DataFrame, cart: DataFrame, sessions: DataFrame, registrations: DataFrame,
             variant: str = "ora") -> DataFrame:
    """Procedure-style checkout (``ora``, ``package`` or ``pg``), one decision per checkout.

    Order of guards: registrations + cart rows > 3; payment (``ora`` only); a session
    with no seat left aborts the whole checkout (ERROR, nothing changes). The first
    passing checkout books the cart; later ones find it empty (total 0).
    """
    m = MSG[variant]
    pay = F.coalesce(F.col("payment_ok"), F.lit(False)) if variant == "ora" else F.lit(True)
    base = (checkouts.select("checkout_id", "user_id", "ts", "payment_ok")
            .join(_reg_count(registrations, variant), "user_id", "left")
            .join(cart_facts(cart, sessions), "user_id", "left"))
    limit_fail = F.coalesce(F.col("reg_count"), F.lit(0)) + F.coalesce(F.col("cart_rows"), F.lit(0)) > LIMIT
    # used by the race and again for every checkout: write it once
    base = cut_lineage(base.withColumn("_pay", pay).withColumn("_lim", limit_fail))
    firsts = cut_lineage(_decisive(base, F.col("_pay") & ~F.col("_lim")))
    j = _with_outcome(base, firsts, race(firsts, cart, sessions))
    books, after = F.col("books"), F.col("after")
    total = F.when(books, F.coalesce(F.col("cart_total"), F.lit(0).cast("decimal(20,2)"))) \
        .when(after & F.col("_pay"), F.lit(0).cast("decimal(20,2)"))
    status = (F.when(after, F.when(F.col("_pay"), "SUCCESS").otherwise("FAILED"))
              .when(F.col("_lim"), "FAILED").when(~F.col("_pay"), "FAILED")
              .when(books, "SUCCESS").otherwise("ERROR"))
    ok_msg = F.concat(F.lit(m["ok"]), total.cast("decimal(18,2)").cast("string"))
    message = (F.when(after, F.when(F.col("_pay"), ok_msg).otherwise(MSG_PAYMENT))
               .when(F.col("_lim"), m["limit"]).when(~F.col("_pay"), MSG_PAYMENT)
               .when(books, ok_msg).otherwise(m["error"]))
    return j.select("checkout_id", "user_id", status.alias("status"), message.alias("message"),
                    total.alias("total_amount"),
                    F.when(books, F.coalesce(F.col("cart_items"), F.lit(0))).otherwise(F.lit(0)).alias("items"))


def apply_registrations(decisions: DataFrame, checkouts: DataFrame, cart: DataFrame, sessions: DataFrame) -> DataFrame:
    """New registrations from booking checkouts: one COMPLETED / CONFIRMED row per cart item."""
    booked = decisions.filter(F.col("items") > 0).select("checkout_id", "user_id") \
        .join(checkouts.select("checkout_id", "payment_method"), "checkout_id")
    items = booked.join(cart.select("user_id", "event_id"), "user_id") \
        .join(sessions.select("event_id", "ticket_price"), "event_id")
    return items.select("checkout_id", "user_id", "event_id", F.lit("COMPLETED").alias("payment_status"),
                        F.lit("CONFIRMED").alias("registration_status"), "payment_method",
                        F.col("ticket_price").alias("amount_paid"))


def apply_seats(sessions: DataFrame, new_registrations: DataFrame) -> DataFrame:
    """Seat counts after booking: booked + new registrations, per touched session; an overbooked one is an error."""
    add = new_registrations.groupBy("event_id").agg(F.count(F.lit(1)).alias("added"))
    j = add.join(sessions.select("event_id", "total_seats", "booked_seats"), "event_id")
    j = j.filter(F.when(F.col("booked_seats") + F.col("added") > F.col("total_seats"), F.raise_error(F.lit(MSG_CAPACITY)))
                 .otherwise(F.lit(True)))
    return j.select("event_id", "total_seats", F.col("booked_seats").alias("booked_before"), "added",
                    (F.col("booked_seats") + F.col("added")).alias("booked_after"))


def apply_sessions(sessions: DataFrame, new_registrations: DataFrame) -> DataFrame:
    """The whole sessions table after booking (seat counts raised by the new registrations)."""
    add = new_registrations.groupBy("event_id").agg(F.count(F.lit(1)).alias("_add"))
    j = sessions.join(add, "event_id", "left")
    j = j.filter(F.when(F.col("booked_seats") + F.col("_add") > F.col("total_seats"), F.raise_error(F.lit(MSG_CAPACITY)))
                 .otherwise(F.lit(True)))
    return j.select(*[(F.col(c) + F.coalesce(F.col("_add"), F.lit(0))).cast("int").alias(c) if c == "booked_seats"
                      else F.col(c) for c in sessions.columns])


def apply_cart(cart: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cart rows left after booking: a booking checkout empties its user's cart."""
    booked = decisions.filter(F.col("items") > 0).select("user_id")
    return cart.join(booked, "user_id", "left_anti")


# ---------------------------------------------------------------- application-style validation

def validate(checkouts: DataFrame, cart: DataFrame, sessions: DataFrame, registrations: DataFrame) -> DataFrame:
    """Application checkout, one decision per checkout: empty cart, limit (confirmed + cart > 3), cart x
    confirmed conflict, cart x cart conflict, a session fully booked by then, payment, then book.

    Conflict messages name the first clashing pair in loop order (cart by cart_id,
    confirmed by reg_id). Each cart item is compared with distinct-interval summaries
    (per user and date) of the confirmed rows and of the cart, never with every row.
    """
    s = sessions.select("event_id", "event_name", *INTERVAL, "total_seats", "booked_seats")
    # the cart with its sessions is used five times; only users with a cart are compared with what they hold
    items = cut_lineage(cart.select("cart_id", "user_id", "event_id").join(s, "event_id"))
    conf = cut_lineage(registrations.filter(F.col("registration_status") == "CONFIRMED").select("reg_id", "user_id", "event_id")
                       .join(items.select("user_id"), "user_id", "left_semi").join(s, "event_id"))

    per_user = items.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_cart"))
    n_conf = conf.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_conf"))

    # cart x confirmed: for each cart item the first overlapping confirmed registration, found
    # against the confirmed rows reduced to distinct intervals per (user, date)
    # only (user, date) pairs that some cart item is on
    conf = conf.join(items.select("user_id", "event_date"), ["user_id", "event_date"], "left_semi")
    summ = conf.groupBy("user_id", *INTERVAL).agg(F.min(F.struct("reg_id", "event_name")).alias("m"))
    a = items.select("cart_id", "user_id", "event_name", *INTERVAL)
    cx = overlap_pairs(a, summ, ["user_id", "event_date"], ["user_id", "event_date"])
    per_item = cx.groupBy(F.col("l_user_id").alias("user_id"), F.col("l_cart_id").alias("cart_id"),
                          F.col("l_event_name").alias("name")).agg(F.min("r_m").alias("m"))
    c1 = per_item.groupBy("user_id").agg(F.min(F.struct("cart_id", "m.reg_id", "name", "m.event_name")).alias("cc")) \
        .select("user_id", F.struct(F.col("cc.name").alias("l_event_name"),
                                    F.col("cc.event_name").alias("r_event_name")).alias("cc"))
    # cart x cart, first pair (i < j) in loop order: e(j) = earliest cart item before j that
    # overlaps it; i* = min e(j); j* = min j with e(j) = i* (no pair list per user)
    csumm = items.groupBy("user_id", *INTERVAL).agg(F.min(F.struct("cart_id", "event_name")).alias("m"))
    xx = overlap_pairs(a, csumm, ["user_id", "event_date"], ["user_id", "event_date"],
                       extra=lambda l, r: r["r_m.cart_id"] < l["l_cart_id"])
    e = xx.groupBy(F.col("l_user_id").alias("user_id"), F.col("l_cart_id").alias("j"),
                   F.col("l_event_name").alias("j_name")).agg(F.min("r_m").alias("i"))
    c2 = e.groupBy("user_id").agg(F.min(F.struct("i.cart_id", "i.event_name", "j", "j_name")).alias("kk")) \
        .select("user_id", F.struct(F.col("kk.event_name").alias("l_event_name"),
                                    F.col("kk.j_name").alias("r_event_name")).alias("kk"))

    base = (checkouts.select("checkout_id", "user_id", "ts", "payment_ok")
            .join(per_user, "user_id", "left").join(n_conf, "user_id", "left")
            .join(c1, "user_id", "left").join(c2, "user_id", "left"))
    nc = F.coalesce(F.col("n_cart"), F.lit(0))
    nf = F.coalesce(F.col("n_conf"), F.lit(0))
    static = (F.when(nc == 0, F.lit(MSG_EMPTY))
              .when(nf + nc > LIMIT, F.format_string(MSG_JS_LIMIT, nf, nc))
              .when(F.col("cc").isNotNull(), F.concat(F.lit(MSG_JS_CONFLICT), F.col("cc.l_event_name"),
                                                       F.lit(MSG_JS_WITH), F.col("cc.r_event_name")))
              .when(F.col("kk").isNotNull(), F.concat(F.lit(MSG_JS_CART_CONFLICT), F.col("kk.l_event_name"),
                                                       F.lit(MSG_JS_AND), F.col("kk.r_event_name"))))
    pay = F.coalesce(F.col("payment_ok"), F.lit(False))
    # used by the race, the seat check and again for every checkout: write it once
    base = cut_lineage(base.withColumn("_static", static).withColumn("_pay", pay))
    firsts = cut_lineage(_decisive(base, F.col("_static").isNull() & F.col("_pay")))
    won = cut_lineage(race(firsts, cart, sessions))
    # the first session without a seat at the time of each checkout that gets that far, paid or not
    asks = base.filter(F.col("_static").isNull()).select("checkout_id", "user_id", "ts").join(won.filter("won"), "checkout_id", "left")
    # JS: null seats compare as 0
    seats = items.select("user_id", "cart_id", "event_id", "event_name",
                         (F.col("total_seats") - F.coalesce(F.col("booked_seats"), F.lit(0))).alias("seats_left"))
    asked = ordered_positions(asks.join(seats, "user_id"), [F.col("ts").asc_nulls_first(), F.col("checkout_id").asc(), F.col("cart_id").asc()],
                              keys=["event_id"], weight=F.coalesce(F.col("won"), F.lit(False)).cast("int"))
    full = asked.filter(F.coalesce(F.col("_before") >= F.col("seats_left"), F.lit(False))).groupBy("checkout_id") \
        .agg(F.min(F.struct("cart_id", "event_name")).alias("first_full"))
    j = _with_outcome(base, firsts, won).join(full, "checkout_id", "left")
    message = (F.when(F.col("after"), F.lit(MSG_EMPTY)).when(F.col("_static").isNotNull(), F.col("_static"))
               .when(F.col("first_full").isNotNull(), F.concat(F.lit(MSG_JS_FULL), F.col("first_full.event_name"), F.lit(MSG_JS_FULL_END)))
               .when(~F.col("_pay"), MSG_PAYMENT).otherwise(MSG_JS_OK))
    return j.select("checkout_id", "user_id", F.when(F.col("books"), "SUCCESS").otherwise("FAILED").alias("status"),
                    message.alias("message"), F.when(F.col("books"), nc).otherwise(F.lit(0)).alias("items"))


# ---------------------------------------------------------------- competing checkouts

def all_or_nothing(checkouts: DataFrame, cart: DataFrame, sessions: DataFrame, registrations: DataFrame,
                   limit: int | None = LIMIT) -> DataFrame:
    """One row per checkout: ACCEPTED when it books its whole cart, in (ts, checkout_id) order, else REJECTED (payment,
    limit, no seat, or the cart is already booked). ``limit=None`` drops the registration limit and keeps only the seat race.
    """
    base = checkouts.select("checkout_id", "user_id", "ts", "payment_ok").join(cart_facts(cart, sessions), "user_id", "left")
    ok = F.coalesce(F.col("payment_ok"), F.lit(False))
    if limit is not None:  # nothing else needs what a user holds
        base = base.join(_reg_count(registrations, "ora"), "user_id", "left")
        ok = ok & (F.coalesce(F.col("reg_count"), F.lit(0)) + F.coalesce(F.col("cart_rows"), F.lit(0)) <= limit)
    base = cut_lineage(base.withColumn("_ok", ok))
    firsts = cut_lineage(_decisive(base, F.col("_ok")))
    j = _with_outcome(base, firsts, race(firsts, cart, sessions))
    return j.select("checkout_id", "user_id", F.when(F.col("books"), "ACCEPTED").otherwise("REJECTED").alias("status"),
                    F.when(F.col("books"), F.coalesce(F.col("cart_items"), F.lit(0))).otherwise(F.lit(0)).alias("items"))
