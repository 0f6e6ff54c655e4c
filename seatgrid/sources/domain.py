"""Domain tables derived from the driver's parquet tables.

users <- customer, sessions <- part, registrations <- lineitem x orders,
cart / admission requests / cancellations <- clickstream ``events``.
Every table is a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatgrid.functions.rules import pair_key
from seatgrid.session import cut_lineage

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# Fixed values of the derivation: the base date of the session calendar and the number of sessions
# on each date (the calendar grows with the sessions, so a date stays as full at any size).
SESSION_BASE_DATE = "2024-01-01"
SESSIONS_A_DAY = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hour_text(hour: Column, minutes: str) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(minutes))


def click_key(props: Column) -> Column:
    """The session id a clickstream row points at: ``props`` is ``{"k": n}``."""
    return F.get_json_object(props, "$.k").try_cast("bigint")  # malformed -> NULL (ANSI-safe)


DERIVED = ["users", "base_sessions", "registrations", "sessions", "cart", "requests", "checkouts",
           "cancellations", "removals", "user_signups", "shop_registrations", "shop_sessions", "shop_cart", "shop_checkouts"]


class Domain:
    """Lazily derived domain DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def materialize(self, target: str) -> "Domain":
        """Write every derived table once (parquet under ``target``) and return a Domain
        that reads them: the warehouse form, so reports don't re-derive registrations."""
        d = Domain(self.spark, self.sf_dir)
        for name in DERIVED:  # dependency order: later tables read the stored earlier ones
            getattr(d, name).write.mode("overwrite").parquet(f"{target}/{name}")
            d.__dict__[name] = self.spark.read.parquet(f"{target}/{name}")
        return StoredDomain(self.spark, self.sf_dir, target)

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("full_name"),
            F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_nationkey") == 0, "ADMIN").otherwise("USER").alias("user_type"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        """Users with the day they came (of their first order; null without one) and a phone number made of nation and id."""
        first = self.raw("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderdate").cast("date").alias("created_date"))
        nation = self.raw("customer").select(F.col("c_custkey").alias("user_id"), F.format_string(
            "+%d-%09d", F.col("c_nationkey") + 10, F.col("c_custkey")).alias("phone"))
        return self.users.join(nation, "user_id").join(first, "user_id", "left")

    @cached_property
    def base_sessions(self) -> DataFrame:
        p = self.raw("part")
        size = F.col("p_size") % 10
        return p.select(
            F.col("p_partkey").alias("event_id"),
            F.col("p_name").alias("event_name"),
            F.date_add(F.lit(SESSION_BASE_DATE).cast("date"), F.expr(f"p_partkey div {SESSIONS_A_DAY}").cast("int")).alias("event_date"),
            _hour_text(8 + size, ":00").alias("start_time"),
            _hour_text(9 + size + F.col("p_partkey") % 3, ":30").alias("end_time"),
            (10 + F.col("p_size")).cast("int").alias("total_seats"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("ticket_price"),
            F.when(F.col("p_type") == "PROMO", "CANCELLED")
            .when(F.col("p_type") == "SMALL", "COMPLETED")
            .otherwise("ACTIVE")
            .alias("event_status"),
        )

    @cached_property
    def registrations(self) -> DataFrame:
        """One registration per (user, session): the first order line by a total order.

        ``min(struct(order keys..., payload...))`` is taken per order first, where the join left its rows, then per key
        with a map-side partial step, so a hot (user, session) key never lands whole in one task. Two orders differ in date
        or number, so the columns that only lines of one order are told apart by stay behind.
        """
        li = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus")
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        j = li.join(o, li.l_orderkey == o.o_orderkey)
        of_order = j.groupBy("l_orderkey", "o_custkey", "l_partkey").agg(
            F.min(F.struct(
                "o_orderdate", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_shipdate", "l_suppkey", "l_returnflag", "l_linestatus", "o_orderstatus")).alias("f"))
        # what becomes of a line, as one small number
        rf, ls, os_ = F.col("f.l_returnflag"), F.col("f.l_linestatus"), F.col("f.o_orderstatus")
        paid = F.when(rf == "R", 0).when(os_ == "P", 1).when((os_ == "O") & (rf == "A"), 2).otherwise(3)
        state = F.when(rf == "R", 0).when((ls == "O") & (rf == "A"), 1).otherwise(2)
        first = of_order.groupBy("o_custkey", "l_partkey").agg(F.min(F.struct(
            "f.o_orderdate", "l_orderkey", "f.l_extendedprice", (4 * state + paid).cast("tinyint").alias("code"))).alias("f"))
        paid, state = F.col("f.code") % 4, F.expr("f.code div 4")
        regs = first.select(
            pair_key(F.col("o_custkey"), F.col("l_partkey")).alias("reg_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("event_id"),
            F.col("f.o_orderdate").cast("date").alias("registration_date"),
            F.when(paid == 0, "REFUNDED").when(paid == 1, "PENDING").when(paid == 2, "FAILED").otherwise("COMPLETED").alias("payment_status"),
            F.when(state == 0, "CANCELLED").when(state == 1, "WAITLIST").otherwise("CONFIRMED").alias("registration_status"),
            F.col("f.l_extendedprice").cast("decimal(10,2)").alias("amount_paid"),
        )
        # Used several times by most queries, each with different pruning, so Spark would
        # re-derive it per use: write it once to the shared checkpoint directory instead.
        return cut_lineage(regs)

    @cached_property
    def completed_per_session(self) -> DataFrame:
        return (self.registrations.filter(F.col("payment_status") == "COMPLETED")
                .groupBy("event_id").agg(F.count(F.lit(1)).alias("n")))

    @cached_property
    def sessions(self) -> DataFrame:
        """Sessions with seat counts: booked = completed registrations, capped at capacity.

        ``raw_booked`` keeps the uncapped count for the overbooking check.
        """
        s = self.base_sessions
        k = self.completed_per_session
        j = s.join(k, "event_id", "left")
        n = F.coalesce(F.col("n"), F.lit(0))
        return cut_lineage(j.select(
            *[s[c] for c in s.columns],
            F.least(F.col("total_seats"), n).cast("int").alias("booked_seats"),
            n.cast("bigint").alias("raw_booked"),
        ))

    def _clicks(self, event_type: str) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == event_type)
        return e.select(
            "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
            "value", click_key(F.col("props")).alias("k"))

    @cached_property
    def cart(self) -> DataFrame:
        """First click per (user, session) is the cart row."""
        c = self._clicks("click")
        first = c.groupBy("user_id", "k").agg(F.min(F.struct("ts", "event_id")).alias("f"))
        return first.select(
            F.col("f.event_id").alias("cart_id"),
            "user_id",
            F.col("k").alias("event_id"),
            F.col("f.ts").cast("date").alias("added_date"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Cart-admission requests: every ``signup`` row asks to add session ``k``."""
        return self._clicks("signup").select(
            F.col("event_id").alias("request_id"), "user_id", F.col("k").alias("event_id"), "ts")

    @cached_property
    def checkouts(self) -> DataFrame:
        """Checkout requests: every ``purchase`` row; the payment outcome is an input column."""
        p = self._clicks("purchase")
        return p.select(
            F.col("event_id").alias("checkout_id"), "user_id", "ts",
            F.when(F.col("value") < 10, "UPI").when(F.col("value") < 30, "CARD").otherwise("NETBANKING").alias("payment_method"),
            (F.col("value") >= 1).alias("payment_ok"),
            F.col("k").alias("event_id"),
        )

    @cached_property
    def cancellations(self) -> DataFrame:
        """Cancellation requests: every ``error`` row names registration (user, session k)."""
        c = self._clicks("error")
        return c.select(
            F.col("event_id").alias("request_id"), "user_id",
            pair_key(F.col("user_id"), F.col("k")).alias("reg_id"), "ts")

    @cached_property
    def removals(self) -> DataFrame:
        """Cart removals: every ``view`` row names the cart row (by its id) that its user's click on
        session k made, or none (null) when there is no such row."""
        v = self._clicks("view").select(F.col("event_id").alias("request_id"), "user_id", F.col("k").alias("event_id"), "ts")
        return v.join(self.cart.select("cart_id", "user_id", "event_id"), ["user_id", "event_id"], "left") \
            .select("request_id", "user_id", "event_id", "cart_id", "ts")

    @cached_property
    def user_signups(self) -> DataFrame:
        """New-user registration requests in arrival order ``seq``.

        Supplier rows sign up new people under even numbers; under odd numbers every ``signup`` click re-sends
        the clicking customer's name and email (the duplicate-email rule), some with a blank name or email
        (the required-fields rule) and some with a fresh address that several clicks share.
        """
        s = self.raw("supplier").select(
            (2 * F.col("s_suppkey")).alias("seq"),
            F.col("s_name").alias("full_name"),
            F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        )
        clicks = self._clicks("signup").select("event_id", "user_id")
        kind = F.col("event_id") % 7
        again = clicks.join(self.users, "user_id").select(
            (2 * F.col("event_id") + 1).alias("seq"),
            F.when(kind == 1, F.lit("")).when(kind == 2, F.lit(None)).otherwise(F.col("full_name")).alias("full_name"),
            F.when(kind == 3, F.lit(None)).when(kind == 4, F.lit(""))
            .when(kind == 5, F.concat(F.lit("shared."), F.col("email"))).otherwise(F.col("email")).alias("email"))
        return s.unionByName(again).withColumnRenamed("seq", "request_id")

    # -- shop: checkouts that reach every rule. Two orders in a row (2k, 2k + 1) make one fresh user k: the lines of the
    # first are registrations, the unreturned lines of the second are the cart, and each of the two asks to check out.

    def _shop_lines(self, odd: int) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_orderdate", "o_orderstatus").filter(F.col("o_orderkey") % 2 == odd)
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
        # a user has one order of either kind, so its lines are grouped where the join left them
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")) \
            .groupBy("l_orderkey", F.col("l_partkey").alias("event_id")).agg(F.min(F.struct(
                "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "o_orderdate", "o_orderstatus")).alias("f")) \
            .select(F.expr("l_orderkey div 2").alias("user_id"), "event_id", "f")

    @cached_property
    def shop_registrations(self) -> DataFrame:
        rf, ls, os_ = F.col("f.l_returnflag"), F.col("f.l_linestatus"), F.col("f.o_orderstatus")
        return cut_lineage(self._shop_lines(0).select(
            pair_key(F.col("user_id"), F.col("event_id")).alias("reg_id"), "user_id", "event_id",
            F.col("f.o_orderdate").cast("date").alias("registration_date"),
            F.when(rf == "R", "REFUNDED").when(os_ == "P", "PENDING").otherwise("COMPLETED").alias("payment_status"),
            F.when(rf == "R", "CANCELLED").when((ls == "O") & (rf == "A"), "WAITLIST").otherwise("CONFIRMED").alias("registration_status"),
            F.col("f.l_extendedprice").cast("decimal(10,2)").alias("amount_paid")))

    @cached_property
    def shop_cart(self) -> DataFrame:
        return cut_lineage(self._shop_lines(1).filter(F.col("f.l_returnflag") == "N").select(
            pair_key(F.col("user_id"), F.col("event_id")).alias("cart_id"), "user_id", "event_id",
            F.col("f.o_orderdate").cast("date").alias("added_date")))

    @cached_property
    def shop_sessions(self) -> DataFrame:
        """The sessions in small rooms (1 to 15 seats), so that many are full or nearly so."""
        paid = self.shop_registrations.filter(F.col("payment_status") == "COMPLETED").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
        seats = (1 + F.col("total_seats") % 15).cast("int")
        return cut_lineage(self.base_sessions.join(paid, "event_id", "left").select(
            *[seats.alias(c) if c == "total_seats" else self.base_sessions[c] for c in self.base_sessions.columns],
            F.least(seats, F.coalesce(F.col("n"), F.lit(0))).cast("int").alias("booked_seats")))

    @cached_property
    def shop_requests(self) -> DataFrame:
        """Every order line as a request to add its session; some ask for a session that isn't there."""
        n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        first = self.raw("lineitem").groupBy(n.alias("request_id"), F.expr("l_orderkey div 2").alias("user_id")).agg(
            F.min("l_partkey").alias("k"), F.min("l_shipdate").alias("day"))
        return first.select("request_id", "user_id", F.when(F.col("request_id") % 23 == 5, -F.col("k")).otherwise(F.col("k")).alias("event_id"),
                            F.col("day").cast("timestamp").alias("ts"))

    @cached_property
    def shop_checkouts(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("checkout_id"), F.expr("o_orderkey div 2").alias("user_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.when(F.col("o_orderstatus") == "O", "UPI").otherwise("CARD").alias("payment_method"),
            (F.col("o_orderstatus") != "F").alias("payment_ok"))


class StoredDomain(Domain):
    """Domain whose derived tables were written by :meth:`Domain.materialize`."""

    def __init__(self, spark: SparkSession, sf_dir: str, target: str):
        super().__init__(spark, sf_dir)
        for name in DERIVED:
            self.__dict__[name] = spark.read.parquet(f"{target}/{name}")
