"""Declared constraints re-aimed as data-quality jobs: one row per (table, constraint).

Row-level rules (NOT NULL, CHECK, length) are counted in one aggregation pass per
table; UNIQUE / PRIMARY KEY rules count rows beyond the first per key (one shuffle on
the key, partial aggregation first); FOREIGN KEY rules count child rows whose
non-NULL key has no parent (anti-join). A CHECK fails only when its predicate is
FALSE: NULL passes, as in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seatgrid.functions.rules import TIME_PATTERN
from seatgrid.schema import EVENT_STATUSES, MAX_LENGTHS, PAYMENT_STATUSES, REGISTRATION_STATUSES, USER_TYPES


def not_null(c: str) -> Column:
    return F.col(c).isNull()


def check(pred: Column) -> Column:
    return F.coalesce(~pred, F.lit(False))


def too_long(c: str, n: int) -> Column:
    return F.coalesce(F.length(c) > n, F.lit(False))


def row_rules(df: DataFrame, table: str, rules: list[tuple[str, Column]]) -> DataFrame:
    counts = df.agg(*[F.count_if(v).alias(f"c{i}") for i, (_, v) in enumerate(rules)])
    stack = ", ".join(f"'{name}', c{i}" for i, (name, _) in enumerate(rules))
    return counts.selectExpr(f"'{table}' AS table_name", f"stack({len(rules)}, {stack}) AS (constraint_name, violations)")


def unique_rule(df: DataFrame, table: str, name: str, keys: list[str]) -> DataFrame:
    nn = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    dup = df.filter(nn).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return dup.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"), "violations")


def fk_rule(child: DataFrame, table: str, name: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    # children are counted per key first, so a hot key is one row at the anti-join
    c = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    p = parent.select(F.col(parent_key).alias(key))
    orphans = c.join(p, key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"), "violations")


def rules_of(table: str) -> list[tuple[str, Column]]:
    """The row-level rules of a table: name, and when a row breaks it."""
    ul, sl = MAX_LENGTHS["users"], MAX_LENGTHS["sessions"]
    return {
        "users": lambda: [
            ("pk_not_null", not_null("user_id")), ("name_not_null", not_null("full_name")),
            ("email_not_null", not_null("email")), ("user_type_check", check(F.col("user_type").isin(*USER_TYPES))),
            ("name_length", too_long("full_name", ul["full_name"])), ("email_length", too_long("email", ul["email"]))],
        "sessions": lambda: [
            ("pk_not_null", not_null("event_id")), ("name_not_null", not_null("event_name")),
            ("date_not_null", not_null("event_date")), ("start_not_null", not_null("start_time")),
            ("end_not_null", not_null("end_time")), ("seats_not_null", not_null("total_seats")),
            ("price_not_null", not_null("ticket_price")),
            ("seats_positive", check(F.col("total_seats") > 0)),
            ("booked_within_seats", check(F.col("booked_seats") <= F.col("total_seats"))),
            ("price_non_negative", check(F.col("ticket_price") >= 0)),
            ("status_check", check(F.col("event_status").isin(*EVENT_STATUSES))),
            ("name_length", too_long("event_name", sl["event_name"])),
            ("start_length", too_long("start_time", sl["start_time"])),
            ("end_length", too_long("end_time", sl["end_time"])),
            ("start_format", check(F.col("start_time").rlike(TIME_PATTERN))),
            ("end_format", check(F.col("end_time").rlike(TIME_PATTERN)))],
        "registrations": lambda: [
            ("pk_not_null", not_null("reg_id")), ("user_not_null", not_null("user_id")),
            ("event_not_null", not_null("event_id")),
            ("payment_status_check", check(F.col("payment_status").isin(*PAYMENT_STATUSES))),
            ("registration_status_check", check(F.col("registration_status").isin(*REGISTRATION_STATUSES)))],
        "cart": lambda: [
            ("pk_not_null", not_null("cart_id")), ("user_not_null", not_null("user_id")),
            ("event_not_null", not_null("event_id"))],
    }[table]()


# Name and columns of each table's UNIQUE rules; name, column, parent table and its column of its FOREIGN KEY rules.
UNIQUE = {
    "users": [("pk_unique", ["user_id"]), ("email_unique", ["email"])], "sessions": [("pk_unique", ["event_id"])],
    "registrations": [("pk_unique", ["reg_id"]), ("user_event_unique", ["user_id", "event_id"])],
    "cart": [("pk_unique", ["cart_id"]), ("user_event_unique", ["user_id", "event_id"])],
}
FOREIGN = {t: [("fk_user", "user_id", "users", "user_id"), ("fk_event", "event_id", "sessions", "event_id")] for t in ("registrations", "cart")}


def constraint_violations(users: DataFrame, sessions: DataFrame, registrations: DataFrame, cart: DataFrame) -> DataFrame:
    tables = {"users": users, "sessions": sessions, "registrations": registrations, "cart": cart}
    parts = []
    for name, df in tables.items():
        parts.append(row_rules(df, name, rules_of(name)))
        parts += [unique_rule(df, name, rule, keys) for rule, keys in UNIQUE[name]]
        parts += [fk_rule(df, name, rule, key, tables[parent], pk) for rule, key, parent, pk in FOREIGN.get(name, [])]
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_broken(df: DataFrame, table: str, parents: dict[str, DataFrame] | None = None, observe: Observation | None = None) -> DataFrame:
    """df with ``broken``: the names of the row and FOREIGN KEY rules that the row breaks, in the rules' order. One pass over the
    table: a parent is a join with its keys alone. ``observe`` collects the rows and the violations of each rule while the
    result is written, so counts and bad rows come from the same scan."""
    rules, out = list(rules_of(table)), df
    for rule, key, parent, pk in FOREIGN.get(table, []) if parents else []:
        keys = parents[parent].select(F.col(pk).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn(f"_{rule}", F.lit(True))
        out = out.join(keys, key, "left")
        rules.append((rule, F.col(key).isNotNull() & F.col(f"_{rule}").isNull()))
    out = out.withColumn("broken", F.array_compact(F.array(*[F.when(v, F.lit(name)) for name, v in rules]))).select(*df.columns, "broken")
    if observe is not None:
        out = out.observe(observe, F.count(F.lit(1)).alias("rows"), *[
            F.count_if(F.array_contains("broken", name)).alias(name) for name, _ in rules])
    return out


def quarantine(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of all tables that break a row or FOREIGN KEY rule: table_name, row_key (the primary key as text, null
    where it is), broken (the rules, comma-joined)."""
    keys = {"users": "user_id", "sessions": "event_id", "registrations": "reg_id", "cart": "cart_id"}
    parts = [with_broken(df, name, tables).filter(F.size("broken") > 0).select(
        F.lit(name).alias("table_name"), F.col(keys[name]).cast("string").alias("row_key"), F.array_join("broken", ",").alias("broken"))
        for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _bitmaps(df: DataFrame, key: str) -> DataFrame:
    """The set of a whole-number column's values: one 4 KB bitmap for 32,768 neighbouring numbers, built before the shuffle."""
    k = F.col(key).cast("bigint")
    return df.filter(k.isNotNull()).groupBy(F.bitmap_bucket_number(k).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"), F.count(F.lit(1)).alias("rows"))


def bitmap_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """UNIQUE rules of single whole-number columns (rows beyond the first of a key) and FOREIGN KEY rules (different keys without a
    parent) over bitmaps: a dense key costs a few bits in the shuffle, not a row. A key set less its parents counts as
    the two together less the parents. table_name, constraint_name, violations."""
    parts = []
    for name, df in tables.items():
        for rule, cols in UNIQUE[name]:
            if len(cols) == 1 and df.schema[cols[0]].dataType.simpleString() in ("bigint", "int"):
                b = _bitmaps(df, cols[0])
                n = b.agg(F.coalesce(F.sum(F.col("rows") - F.bitmap_count("bits")), F.lit(0)).alias("violations"))
                parts.append(n.select(F.lit(name).alias("table_name"), F.lit(rule).alias("constraint_name"), "violations"))
        for rule, key, parent, pk in FOREIGN.get(name, []):
            up = _bitmaps(tables[parent], pk).select("bucket", "bits", F.lit(True).alias("up"))
            both = _bitmaps(df, key).select("bucket", "bits", F.lit(False).alias("up")).unionByName(up).groupBy("bucket").agg(
                F.bitmap_count(F.bitmap_or_agg("bits")).alias("all"), F.coalesce(F.max(F.when(F.col("up"), F.bitmap_count("bits"))), F.lit(0)).alias("known"))
            n = both.agg(F.coalesce(F.sum(F.col("all") - F.col("known")), F.lit(0)).alias("violations"))
            parts.append(n.select(F.lit(name).alias("table_name"), F.lit(rule).alias("constraint_name"), "violations"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def overbooking_violations(sessions: DataFrame) -> DataFrame:
    """Sessions whose paid registrations exceed capacity (the overflow guard as a report)."""
    s = sessions.filter(F.col("raw_booked") > F.col("total_seats"))
    return s.select("event_id", "total_seats", F.col("raw_booked").alias("booked_seats"),
                    (F.col("raw_booked") - F.col("total_seats")).alias("excess"))


def assert_no_overbooking(sessions: DataFrame) -> DataFrame:
    """Fail-fast form: raises at execution if any session is overbooked."""
    msg = "Cannot exceed total seat capacity"
    # a filter is always evaluated (a dropped column could be pruned away)
    return sessions.filter(
        F.when(F.col("raw_booked") > F.col("total_seats"), F.raise_error(F.lit(msg))).otherwise(F.lit(True)))
