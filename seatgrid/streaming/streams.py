"""Row triggers re-aimed over a stream of registrations / cart clicks (Structured Streaming).

* seat counter   -> streaming ``groupBy(event_id).count()`` (update mode: a batch writes
                    the sessions it changed, the newest row of a session counts)
* audit log      -> inserts: a stateless projection, appended per micro-batch; updates: the latest
                    status per registration as keyed state, so a change gives (old, new)
* waitlist       -> ``foreachBatch``: rank within session in the batch + seats already
                    used (a versioned state table)
* duplicate cart -> ``foreachBatch``: first click per (user, session) in the batch,
                    anti-joined with the keys already seen (versioned state table); or
                    ``dropDuplicatesWithinWatermark`` for the bounded-delay approximation

A run takes a base path: its checkpoint, output and state live there, so a run that is started
again over the same path goes on where the last one stopped. Without a path a run is on its own
(a fresh path under the checkpoint directory). Every micro-batch writes to directories named
by its batch id (overwrite), so a retried batch replaces its own output and never duplicates
it. State is kept in parts compacted by key (:class:`BatchState`); a batch lists none of them and
parts that others have taken in are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatgrid.operators.asof import carry_last
from seatgrid.operators.changes import assign_ids as batch_ids
from seatgrid.operators.ranking import ordered_positions
from seatgrid.session import cut_lineage, scratch_path
from seatgrid.sources.domain import click_key
from seatgrid.sources.snapshots import read_if_there
from seatgrid.streaming.state import BatchState

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def click_stream(spark: SparkSession, source: str, glob: str = "events*.parquet", max_files: int | None = None) -> DataFrame:
    """The clickstream as a streaming DataFrame over parquet files in ``source``."""
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    e = r.parquet(source)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
                    click_key(F.col("props")).alias("k"))


def registration_stream(clicks: DataFrame) -> DataFrame:
    """Registration inserts: every ``purchase`` click registers its user for session k."""
    p = clicks.filter(F.col("event_type") == "purchase")
    return p.select(F.col("event_id").alias("reg_id"), "user_id", F.col("k").alias("event_id"), "ts",
                    F.when(F.col("value") >= 1, "COMPLETED").otherwise("FAILED").alias("payment_status"),
                    F.lit("CONFIRMED").alias("registration_status"))


def _run(writer, base: str) -> None:
    q = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All batch directories under ``out`` (the batch-id partition column is dropped)."""
    df = read_if_there(spark, out, schema)
    if df is None:  # no batch written yet
        return spark.createDataFrame([], schema)
    return df.select(*schema.fieldNames())


def seat_counts(spark: SparkSession, regs: DataFrame, base: str | None = None) -> DataFrame:
    """R1: paid registrations per session, maintained by a streaming aggregation."""
    base = base or scratch_path(spark, "stream-seat-counts")
    out = f"{base}/out"
    agg = regs.filter(F.col("payment_status") == "COMPLETED").groupBy("event_id").agg(
        F.count(F.lit(1)).alias("booked_seats"))

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(agg.writeStream.outputMode("update").foreachBatch(sink), base)
    rows = _read_batches(spark, out, T.StructType(agg.schema.fields + [T.StructField("batch", T.LongType())]))
    return rows.groupBy("event_id").agg(F.max_by("booked_seats", "batch").alias("booked_seats"))


def audit_log(spark: SparkSession, regs: DataFrame, base: str | None = None) -> DataFrame:
    """R2: one INSERT audit row per registration, appended per micro-batch."""
    base = base or scratch_path(spark, "stream-audit")
    out = f"{base}/out"
    rows = regs.select(F.col("reg_id").alias("audit_id"), "user_id", "event_id", F.lit("INSERT").alias("action"),
                       F.col("ts").alias("action_time"), F.lit(None).cast("string").alias("old_status"),
                       F.col("payment_status").alias("new_status"))

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(rows.writeStream.foreachBatch(sink), base)
    return _read_batches(spark, out, rows.schema)


def update_log(spark: SparkSession, writes: DataFrame, base: str | None = None) -> DataFrame:
    """R2, updates: writes (write_id, reg_id, user_id, event_id, registration_status, ts) of registrations, a registration's first one
    its insert. Every later one gives an UPDATE audit row with the old and the new status, also where they are the same.

    Within a micro-batch a write's old status is carried from the write before it, in (ts, write_id) order; a registration's
    first write of a batch takes it from the latest statuses of the batches before, kept by key.
    """
    base = base or scratch_path(spark, "stream-updates")
    out = f"{base}/out"
    reg_type = writes.schema["reg_id"].dataType
    st_schema = T.StructType([T.StructField("reg_id", reg_type), T.StructField("status", T.StringType())])
    newest = lambda df: df.groupBy("reg_id").agg(F.max_by(F.struct("status"), "_age").alias("s")).select("reg_id", "s.status")
    state = BatchState(spark, f"{base}/state", st_schema, newest)
    rows = writes.filter(F.col("reg_id").isNotNull())
    audit = T.StructType([T.StructField("write_id", T.LongType()), T.StructField("reg_id", reg_type), T.StructField("user_id", T.LongType()),
                          T.StructField("event_id", T.LongType()), T.StructField("action", T.StringType()),
                          T.StructField("action_time", T.TimestampType()), T.StructField("old_status", T.StringType()),
                          T.StructField("new_status", T.StringType())])

    def sink(df: DataFrame, batch_id: int) -> None:
        # written: mostly few, and then they go to the rows, not the rows to them
        known = cut_lineage(state.before(batch_id, lambda s: s.join(df.select("reg_id"), "reg_id", "left_semi"))
                            .select("reg_id", F.struct("status").alias("_known")))
        carried = carry_last(df, ["reg_id"], ["ts", "write_id"], F.struct(F.col("registration_status").alias("status")), "_old")
        old = F.coalesce("_old", "_known")
        carried.join(known, "reg_id", "left").filter(old.isNotNull()).select(
            "write_id", "reg_id", "user_id", "event_id", F.lit("UPDATE").alias("action"), F.col("ts").alias("action_time"),
            old["status"].alias("old_status"), F.col("registration_status").alias("new_status")) \
            .write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last = df.groupBy("reg_id").agg(F.max(F.struct("ts", "write_id", F.col("registration_status").alias("status"))).alias("s"))
        state.write(batch_id, last.select("reg_id", "s.status"))

    _run(rows.writeStream.foreachBatch(sink), base)
    return _read_batches(spark, out, audit)


def assign_ids(spark: SparkSession, rows: DataFrame, order: list[str], id_col: str, start_after: int = 0, base: str | None = None) -> DataFrame:
    """T12 across micro-batches: dense ids in the order of arrival (batch by batch, ``order`` inside a batch). Every batch writes the
    highest id so far beside its rows, and reads that of the batch before it; a retried batch starts from the same mark."""
    base = base or scratch_path(spark, "stream-ids")
    out, marks = f"{base}/out", f"{base}/marks"
    mark = T.StructType([T.StructField("top", T.LongType())])

    def sink(df: DataFrame, batch_id: int) -> None:
        top = start_after if batch_id == 0 else spark.read.schema(mark).parquet(f"{marks}/{batch_id - 1}").first()["top"]
        batch_ids(df, [F.col(c).asc_nulls_first() for c in order], top, id_col).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written = spark.read.parquet(f"{out}/batch={batch_id}")
        written.agg(F.coalesce(F.max(id_col), F.lit(top)).cast("bigint").alias("top")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/{batch_id}")

    _run(rows.writeStream.foreachBatch(sink), base)
    return _read_batches(spark, out, T.StructType([*rows.schema.fields, T.StructField(id_col, T.LongType())]))


def waitlist(spark: SparkSession, regs: DataFrame, sessions: DataFrame, base: str | None = None) -> DataFrame:
    """R3: arrival-order seat assignment across micro-batches. A row arriving when the
    session's seated paid rows fill it becomes WAITLIST and takes no seat."""
    base = base or scratch_path(spark, "stream-waitlist")
    out = f"{base}/out"
    seats = sessions.select("event_id", "total_seats")
    st_schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("used", T.LongType())])
    state = BatchState(spark, f"{base}/state", st_schema, lambda df: df.groupBy("event_id").agg(F.sum("used").alias("used")))

    def sink(df: DataFrame, batch_id: int) -> None:
        used = state.before(batch_id, lambda s: s.join(df.select("event_id"), "event_id", "left_semi"))
        pos = ordered_positions(df, [F.col("ts").asc_nulls_first(), F.col("reg_id").asc()], keys=["event_id"],
                                weight=(F.col("payment_status") == "COMPLETED").cast("int"))
        j = pos.join(seats, "event_id", "left").join(used, "event_id", "left")
        before = F.coalesce(F.col("used"), F.lit(0)) + F.col("_before")
        full = F.coalesce(before >= F.col("total_seats"), F.lit(False))
        dec = j.select("reg_id", "user_id", "event_id", "ts",
                       F.when(full, "WAITLIST").otherwise(F.col("registration_status")).alias("registration_status"),
                       ((F.col("payment_status") == "COMPLETED") & ~full).alias("takes_seat"))
        dec.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written = spark.read.parquet(f"{out}/batch={batch_id}")
        add = written.filter("takes_seat").groupBy("event_id").agg(F.count(F.lit(1)).alias("used"))
        state.write(batch_id, add)

    _run(regs.writeStream.foreachBatch(sink), base)
    sch = T.StructType([T.StructField("reg_id", T.LongType()), T.StructField("user_id", T.LongType()),
                        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                        T.StructField("registration_status", T.StringType()), T.StructField("takes_seat", T.BooleanType())])
    return _read_batches(spark, out, sch)


def cart_dedupe(spark: SparkSession, clicks: DataFrame, base: str | None = None) -> DataFrame:
    """R4 (exact): the first click per (user, session) across all micro-batches becomes the
    cart row; later clicks on the same pair are duplicates."""
    base = base or scratch_path(spark, "stream-cart")
    out = f"{base}/out"
    c = clicks.filter(F.col("event_type") == "click").select("event_id", "user_id", "k", "ts")
    st_schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("k", T.LongType())])
    # a pair is added once, so the parts have no key in common
    state = BatchState(spark, f"{base}/state", st_schema, lambda df: df.drop("_age"))

    def sink(df: DataFrame, batch_id: int) -> None:
        seen = state.before(batch_id)
        first = df.groupBy("user_id", "k").agg(F.min(F.struct("ts", "event_id")).alias("f"))
        fresh = first.join(seen, ["user_id", "k"], "left_anti")
        rows = fresh.select(F.col("f.event_id").alias("cart_id"), "user_id", F.col("k").alias("event_id"),
                            F.col("f.ts").cast("date").alias("added_date"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        added = spark.read.parquet(f"{out}/batch={batch_id}").select("user_id", F.col("event_id").alias("k"))
        state.write(batch_id, added)

    _run(c.writeStream.foreachBatch(sink), base)
    sch = T.StructType([T.StructField("cart_id", T.LongType()), T.StructField("user_id", T.LongType()),
                        T.StructField("event_id", T.LongType()), T.StructField("added_date", T.DateType())])
    return _read_batches(spark, out, sch)


def cart_dedupe_within_watermark(clicks: DataFrame, delay: str = "1 day") -> DataFrame:
    """R4 (bounded delay): drop repeats of (user, session) seen within the watermark delay.

    Cheaper (state expires), but a repeat later than the delay is kept, and which of
    several clicks in one batch survives is not ordered by time.
    """
    c = clicks.filter(F.col("event_type") == "click")
    return c.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "k"])
