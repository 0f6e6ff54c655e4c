"""Canonical schemas (union of the three variants of the booking data model)."""

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("full_name", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("user_type", T.StringType(), True),
])

SESSIONS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("event_name", T.StringType(), True),
    T.StructField("event_date", T.DateType(), True),
    T.StructField("start_time", T.StringType(), True),
    T.StructField("end_time", T.StringType(), True),
    T.StructField("total_seats", T.IntegerType(), True),
    T.StructField("ticket_price", T.DecimalType(10, 2), True),
    T.StructField("event_status", T.StringType(), True),
    T.StructField("booked_seats", T.IntegerType(), True),
])

REGISTRATIONS = T.StructType([
    T.StructField("reg_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_id", T.LongType(), True),
    T.StructField("registration_date", T.DateType(), True),
    T.StructField("payment_status", T.StringType(), True),
    T.StructField("registration_status", T.StringType(), True),
    T.StructField("amount_paid", T.DecimalType(10, 2), True),
])

CART = T.StructType([
    T.StructField("cart_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_id", T.LongType(), True),
    T.StructField("added_date", T.DateType(), True),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_id", T.LongType(), True),
    T.StructField("ts", T.TimestampType(), True),
])

CHECKOUTS = T.StructType([
    T.StructField("checkout_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("payment_ok", T.BooleanType(), True),
])

# Fixed values of the data model: allowed domains and declared column lengths.
USER_TYPES = ["USER", "ADMIN"]
EVENT_STATUSES = ["ACTIVE", "CANCELLED", "COMPLETED"]
PAYMENT_STATUSES = ["PENDING", "COMPLETED", "FAILED", "REFUNDED"]
REGISTRATION_STATUSES = ["CONFIRMED", "CANCELLED", "WAITLIST"]
MAX_LENGTHS = {"users": {"full_name": 100, "email": 100}, "sessions": {"event_name": 200, "start_time": 10, "end_time": 10}}
