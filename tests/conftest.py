import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seatgrid import schema as S  # noqa: E402
from seatgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, app="seatgrid-tests")


D15, D16 = dt.date(2024, 12, 15), dt.date(2024, 12, 16)

# Seed rows of the reference scripts (FIXTURES.md section 2).
SEED_USERS = [(1, "John Doe", "john@example.com", "USER"), (2, "Jane Smith", "jane@example.com", "USER"),
              (3, "Admin User", "admin@example.com", "ADMIN")]
SEED_SESSIONS = [
    (1, "Tech Conference 2024", D15, "10:00", "17:00", 100, Decimal("50.00"), "ACTIVE", 0),
    (2, "Web Development Workshop", D15, "10:00", "13:00", 50, Decimal("25.00"), "ACTIVE", 0),
    (3, "Networking Dinner", D15, "18:00", "21:00", 80, Decimal("40.00"), "ACTIVE", 0),
    (4, "AI Summit", D16, "09:00", "18:00", 120, Decimal("75.00"), "ACTIVE", 0),
    (5, "Startup Pitch Event", D16, "14:00", "17:00", 60, Decimal("30.00"), "ACTIVE", 0),
]


@pytest.fixture
def seed(spark):
    users = spark.createDataFrame(SEED_USERS, S.USERS)
    sessions = spark.createDataFrame(SEED_SESSIONS, S.SESSIONS)
    regs = spark.createDataFrame([], S.REGISTRATIONS)
    cart = spark.createDataFrame([], S.CART)
    return users, sessions, regs, cart
