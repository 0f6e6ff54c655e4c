"""seatgrid: booking and capacity analytics on Spark DataFrames.

Users, scheduled sessions, carts and registrations are plain DataFrames. Reports,
rule evaluation, bulk state transitions, change logs and validation are expressed
with the DataFrame API so that Catalyst and AQE plan them.
"""

__version__ = "0.1.0"
