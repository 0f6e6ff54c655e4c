from seatgrid.functions.rules import (  # noqa: F401
    desc_first, fill_pct, pair_key, pct_half_up, present, well_formed_interval,
)
