from seatgrid.sources.domain import Domain  # noqa: F401
