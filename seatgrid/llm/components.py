"""Connected components of an edge table: the library's own."""

from seatgrid.operators.components import connected_components

__all__ = ["connected_components"]
