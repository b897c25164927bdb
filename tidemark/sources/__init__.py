"""Where series come from: stored tables, and tables of other shapes adapted to series."""

from .adapters import Series, events, lineitems, orders
from .storage import Store

__all__ = ["Series", "Store", "events", "lineitems", "orders"]
