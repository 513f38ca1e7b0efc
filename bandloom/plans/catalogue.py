"""All queries over the reference tables, with the SQL that checks them."""

from __future__ import annotations



from . import pyramids, signals, sources, stores, streams, windows  # noqa: E402,F401
from .registry import ORACLES, QUERIES  # noqa: E402,F401
