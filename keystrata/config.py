"""Options of a key space, with the defaults of the live behaviour."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class KeyspaceConfig:
    """Limits, expiry, costs and hashing of a key space.

    ``cost_func`` gives the cost of a value where a row has none (0 or null); a plain
    SET costs 1. ``key_hasher`` is what lookups by hash use. ``max_entries``,
    ``max_cost`` and ``admission`` are read by ``operators.bounded``: "always" lets
    every row in and evicts (the behaviour that runs); "tinylfu" rejects a row that
    is used less than every row that stays (the documented behaviour).

    Counters, buffers, prefix indexes and timer wheels have no option: sketches take
    their width where they are made, and the rest is Spark's.
    """

    max_entries: int | None = None
    max_cost: int | None = None
    default_ttl_ns: int = 0
    cost_func: Callable[[Column], Column] | None = None
    key_hasher: Callable[[Column], Column] | None = None
    admission: str = "always"

    def __post_init__(self) -> None:
        if self.admission not in ("always", "tinylfu"):
            raise ValueError("admission is 'always' or 'tinylfu'")
        for name in ("max_entries", "max_cost"):
            n = getattr(self, name)
            if n is not None and n <= 0:
                raise ValueError(f"{name} must be positive")
