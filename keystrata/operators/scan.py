"""Scans over a state: all, by prefix, by glob, page by page."""

from __future__ import annotations

from collections.abc import Callable, Iterator as Iterable_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.glob import PatternError, compile_glob
from .state import live

DEFAULT_COUNT = 10


def _strings(state: DataFrame) -> bool:
    return isinstance(state.schema["key"].dataType, T.StringType)


def scan(state: DataFrame, as_of_ns: int) -> DataFrame:
    return state.where(live(as_of_ns))


def scan_prefix(state: DataFrame, prefix: str, as_of_ns: int) -> DataFrame:
    """Live rows under a prefix; the prefix reaches the file scan. Keys that aren't strings match nothing."""
    if not _strings(state):
        return state.where(F.lit(False))
    return scan(state.where(F.col("key").startswith(prefix)) if prefix else state, as_of_ns)


def find_by_prefix(state: DataFrame, prefix: str, limit: int, as_of_ns: int) -> DataFrame:
    """The first ``limit`` live rows under a prefix in key order; all of them with no positive limit."""
    found = scan_prefix(state, prefix, as_of_ns)
    return found.orderBy("key").limit(limit) if limit > 0 else found


def scan_match(state: DataFrame, pattern: str, as_of_ns: int, byte_wise: bool = False) -> DataFrame:
    """Live rows whose key matches a glob; a bad pattern matches nothing."""
    try:
        compiled = compile_glob(pattern)
    except PatternError:
        return state.where(F.lit(False))
    if not _strings(state):
        return state.where(F.lit(False))
    return scan(state.where(compiled.condition(F.col("key"), byte_wise)), as_of_ns)


def page(rows: DataFrame, after=None, count: int = DEFAULT_COUNT) -> DataFrame:
    """The next rows in key order; the last key is the next page's ``after``. Partitions send their top rows only."""
    n = count if count > 0 else DEFAULT_COUNT
    return (rows if after is None else rows.where(F.col("key") > F.lit(after))).orderBy("key").limit(n)


def prefix_counts(state: DataFrame, prefixes: list[str]) -> DataFrame:
    """Keys under each prefix, in one pass."""
    under = [F.when(F.col("key").startswith(p), F.lit(p)) for p in prefixes]
    return state.select(F.explode(F.array_compact(F.array(*under))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


class KeyIterator:
    """A cursor over scanned rows; it pulls a partition at a time and never holds the whole."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self._it: Iterable_[Row] | None = None
        self._now: Row | None = None

    def next(self) -> bool:
        if self._it is None:
            self._it = iter(self.rows.toLocalIterator())
        self._now = next(self._it, None)
        return self._now is not None

    @property
    def key(self):
        return None if self._now is None else self._now["key"]

    @property
    def value(self):
        return None if self._now is None else self._now["value"]

    @property
    def cursor(self):
        """The keyset token of the current row."""
        return self.key

    def keys(self) -> DataFrame:
        return self.rows.select("key")

    def values(self) -> DataFrame:
        return self.rows.select("value")

    def count(self) -> int:
        return self.rows.count()

    def for_each(self, fn: Callable[[object, object], bool]) -> None:
        """Call until it answers False."""
        for r in self.rows.toLocalIterator():
            if not fn(r["key"], r["value"]):
                break

    def close(self) -> None:
        self._it = self._now = None


def cost_of(value: Column) -> Column:
    """A cost function: bytes of a value's text."""
    return F.octet_length(value.cast("string"))
