"""The contract of a source, and the cutting of key ranges."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from lodeworks.plans.spec import TableSpec


class Source(Protocol):
    """A set of tables, read lazily."""

    url: str

    def tables(self, schema: str | None = None) -> list[TableSpec]:
        """All tables (of a schema), without helper objects."""

    def probe(self, table: str) -> TableSpec:
        """Schema and keys of one table, without reading rows."""

    def frame(self, table: str, cursor: str | None = None, parallel: int | None = None) -> DataFrame:
        """The table as a lazy frame, in `parallel` ranges of cursor where the source can split."""


def spans(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """[low, high] as at most n adjoining closed ranges of nearly one width."""
    if high < low or n < 1:
        return []
    width = high - low + 1
    n = min(n, width)
    cuts = [low + width * i // n for i in range(n + 1)]
    return [(a, b - 1) for a, b in zip(cuts[:-1], cuts[1:])]
