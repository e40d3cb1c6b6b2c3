"""Watermark algebra: which of two is later, and which to trust."""

from __future__ import annotations

import re
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, TimestampNTZType, TimestampType

from lodeworks.errors import InvalidInput

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


class Trust(Enum):
    STATE = "state"  # data and state commit together: the state alone counts
    LATER = "later"  # the state may lag one run: the later of the two counts


def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"[+-]?\d+", text.strip()) else None


def pick(numeric: bool, state: str, data: str) -> str:
    """The later of state and data; a state that is no number loses to one."""
    if not numeric:
        return max(state, data)
    a, b = _number(state), _number(data)
    if a is None:
        return data
    return state if b is None or a >= b else data


def later(a: str | None, b: str | None, numeric: bool) -> str | None:
    if a is None or b is None:
        return b if a is None else a
    if not numeric:
        return max(a, b)
    x, y = _number(a), _number(b)
    if x is None and y is None:
        return max(a, b)
    return b if x is None or (y is not None and y > x) else a


def resolve(own: str | None, data: str | None, siblings: bool, trust: Trust, numeric: bool = True, dest: str = "", source: str = "") -> str | None:
    """The watermark to go on from, or None for a first run.

    A destination that other sources feed, but this one never did, is refused:
    the data's maximum is then somebody else's.
    """
    if own is not None:
        return own if trust is Trust.STATE or data is None else pick(numeric, own, data)
    if siblings:
        raise InvalidInput(f"{dest} holds rows of other sources and has no state for {source!r}; run mode='replace' first")
    return data


def is_numeric(kind: DataType) -> bool:
    return isinstance(kind, IntegralType)


def literal(value: str, kind: DataType) -> Column:
    """The watermark as a typed literal; it never becomes SQL text."""
    if is_numeric(kind):
        if _number(value) is None:
            raise InvalidInput(f"watermark {value!r} is not a whole number")
        return F.lit(int(value)).cast(kind)
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.lit(value).cast(kind)
    raise InvalidInput(f"no watermark of type {kind.simpleString()}")


def rendered(column: Column, kind: DataType) -> Column:
    """max() of a cursor as text that sorts like the cursor: microseconds, UTC."""
    top = F.max(column)
    return F.date_format(top, STAMP) if isinstance(kind, (TimestampType, TimestampNTZType)) else top.cast("string")


def delta(column: Column, watermark: str | None, kind: DataType, inclusive: bool) -> Column:
    """The rows to sync: all on a first run, else beyond (append) or from (merge) the watermark."""
    if watermark is None:
        return F.lit(True)
    value = literal(watermark, kind)
    return column >= value if inclusive else column > value
