"""What a log and its server must be like before anything is read."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from lodeworks.errors import InvalidInput
from lodeworks.sources.files import listing

_DDL = frozenset("alter create drop rename truncate grant revoke comment analyze optimize".split())
_COMMENT = re.compile(r"\s*(/\*.*?\*/|--[^\n]*\n|#[^\n]*\n)", re.S)

#: setting -> the values that a row log can be followed with
LOG_SETTINGS = {
    "log_bin": {"on", "1"},
    "binlog_format": {"row"},
    "binlog_row_image": {"full"},
    "binlog_transaction_compression": {"off", "0", ""},
    "binlog_row_value_options": {""},
    "wal_level": {"logical"},
}


def is_ddl(statement: str) -> bool:
    """Whether a logged statement changes a definition, rather than rows or a transaction."""
    while m := _COMMENT.match(statement):
        statement = statement[m.end() :]
    word = re.match(r"\s*([A-Za-z]+)", statement)
    return bool(word) and word.group(1).lower() in _DDL


def check_settings(settings: dict[str, str]) -> None:
    """Refuse a server whose settings leave something out of the log; unknown settings don't matter."""
    bad = [f"{k}={v!r} (needs {' or '.join(sorted(x for x in LOG_SETTINGS[k] if x)) or 'nothing'})" for k, v in settings.items() if k in LOG_SETTINGS and str(v).lower() not in LOG_SETTINGS[k]]
    if bad:
        raise InvalidInput("the log can't be followed: " + ", ".join(bad))


def check_position(watermark: int, oldest: int, newest: int) -> None:
    """Refuse a watermark that the log no longer reaches back to, or hasn't come to."""
    if watermark < oldest - 1:
        raise InvalidInput(f"the log starts at {oldest}, after the watermark {watermark}: changes are lost; replace the table")
    if watermark > newest:
        raise InvalidInput(f"the watermark {watermark} is beyond the log's end {newest}: another server, or one restored")


def check_schema(then: StructType, now: StructType) -> None:
    """Refuse to go on where the definition changed under the log."""
    a, b = ([(f.name, f.dataType.simpleString()) for f in s] for s in (then, now))
    if a != b:
        raise InvalidInput(f"the table's definition changed: {sorted(set(a) ^ set(b))}; replace the table")


def retained_bytes(spark: SparkSession, root: str, table: str, warn_above: int | None = None) -> tuple[int, bool]:
    """Bytes of log files that the source holds for a table, and whether that is above the threshold."""
    total = sum(size for _, folder, size in listing(spark, f"{root}/{table}/log", deep=True) if not folder)
    return total, warn_above is not None and total > warn_above
