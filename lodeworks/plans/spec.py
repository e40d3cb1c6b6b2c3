"""Requests and reports."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, IntegralType, StructType, TimestampNTZType, TimestampType

from lodeworks.errors import InvalidInput


class Mode(str, Enum):
    REPLACE = "replace"
    APPEND = "append"
    MERGE = "merge"
    LOG_BASED = "log_based"

    @classmethod
    def of(cls, value: str | Mode) -> Mode:
        try:
            return cls(value)
        except ValueError:
            raise InvalidInput(f"unknown mode {value!r}; one of {', '.join(m.value for m in cls)}") from None


#: The order in which a run works through its modes.
MODE_ORDER = (Mode.REPLACE, Mode.APPEND, Mode.MERGE, Mode.LOG_BASED)


@dataclass(frozen=True)
class TableSpec:
    """A probed source table."""

    name: str
    schema: StructType
    pk: tuple[str, ...] = ()
    engine: str = "files"
    est_rows: int | None = None

    def cursor(self, asked: str | None, need: bool = True) -> str | None:
        """The incremental column: the one asked for, or a single whole-number key."""
        if asked is None:
            if len(self.pk) == 1 and isinstance(self.schema[self.pk[0]].dataType, IntegralType):
                return self.pk[0]
            if need:
                raise InvalidInput(f"{self.name}: append and merge need a cursor column (no single whole-number key found)")
            return None
        if asked not in self.schema.fieldNames():
            raise InvalidInput(f"{self.name}: no cursor column {asked!r}; columns: {', '.join(self.schema.fieldNames())}")
        if not isinstance(self.schema[asked].dataType, (IntegralType, DateType, TimestampType, TimestampNTZType)):
            raise InvalidInput(f"{self.name}: cursor {asked!r} must be a whole number, a date or a timestamp")
        return asked


@dataclass(frozen=True)
class TransferOptions:
    """Every knob of a transfer. chunk_bytes and durable are taken for
    compatibility and change nothing: Spark owns buffers and durability."""

    mode: Mode = Mode.REPLACE
    cursor: str | None = None
    parallel: int | None = None
    pk: tuple[str, ...] | None = None
    order_by: str | None = None
    partition_by: str | dict | None = None
    engine: str | None = None
    on_cluster: str | None = None
    changelog: bool = False
    slots: int = 1
    chunk_bytes: int = 4 << 20
    durable: bool = True

    def checked(self) -> TransferOptions:
        out = replace(self, mode=Mode.of(self.mode))
        if out.parallel is not None and out.parallel < 1:
            raise InvalidInput("parallel must be at least 1")
        if out.slots < 1:
            raise InvalidInput("slots must be at least 1")
        if out.slots > 1 and out.mode is not Mode.LOG_BASED:
            raise InvalidInput("slots is for mode='log_based'")
        if out.changelog and out.mode is not Mode.LOG_BASED:
            raise InvalidInput("changelog is for mode='log_based'")
        if out.engine is not None and not out.engine.replace("()", "").endswith("MergeTree"):
            raise InvalidInput(f"engine {out.engine!r} is not of the MergeTree family")
        if out.engine or out.on_cluster:
            raise InvalidInput("engine and on_cluster are DDL of one database; these sinks have neither")
        if out.order_by is not None and (not out.order_by.strip() or any(c in out.order_by for c in ";'\"\\") or out.order_by.count("(") != out.order_by.count(")")):
            raise InvalidInput(f"order_by {out.order_by!r} is not a list of columns")
        return out

    def partition_for(self, table: str) -> str | None:
        """The partition clause of a table: by its given name, its last part, or the one for all."""
        if not isinstance(self.partition_by, dict):
            return self.partition_by
        return self.partition_by.get(table, self.partition_by.get(table.rpartition(".")[2], self.partition_by.get("*")))


@dataclass
class TableReport:
    table: str
    mode: str = "replace"
    rows: int = 0
    watermark: str | None = None
    seconds: float = 0.0
    error: str | None = None
    note: str | None = None


@dataclass
class RunReport:
    tables: list[TableReport] = field(default_factory=list)
    seconds: float = 0.0

    @property
    def rows(self) -> int:
        return sum(t.rows for t in self.tables if t.error is None)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.table, t.mode, t.rows, t.watermark, float(t.seconds), t.error) for t in self.tables]
        return spark.createDataFrame(rows, "table string, mode string, rows long, watermark string, seconds double, error string")


def select_tables(table: str | None, tables: list | dict | None, schema: str | None, mode: str | Mode) -> tuple[list[tuple[str, Mode]], str | None]:
    """(table, mode) pairs in run order, or a schema to list; exactly one selector."""
    if sum(x is not None for x in (table, tables, schema)) != 1:
        raise InvalidInput("give exactly one of table, tables and schema")
    if schema is not None:
        return [], schema
    if table is not None:
        return [(table, Mode.of(mode))], None
    if not tables:
        raise InvalidInput("tables is empty")
    pairs = [(t, Mode.of(m)) for t, m in tables.items()] if isinstance(tables, dict) else [(t, Mode.of(mode)) for t in tables]
    names = [t for t, _ in pairs]
    if len(set(names)) != len(names):
        raise InvalidInput("a table is named twice")
    return sorted(pairs, key=lambda p: MODE_ORDER.index(p[1])), None
