"""Type mapping: what a database column becomes in Spark, and Spark's types in a sink."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    ShortType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from lodeworks.errors import InvalidInput

_SIGNED = {1: ByteType(), 2: ShortType(), 4: IntegerType(), 8: LongType()}
#: A column without sign moves up to the next type that holds all its values.
_UNSIGNED = {1: ShortType(), 2: IntegerType(), 4: LongType(), 8: DecimalType(20, 0)}
_PG = {
    "smallint": ShortType(), "int2": ShortType(), "integer": IntegerType(), "int4": IntegerType(), "int": IntegerType(),
    "bigint": LongType(), "int8": LongType(), "real": FloatType(), "float4": FloatType(), "double precision": DoubleType(), "float8": DoubleType(),
    "boolean": BooleanType(), "bool": BooleanType(), "date": DateType(), "timestamp": TimestampNTZType(), "timestamp without time zone": TimestampNTZType(),
    "timestamptz": TimestampType(), "timestamp with time zone": TimestampType(), "bytea": BinaryType(),
}
_MY = {
    "tinyint": 1, "smallint": 2, "mediumint": 4, "int": 4, "integer": 4, "bigint": 8, "float": FloatType(), "double": DoubleType(), "date": DateType(),
    "datetime": TimestampNTZType(), "timestamp": TimestampType(), "year": ShortType(), "time": StringType(), "json": StringType(),
}


def _args(native: str) -> tuple[str, tuple[int, ...]]:
    m = re.match(r"\s*([^(]+)(?:\(([^)]*)\))?(.*)$", native.lower(), re.S)
    nums = tuple(int(x) for x in re.findall(r"\d+", m.group(2) or ""))
    return " ".join((m.group(1) + " " + m.group(3)).split()), nums


def decimal(precision: int, scale: int) -> DataType:
    """Exact decimals up to 38 digits, beyond that exact text."""
    return DecimalType(precision, scale) if 1 <= precision <= 38 and 0 <= scale <= precision else StringType()


def from_postgres(native: str) -> DataType:
    """Unknown types come as text; a numeric without bounds as double."""
    name, nums = _args(native)
    if name in ("numeric", "decimal"):
        return decimal(nums[0], nums[1] if len(nums) > 1 else 0) if nums else DoubleType()
    return _PG.get(name, StringType())


def from_mysql(native: str) -> DataType:
    """Unknown types are refused by name."""
    name, nums = _args(native)
    unsigned = "unsigned" in name
    bare = name.replace("unsigned", "").replace("zerofill", "").strip()
    if bare in ("decimal", "numeric"):
        return decimal(nums[0] if nums else 10, nums[1] if len(nums) > 1 else 0)
    if bare in ("binary", "varbinary", "blob", "tinyblob", "mediumblob", "longblob", "bit"):
        return BinaryType()
    if bare in ("char", "varchar", "text", "tinytext", "mediumtext", "longtext", "enum", "set"):
        return StringType()
    kind = _MY.get(bare)
    if kind is None:
        raise InvalidInput(f"unsupported MySQL type {native!r}")
    if isinstance(kind, int):
        return (_UNSIGNED if unsigned else _SIGNED)[kind]
    return kind


def from_clickhouse(native: str) -> DataType:
    """Wrappers such as Nullable are peeled; types without a Spark scalar come as text."""
    name = native.strip()
    while m := re.fullmatch(r"(?:Nullable|LowCardinality)\((.*)\)", name, re.S):
        name = m.group(1).strip()
    if m := re.fullmatch(r"(U?)Int(8|16|32|64)", name):
        return (_UNSIGNED if m.group(1) else _SIGNED)[int(m.group(2)) // 8]
    if m := re.fullmatch(r"Decimal\((\d+),\s*(\d+)\)", name):
        return decimal(int(m.group(1)), int(m.group(2)))
    if name.startswith("DateTime"):
        return TimestampType()
    return {"Float32": FloatType(), "Float64": DoubleType(), "Bool": ShortType(), "Date": DateType(), "Date32": DateType()}.get(name, StringType())


def postgres_ddl(kind: DataType) -> str:
    if isinstance(kind, DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    return {ByteType: "smallint", ShortType: "smallint", IntegerType: "integer", LongType: "bigint", FloatType: "real", DoubleType: "double precision", BooleanType: "boolean", DateType: "date", TimestampNTZType: "timestamp", TimestampType: "timestamptz", BinaryType: "bytea"}.get(type(kind), "text")


def clickhouse_ddl(kind: DataType) -> str:
    if isinstance(kind, DecimalType):
        return f"Decimal({kind.precision},{kind.scale})"
    return {ByteType: "Int8", ShortType: "Int16", IntegerType: "Int32", LongType: "Int64", FloatType: "Float32", DoubleType: "Float64", BooleanType: "UInt8", DateType: "Date32", TimestampNTZType: "DateTime64(6)", TimestampType: "DateTime64(6, 'UTC')"}.get(type(kind), "String")


def mysql_ddl(kind: DataType) -> str:
    if isinstance(kind, DecimalType):
        return f"decimal({kind.precision},{kind.scale})" if kind.scale <= 30 else "longtext"
    return {ByteType: "tinyint", ShortType: "smallint", IntegerType: "int", LongType: "bigint", FloatType: "float", DoubleType: "double", BooleanType: "tinyint(1)", DateType: "date", TimestampNTZType: "datetime(6)", TimestampType: "timestamp(6)", BinaryType: "longblob"}.get(type(kind), "longtext")


def bigquery_ddl(kind: DataType) -> str:
    if isinstance(kind, DecimalType):
        whole = kind.precision - kind.scale
        return "NUMERIC" if whole <= 29 and kind.scale <= 9 else "BIGNUMERIC" if whole <= 38 and kind.scale <= 38 else "STRING"
    return {ByteType: "INT64", ShortType: "INT64", IntegerType: "INT64", LongType: "INT64", FloatType: "FLOAT64", DoubleType: "FLOAT64", BooleanType: "BOOL", DateType: "DATE", TimestampNTZType: "DATETIME", TimestampType: "TIMESTAMP", BinaryType: "BYTES"}.get(type(kind), "STRING")


def iceberg_ddl(kind: DataType) -> str:
    if isinstance(kind, DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    return {ByteType: "long", ShortType: "long", IntegerType: "long", LongType: "long", FloatType: "float", DoubleType: "double", BooleanType: "boolean", DateType: "date", TimestampNTZType: "timestamp", TimestampType: "timestamptz", BinaryType: "binary"}.get(type(kind), "string")


DDL = {"postgres": postgres_ddl, "clickhouse": clickhouse_ddl, "mysql": mysql_ddl, "bigquery": bigquery_ddl, "iceberg": iceberg_ddl}


def to_sink_schema(df: DataFrame, sink: str) -> DataFrame:
    """Cast df to what the sink can hold: nested values as JSON text, and for
    lakes all whole numbers as long."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        elif sink in ("parquet", "iceberg", "bigquery") and isinstance(kind, (ByteType, ShortType, IntegerType)):
            c = c.cast("bigint")
        elif sink == "clickhouse" and isinstance(kind, BooleanType):
            c = c.cast("tinyint")
        out.append(c.alias(f.name))
    return df.select(*out)


def stringify_exotic(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; the rest as it is."""
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{f.name}`")) for f in df.schema])
