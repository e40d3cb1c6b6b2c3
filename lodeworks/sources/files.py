"""Tables in files: Parquet, ORC and JSON folders, and CSV files of a repository."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodeworks.errors import InvalidInput
from lodeworks.naming import is_helper
from lodeworks.plans.spec import TableSpec


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, root: str, deep: bool = False) -> list[tuple[str, bool, int]]:
    """(path below root, is a folder, bytes), sorted; hidden names are left out."""
    p, fs = _path(spark, root)
    if not fs.exists(p):
        raise InvalidInput(f"no folder {root}")
    out: list[tuple[str, bool, int]] = []

    def walk(at, prefix: str) -> None:
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name[0] in "._":
                continue
            out.append((prefix + name, s.isDirectory(), s.getLen()))
            if deep and s.isDirectory():
                walk(s.getPath(), f"{prefix}{name}/")

    walk(p, "")
    return sorted(out)


class LakeFiles:
    """<root>/<table>.<format>, each a file or a folder of part files."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet") -> None:
        self.spark, self.root, self.fmt, self.url = spark, root.rstrip("/"), fmt, f"{fmt}://{root}"

    def tables(self, schema: str | None = None) -> list[TableSpec]:
        ending = "." + self.fmt
        names = [n.removesuffix(ending) for n, _, _ in listing(self.spark, self.root) if n.endswith(ending)]
        return [self.probe(n) for n in names if not is_helper(n)]

    def probe(self, table: str) -> TableSpec:
        return TableSpec(table, self.frame(table).schema, engine=self.fmt)

    def frame(self, table: str, cursor: str | None = None, parallel: int | None = None) -> DataFrame:
        path = f"{self.root}/{table}.{self.fmt}"
        p, fs = _path(self.spark, path)
        if not fs.exists(p):
            raise InvalidInput(f"no table {table!r} in {self.root}")
        return self.spark.read.format(self.fmt).load(path)


class CsvRepository:
    """The CSV files below a folder; a table is named by its file's stem, or by its path without ending.

    All columns are text. An empty field is null, a short row is padded with
    nulls, a longer row than the header is an error, a blank line is no row.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.url = spark, root.rstrip("/"), f"csv://{root}"

    def _files(self) -> list[str]:
        return [n for n, folder, _ in listing(self.spark, self.root, deep=True) if not folder and n.lower().endswith(".csv")]

    def resolve(self, table: str) -> str:
        if table.lower().endswith(".csv"):
            raise InvalidInput(f"name the table without .csv: {table!r}")
        if any(part in ("", ".", "..") for part in table.split("/")) or "." in table.rpartition("/")[2]:
            raise InvalidInput(f"{table!r} is not a table name")
        files = self._files()
        hits = [f for f in files if f[:-4] == table] or [f for f in files if f.rpartition("/")[2][:-4] == table]
        if not hits:
            raise InvalidInput(f"no CSV table {table!r}; there are: {', '.join(f[:-4] for f in files)}")
        if len(hits) > 1:
            raise InvalidInput(f"{table!r} is ambiguous: {', '.join(hits)}; give the path")
        return hits[0]

    def header(self, file: str) -> list[str]:
        """Column names: blank ones get col_<n>; names alike but for case are refused."""
        p, fs = _path(self.spark, f"{self.root}/{file}")
        stream = fs.open(p)
        try:
            raw = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(int(fs.getFileStatus(p).getLen()), 1 << 20)))
        finally:
            stream.close()
        row = next(csv.reader(io.StringIO(raw.decode("utf-8-sig", "replace"), newline="")), None)
        if not row:
            raise InvalidInput(f"{file} has no header row")
        names = [n.strip() or f"col_{i}" for i, n in enumerate(row, 1)]
        low = [n.lower() for n in names]
        twice = sorted({n for n in low if low.count(n) > 1})
        if twice:
            raise InvalidInput(f"{file}: duplicate columns {', '.join(twice)}")
        return names

    def tables(self, schema: str | None = None) -> list[TableSpec]:
        out = []
        for f in self._files():
            stem = f[:-4]
            if schema is None or stem.startswith(schema.rstrip("/") + "/"):
                out.append(self.probe(stem))
        return out

    def probe(self, table: str) -> TableSpec:
        names = self.header(self.resolve(table))
        return TableSpec(table, StructType([StructField(n, StringType()) for n in names]), engine="csv")

    def frame(self, table: str, cursor: str | None = None, parallel: int | None = None) -> DataFrame:
        file = self.resolve(table)
        names = self.header(file)
        extra = "_beyond"
        while extra in names:
            extra += "_"
        schema = StructType([StructField(n, StringType()) for n in [*names, extra]])
        df = self.spark.read.csv(f"{self.root}/{file}", schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)
        first = F.col(f"`{names[0]}`")
        checked = F.when(F.col(extra).isNotNull(), F.raise_error(F.lit(f"{file}: a row is longer than the header")).cast("string")).otherwise(first)
        return df.select(checked.alias(names[0]), *[F.col(f"`{n}`") for n in names[1:]])


class SheetPages:
    """Tabs of a spreadsheet as saved pages of its values API.

    <root>/<tab>/*.json, each {"values": [[...], ...]} in page order; the first
    row of the first page is the header, cells are displayed text.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.url = spark, root.rstrip("/"), f"sheets://{root}"

    def tables(self, schema: str | None = None) -> list[TableSpec]:
        return [self.probe(n) for n, folder, _ in listing(self.spark, self.root) if folder]

    def _pages(self, tab: str) -> DataFrame:
        names = [n for n, folder, _ in listing(self.spark, self.root) if folder]
        if tab not in names:
            raise InvalidInput(f"no tab {tab!r}; there are: {', '.join(names)}")
        raw = self.spark.read.text(f"{self.root}/{tab}", wholetext=True).select(F.input_file_name().alias("page"), F.from_json("value", "values array<array<string>>").alias("v"))
        return raw.select("page", F.posexplode("v.values").alias("at", "cells"))

    def probe(self, table: str) -> TableSpec:
        head = self._pages(table).orderBy("page", "at").first()
        if head is None:
            raise InvalidInput(f"tab {table!r} is empty")
        names = [(c or "").strip() or f"col_{i}" for i, c in enumerate(head.cells, 1)]
        if len({n.lower() for n in names}) < len(names):
            raise InvalidInput(f"tab {table!r} has duplicate columns")
        return TableSpec(table, StructType([StructField(n, StringType()) for n in names]), engine="sheets")

    def frame(self, table: str, cursor: str | None = None, parallel: int | None = None) -> DataFrame:
        names = self.probe(table).schema.fieldNames()
        rows = self._pages(table)
        first = rows.agg(F.min(F.struct("page", "at")).alias("h"))
        rows = rows.join(F.broadcast(first), F.struct("page", "at") > F.col("h"))
        return rows.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def stem(path: str) -> str:
    return re.sub(r"\.[^./]+$", "", path.rpartition("/")[2])
