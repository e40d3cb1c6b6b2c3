"""Database tables through JDBC: staged, then published by the database itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.errors import InvalidInput
from lodeworks.naming import MYSQL_LIMIT, POSTGRES_LIMIT, WIDE_LIMIT, Helper, helper_name
from lodeworks.plans import watermark
from lodeworks.plans.types import DDL, stringify_exotic
from lodeworks.sources.identity import scheme_of
from lodeworks.sources.jdbc import JdbcSource

STATE = "lodeworks_state"


class JdbcSink:
    """replace: drop and rename; append: insert-select; merge: delete by key and
    insert. Rows and state of append and merge go in one transaction."""

    kind = "jdbc"
    modes = ("replace", "append", "merge")

    def __init__(self, spark: SparkSession, url: str) -> None:
        self.spark, self.url, self.source = spark, url, JdbcSource(spark, url)
        self.scheme = scheme_of(url)
        self.quote = "`" if self.scheme == "mysql" else '"'
        self.limit = {"postgres": POSTGRES_LIMIT, "mysql": MYSQL_LIMIT}.get(self.scheme, WIDE_LIMIT)

    def _q(self, name: str) -> str:
        return ".".join(self.quote + p.replace(self.quote, self.quote * 2) + self.quote for p in name.split("."))

    def _run(self, *statements: str | tuple) -> None:
        con = self.source.connect()
        try:
            con.setAutoCommit(False)
            for s in statements:
                sql, args = s if isinstance(s, tuple) else (s, ())
                st = con.prepareStatement(sql)
                for i, a in enumerate(args, 1):
                    st.setString(i, a) if a is not None else st.setNull(i, 12)
                st.execute()
                st.close()
            con.commit()
        finally:
            con.close()

    def exists(self, name: str) -> bool:
        con = self.source.connect()
        try:
            schema, _, bare = name.rpartition(".")
            return bool(con.getMetaData().getTables(None, schema or None, bare, None).next())
        finally:
            con.close()

    def _stage(self, name: str, df: DataFrame) -> tuple[str, int]:
        stage = helper_name(name, Helper.STAGING, self.limit)
        if self.exists(stage):
            self._run(f"DROP TABLE {self._q(stage)}")
        ddl = DDL.get(self.scheme)
        rows = stringify_exotic(df)
        writer = (rows.limit(0) if self.source.embedded else rows).write.format("jdbc").options(**self.source.options).option("dbtable", self._q(stage))
        if ddl:
            writer = writer.option("createTableColumnTypes", ", ".join(f"`{f.name}` {ddl(f.dataType)}" for f in df.schema if " " not in ddl(f.dataType)))
        writer.mode("append").save()  # of an embedded database, only makes the table
        if self.source.embedded:
            self.source.insert(rows, self._q(stage))
        return stage, self.source.load(dbtable=self._q(stage)).count()

    def _state_sql(self, name: str, source: str, cursor: str | None, mark: str | None, all_sources: bool = False) -> list:
        t = self._q(STATE)
        if not self.exists(STATE):
            self._run(f"CREATE TABLE {t} ({self._q('dest')} varchar(255), {self._q('source_id')} varchar(500), {self._q('cursor_col')} varchar(255), {self._q('watermark')} varchar(255))")
        drop = f"DELETE FROM {t} WHERE {self._q('dest')} = ?"
        return [(drop, (name,)) if all_sources else (drop + f" AND {self._q('source_id')} = ?", (name, source)), (f"INSERT INTO {t} VALUES (?, ?, ?, ?)", (name, source, cursor, mark))]

    def states(self, name: str) -> dict[str, str | None]:
        if not self.exists(STATE):
            return {}
        df = self.source.load(dbtable=self._q(STATE))
        return {r["source_id"]: r["watermark"] for r in df.where(F.col("dest") == name).collect()}

    def replace(self, name: str, df: DataFrame, source: str, cursor: str | None = None, pk=()) -> tuple[int, str | None]:
        stage, rows = self._stage(name, df)
        if not rows:
            self._run(f"DROP TABLE {self._q(stage)}")
            return 0, None
        mark = self._mark(stage, cursor)
        self._run(*self.publish_sql(name, stage, self.exists(name)), *self._state_sql(name, source, cursor, mark, all_sources=True))
        return rows, mark

    def publish_sql(self, name: str, stage: str, there: bool) -> list[str]:
        """Statements that put the staged table in place of name, so that no reader meets
        a moment without it: DDL in a transaction where the database has that, else
        one renaming (or exchanging) statement, and only then the drop."""
        new, here, old = self._q(stage), self._q(name), self._q(helper_name(name, Helper.OUTGOING, self.limit))
        bare = self._q(name.rpartition(".")[2])
        if self.scheme == "mysql":
            return [f"DROP TABLE IF EXISTS {old}", f"RENAME TABLE {here} TO {old}, {new} TO {here}", f"DROP TABLE {old}"] if there else [f"RENAME TABLE {new} TO {here}"]
        if self.scheme == "clickhouse":
            return [f"EXCHANGE TABLES {new} AND {here}", f"DROP TABLE {new}"] if there else [f"RENAME TABLE {new} TO {here}"]
        drop = [f"DROP TABLE {here}"] if there else []
        return [*drop, f"RENAME TABLE {new} TO {bare}" if self.scheme == "jdbc" else f"ALTER TABLE {new} RENAME TO {bare}"]

    def _mark(self, table: str, cursor: str | None) -> str | None:
        if cursor is None:
            return None
        df = self.source.load(dbtable=self._q(table))
        return df.agg(watermark.rendered(F.col(f"`{cursor}`"), df.schema[cursor].dataType)).first()[0]

    def append(self, name: str, df: DataFrame, source: str, cursor: str) -> tuple[int, str | None]:
        stage, rows = self._stage(name, df)
        try:
            mark = self._mark(stage, cursor)
            if rows:
                cols = ", ".join(self._q(c) for c in df.columns)
                self._run(f"INSERT INTO {self._q(name)} ({cols}) SELECT {cols} FROM {self._q(stage)}", *self._state_sql(name, source, cursor, mark))
            return rows, mark
        finally:
            self._run(f"DROP TABLE {self._q(stage)}")

    def merge(self, name: str, df: DataFrame, source: str, cursor: str, pk) -> tuple[int, str | None]:
        if not pk:
            raise InvalidInput(f"{name}: merge needs a primary key")
        stage, rows = self._stage(name, df)
        try:
            mark = self._mark(stage, cursor)
            if rows:
                cols = ", ".join(self._q(c) for c in df.columns)
                on = " AND ".join(f"s.{self._q(k)} = {self._q(name)}.{self._q(k)}" for k in pk)
                self._run(f"DELETE FROM {self._q(name)} WHERE EXISTS (SELECT 1 FROM {self._q(stage)} s WHERE {on})", f"INSERT INTO {self._q(name)} ({cols}) SELECT {cols} FROM {self._q(stage)}", *self._state_sql(name, source, cursor, mark))
            return rows, mark
        finally:
            self._run(f"DROP TABLE {self._q(stage)}")
