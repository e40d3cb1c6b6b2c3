"""The entry verbs: transfer(), read() and request_stop()."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lodeworks.errors import InvalidInput, MultiTransferError
from lodeworks.functions.scalar import partition_column
from lodeworks.naming import check_destinations
from lodeworks.operators.incremental import append_delta, check_drift, latest_per_key, merge_delta, sort_for
from lodeworks.plans import watermark
from lodeworks.plans.spec import MODE_ORDER, Mode, RunReport, TableReport, TableSpec, TransferOptions, select_tables
from lodeworks.progress import Progress
from lodeworks.reader import Reader, reader
from lodeworks.sinks.jdbc import JdbcSink
from lodeworks.sinks.lake import Lake
from lodeworks.sinks.objects import ObjectStore
from lodeworks.sources.files import CsvRepository, LakeFiles, SheetPages
from lodeworks.sources.identity import redacted, scheme_of, source_identity
from lodeworks.sources.jdbc import JdbcSource
from lodeworks.sources.repo_api import ApiPages
from lodeworks.streaming.drain import ChangeLog, follow, request_stop

__all__ = ["Reader", "read", "request_stop", "transfer"]

TABLES_AT_ONCE = 4


class Frames:
    """Frames that the caller has, by name."""

    def __init__(self, frames: dict[str, DataFrame], name: str = "frames") -> None:
        self.all, self.url = frames, f"{name}://"

    def tables(self, schema: str | None = None) -> list[TableSpec]:
        return [self.probe(t) for t in self.all]

    def probe(self, table: str) -> TableSpec:
        return TableSpec(table, self.frame(table).schema, engine="frames")

    def frame(self, table: str, cursor: str | None = None, parallel: int | None = None) -> DataFrame:
        if table not in self.all:
            raise InvalidInput(f"no frame {table!r}; there are: {', '.join(self.all)}")
        return self.all[table]


class LakeSource:
    """The tables of a lake, as a source."""

    def __init__(self, lake: Lake) -> None:
        self.lake, self.url = lake, lake.url

    def tables(self, schema: str | None = None) -> list[TableSpec]:
        from lodeworks.sources.files import listing

        return [self.probe(n) for n, folder, _ in listing(self.lake.spark, self.lake.root) if folder]

    def probe(self, table: str) -> TableSpec:
        t = self.lake.table(table)
        v = t.version()
        return TableSpec(table, t.frame(v).schema, pk=tuple(v.pk), engine="lake", est_rows=sum(n for _, _, n in v.data))

    def frame(self, table: str, cursor: str | None = None, parallel: int | None = None) -> DataFrame:
        return self.lake.table(table).frame()


def _below(url: str) -> str:
    return url.split("://", 1)[1]


def open_source(spark: SparkSession, src):
    """A source for a URL or a dict of frames; the scheme picks it."""
    if isinstance(src, dict):
        return Frames(src)
    scheme = scheme_of(src)
    if scheme in ("parquet", "orc", "json"):
        return LakeFiles(spark, _below(src), scheme)
    files = {"csv": CsvRepository, "github": CsvRepository, "sheets": SheetPages, "gsheets": SheetPages, "api": ApiPages, "github+api": ApiPages}
    if scheme in files:
        return files[scheme](spark, _below(src))
    if scheme == "log":
        return ChangeLog(spark, _below(src))
    if scheme == "lake":
        return LakeSource(Lake(spark, _below(src)))
    if scheme in ("postgres", "mysql", "clickhouse") or src.startswith("jdbc:"):
        return JdbcSource(spark, src)
    raise InvalidInput(f"no source for {redacted(src)!r}")


def open_sink(spark: SparkSession, dst: str):
    scheme = scheme_of(dst)
    if scheme == "lake":
        return Lake(spark, _below(dst))
    if scheme in ("parquet", "csv"):
        return ObjectStore(spark, _below(dst), scheme)
    if scheme in ("s3", "gs", "gcs"):
        return ObjectStore(spark, dst, "parquet")
    if scheme in ("postgres", "mysql", "clickhouse") or dst.startswith("jdbc:"):
        return JdbcSink(spark, dst)
    raise InvalidInput(f"no sink for {redacted(dst)!r}")


def read(spark: SparkSession, src, table: str | None = None, *, cursor: str | None = None, parallel: int | None = None, columns: list[str] | None = None, query: str | None = None) -> Reader:
    """A table (or, of a database, a query) as a lazy reader. Filters and projections
    on it reach the source; nothing runs until a result is asked for."""
    source = open_source(spark, src)
    if (table is None) == (query is None):
        raise InvalidInput("give exactly one of table and query")
    if parallel is not None and parallel < 1:
        raise InvalidInput("parallel must be at least 1")
    if query is not None:
        if not hasattr(source, "query"):
            raise InvalidInput("query= needs a database source")
        return reader(source.query(query), columns)
    return reader(source.frame(table, cursor, parallel), columns)


def transfer(spark: SparkSession, src, dst: str, *, table: str | None = None, tables: list | dict | None = None, schema: str | None = None, dest_table: str | None = None, mode: str = "replace", checkpoint: str | None = None, progress: str | None = None, **options) -> RunReport:
    """Move tables from src to dst; see TransferOptions for the knobs.

    tables may map each table to its own mode; modes run in the order replace,
    append, merge, log_based, largest tables first, several at a time. One table
    that fails doesn't stop the others: MultiTransferError then carries the report.
    progress: a style of progress.Progress to report finished tables in. Of a
    log:// source, tables in other modes than log_based are its snapshots.
    """
    opts = TransferOptions(mode=mode, **options).checked()
    pairs, listed = select_tables(table, tables, schema, opts.mode)
    if dest_table is not None and table is None:
        raise InvalidInput("dest_table is for a single table")
    began = time.time()
    show = Progress(progress) if progress else None
    logged = [t for t, m in pairs if m is Mode.LOG_BASED]
    whole_log = listed is not None and opts.mode is Mode.LOG_BASED
    if (logged or whole_log) and (not isinstance(src, str) or scheme_of(src) != "log"):
        raise InvalidInput("log_based needs a log:// source")
    sink = open_sink(spark, dst)
    if (logged or whole_log) and "log_based" not in sink.modes:
        raise InvalidInput(f"{sink.kind} can't follow a log")
    source = open_source(spark, src)
    sizes: dict[str, int | None] = {}
    if whole_log:
        logged = sorted(source.meta["tables"])
    elif listed is not None:
        specs = source.tables(listed or None)
        pairs = [(s.name, opts.mode) for s in specs]
        sizes = {s.name: s.est_rows for s in specs}
    if opts.slots > 1 and len(logged) < 2:
        raise InvalidInput("slots needs more than one table")
    name_of = lambda t: dest_table or t.rpartition("/")[2] if not isinstance(sink, JdbcSink) else dest_table or t
    check_destinations([*logged, *(name_of(t) for t, m in pairs if m is not Mode.LOG_BASED)])
    report = RunReport()
    for kind in MODE_ORDER:
        if kind is Mode.LOG_BASED and logged:
            report.tables += follow(source, sink, logged, checkpoint or f"{sink.root}/.checkpoints", opts.changelog, opts.slots)
            continue
        group = sorted((t for t, m in pairs if m is kind), key=lambda t: -(sizes.get(t) or 1 << 62))
        if not group:
            continue

        def one(t: str, kind=kind) -> TableReport:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"transfer-{t}")
            return _move(source, sink, t, name_of(t), kind, opts)

        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            report.tables += list(pool.map(one, group))
    report.seconds = time.time() - began
    if show:
        for t in report.tables:
            show.add(t.table, t.rows, done=True)
    return _done(report, len(report.tables) > 1)


def _done(report: RunReport, many: bool) -> RunReport:
    bad = [t for t in report.tables if t.error]
    if bad:
        raise MultiTransferError(report) if many else InvalidInput(bad[0].error)
    return report


def _move(source, sink, table: str, dest: str, mode: Mode, opts: TransferOptions) -> TableReport:
    out, began = TableReport(table, mode.value), time.time()
    try:
        if mode.value not in sink.modes:
            raise InvalidInput(f"{sink.kind} takes mode {', '.join(sink.modes)} only, not {mode.value} ({table})")
        spec = source.probe(table)
        pk = tuple(opts.pk or spec.pk)
        cursor = spec.cursor(opts.cursor, need=mode is not Mode.REPLACE)
        df = source.frame(table, cursor if opts.cursor else None, opts.parallel)
        me = source_identity(source.url, table)
        out.rows, out.watermark = {"lake": _to_lake, "objects": _to_objects, "jdbc": _to_jdbc}[sink.kind](sink, df, dest, me, mode, cursor, pk, opts, table)
    except Exception as e:  # noqa: BLE001
        out.error = redacted(str(e))[:2000]
    out.seconds = time.time() - began
    return out


def _to_objects(sink: ObjectStore, df, dest, me, mode, cursor, pk, opts, table):
    return sink.replace(dest, sort_for(df, opts.order_by)), None


def _to_lake(sink: Lake, df, dest, me, mode, cursor, pk, opts, table):
    t = sink.table(dest)
    part = opts.partition_for(table)
    if part:
        try:  # analysis alone tells whether the clause holds; nothing is read
            df.limit(0).select(partition_column(part, df.columns)).schema  # noqa: B018
        except AnalysisException as e:
            raise InvalidInput(f"partition_by {part!r} doesn't fit {table}: {e.getCondition()}") from None
    have = t.version()
    mark = t.watermark_for(me, cursor) if mode is not Mode.REPLACE and have else None
    if mode is Mode.MERGE and not pk and not (have and have.pk):
        raise InvalidInput(f"{table}: merge needs a primary key")
    if mode is Mode.REPLACE or mark is None:
        return t.replace(df, me, cursor, pk, opts.order_by, part, mode.value)
    if mode is Mode.APPEND:
        rows, new = t.append(append_delta(df, cursor, mark), me, cursor, opts.order_by)
    else:
        rows, new = t.merge(merge_delta(df, cursor, mark), me, cursor, opts.order_by)
    return rows, new


def _to_jdbc(sink: JdbcSink, df, dest, me, mode, cursor, pk, opts, table):
    there = mode is not Mode.REPLACE and sink.exists(dest)
    mark = None
    if there:
        target = sink.source.load(dbtable=sink._q(dest))
        if not target.isEmpty():
            states = sink.states(dest)
            kind = target.schema[cursor].dataType
            data = sink._mark(dest, cursor)
            mark = watermark.resolve(states.get(me), data, any(s != me for s in states), watermark.Trust.STATE, watermark.is_numeric(kind), dest, me)
            if target.columns != df.columns:
                check_drift(target, df)
    if mark is None:
        return sink.replace(dest, df, me, cursor, pk)
    if mode is Mode.APPEND:
        return sink.append(dest, append_delta(df, cursor, mark), me, cursor)
    return sink.merge(dest, latest_per_key(merge_delta(df, cursor, mark), pk, [cursor] if cursor not in pk else []), me, cursor, pk)
