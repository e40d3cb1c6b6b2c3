"""Follow a change log with Structured Streaming.

A log is a folder: <root>/server.json with {"server", "snapshot_lsn", "tables":
{name: {"pk": [...]}}}, <root>/<table>/snapshot/ (Parquet rows as of
snapshot_lsn) and <root>/<table>/log/ (Parquet files of change events, see
operators.cdc). A run loads the snapshot into a table that isn't there yet, then
drains what the log holds now (availableNow) in windows of whole files, and ends.

Each window is published together with its batch id, so a window that comes
again after a crash is skipped. A window ends at a commit: the events of the
highest commit it has met, which may go on in the next files, are held back
(written beside the table and named by its version) until a later commit is met
or the log ends. An event that arrives behind the watermark is an error, not a
loss.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodeworks.errors import InvalidInput, TransferError
from lodeworks.functions.scalar import server_mark
from lodeworks.operators import cdc, changelog
from lodeworks.plans.spec import TableReport, TableSpec
from lodeworks.sinks.lake import Lake, LakeTable
from lodeworks.sources.files import listing
from lodeworks.streaming import guards

STOP = threading.Event()


def request_stop() -> None:
    """Let drains end after the window they are in, and the next one before its first."""
    STOP.set()


def cut_groups(tables: Iterable[str], slots: int) -> list[list[str]]:
    """The sorted tables as `slots` contiguous groups of nearly one size."""
    names = sorted(tables)
    n = min(max(1, slots), max(1, len(names)))
    return [names[len(names) * i // n : len(names) * (i + 1) // n] for i in range(n)]


def group_start(marks: dict[str, int | None]) -> int | None:
    """None: no member was loaded, load all. Else the least watermark; a mix is torn."""
    have = {t: m for t, m in marks.items() if m is not None}
    if not have:
        return None
    if len(have) < len(marks):
        raise InvalidInput(f"torn group: {', '.join(sorted(set(marks) - set(have)))} never loaded, {', '.join(sorted(have))} were; replace them together")
    return min(have.values())


@dataclass
class ChangeLog:
    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        text = self.spark.read.text(f"{self.root}/server.json", wholetext=True).first()
        self.meta = json.loads(text[0])
        for k in ("server", "snapshot_lsn", "tables"):
            if k not in self.meta:
                raise InvalidInput(f"server.json of {self.root} lacks {k!r}")
        self.mark = server_mark(str(self.meta["server"]))

    def pk(self, table: str) -> list[str]:
        if table not in self.meta["tables"]:
            raise InvalidInput(f"{table!r} is not in the log; there are: {', '.join(self.meta['tables'])}")
        pk = self.meta["tables"][table].get("pk") or []
        if not pk:
            raise InvalidInput(f"{table}: a table without a primary key can't be followed")
        return pk

    def snapshot(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/snapshot")

    def stream(self, table: str, files: int, max_bytes: int | None = None) -> DataFrame:
        rows = self.snapshot(table).schema
        size = ("maxBytesPerTrigger", max_bytes) if max_bytes else ("maxFilesPerTrigger", files)
        return self.spark.readStream.schema(cdc.event_schema(rows)).option(*size).parquet(f"{self.root}/{table}/log")

    @property
    def stop_line(self) -> int | None:
        """The last position to apply, if the log names one."""
        line = self.meta.get("stop_lsn")
        return None if line is None else int(line)

    def aborts(self, table: str) -> DataFrame | None:
        """(xid, sub_xid) of the transactions and savepoints that were rolled back, if the log has any."""
        if not any(name == "aborts" and folder for name, folder, _ in listing(self.spark, f"{self.root}/{table}")):
            return None
        return self.spark.read.schema("xid bigint, sub_xid bigint").parquet(f"{self.root}/{table}/aborts")

    def check(self, table: str, watermark: int | None, rows: StructType | None, warn_above: int | None = None) -> tuple[int, bool]:
        """Refuse a log that can't be followed on from here; returns the bytes it retains and whether they are too many."""
        guards.check_settings(self.meta.get("settings", {}))
        if watermark is not None and "oldest_lsn" in self.meta:
            guards.check_position(watermark, int(self.meta["oldest_lsn"]), int(self.meta.get("newest_lsn", 1 << 62)))
        if rows is not None:
            guards.check_schema(rows, self.snapshot(table).schema)
        return guards.retained_bytes(self.spark, self.root, table, warn_above)

    # the log's tables as a source of whole loads
    @property
    def url(self) -> str:
        return f"log://{self.root}"

    def tables(self, schema: str | None = None) -> list[TableSpec]:
        return [self.probe(t) for t in sorted(self.meta["tables"])]

    def probe(self, table: str) -> TableSpec:
        return TableSpec(table, self.snapshot(table).schema, pk=tuple(self.pk(table)), engine="log")

    def frame(self, table: str, cursor: str | None = None, parallel: int | None = None) -> DataFrame:
        self.pk(table)
        return self.snapshot(table)


def _window(events: DataFrame, after: int, stop_line: int | None = None, aborts: DataFrame | None = None) -> DataFrame:
    """Events after the watermark; what the snapshot or an earlier window holds is dropped."""
    return cdc.committed(events, stop_line, aborts).where(F.col("commit_lsn") > after)


def _held(table: LakeTable, v, schema) -> DataFrame | None:
    folders = json.loads(v.extra.get("held", "[]"))
    return table.spark.read.schema(schema).parquet(*[f"{table.path}/data/{f}" for f in folders]) if folders else None


def apply_window(table: LakeTable, events: DataFrame | None, source: str, pk: list[str], log: bool, batch: str, hold: bool = False, stop_line: int | None = None, aborts: DataFrame | None = None, first_lsn: int | None = None) -> int:
    """Publish one window; returns its number of events. A batch already published does nothing.

    hold: keep the events of the highest commit for the next window. events None:
    the log's end, what was held is applied. first_lsn: the snapshot's position;
    with it, events between that and the watermark raise, if the same query
    published the window before: they came too late.
    """
    v = table.version()
    query, _, number = batch.rpartition(":")
    same_query = v.extra.get("query") == query
    if events is not None and (v.extra.get("batch") == batch or int(v.extra.get("batch_no", -1)) >= int(number) and same_query):
        return 0
    after = int(v.state[source]["watermark"])
    extra = {"batch": batch, "batch_no": number, "query": query} if events is not None else {}
    kept = _held(table, v, events.schema if events is not None else cdc.event_schema(table.frame(v).drop(*(changelog.META if log else ())).schema))
    if events is None:
        if kept is None:
            return 0
        events = kept
    else:
        if first_lsn is not None and same_query:
            late = events.where((F.col("commit_lsn") > first_lsn) & (F.col("commit_lsn") <= after)).agg(F.min("commit_lsn")).first()[0]
            if late is not None:
                raise TransferError(f"{table.name}: events of commit {late} arrived behind the watermark {after}; replace the table")
        if kept is not None:
            events = events.unionByName(kept)
    # a log has as few files as its writer likes: the window is spread by the events' places, so that no task holds all of it
    events = _window(events, after, stop_line, aborts).repartition(*cdc.ORDER).persist()
    try:
        top = events.agg(F.max("commit_lsn")).first()[0]
        if top is None:
            return 0
        folders = json.loads(v.extra.get("held", "[]"))
        extra["held"] = "[]"
        window = events
        if hold:
            folder = uuid.uuid4().hex
            window = events.where(F.col("commit_lsn") < top)
            events.where(F.col("commit_lsn") == top).write.parquet(f"{table.path}/data/{folder}")
            extra["held"] = json.dumps([folder])
        last, count, holes = window.agg(F.max("commit_lsn"), F.count(F.lit(1)), F.count_if(F.size("masked") > 0)).first()
        if not count:

            def note(now):
                now.extra.update(extra)
                return now

            table.publish(note)
        elif log:
            rows = changelog.capture(window, pk, current=changelog.current_view(table.frame(v), pk) if holes else None, masks=holes > 0)
            table.append(rows, source, "_lsn", extra=extra)
        else:
            c = cdc.collapse(window, pk, masks=holes > 0)
            c.states = c.states.persist()
            try:
                base = table.frame(v).limit(0) if c.wiped else table.frame(v)
                gone = c.states.where("op = 'D'").select("key.*")
                table.merge(cdc._filled(base, c), source, "", deletes=gone, extra=extra, mark=str(last), wipe=c.wiped)
            finally:
                c.states.unpersist()
        for folder in folders:
            table.drop_staged(folder)
        return count
    finally:
        events.unpersist()


def follow(log: ChangeLog, lake: Lake, tables: list[str], checkpoint: str, as_changelog: bool = False, slots: int = 1, files: int = 16, max_bytes: int | None = None, seconds: float | None = None, warn_above: int | None = None) -> list[TableReport]:
    """Load or drain each table; slots groups of tables run at a time.

    A window takes so many files, or max_bytes of them; no window begins after
    `seconds`, or once request_stop() was called. warn_above: bytes of retained
    log from which on a table's report says so.
    """
    until = None if seconds is None else time.monotonic() + seconds
    over = lambda: STOP.is_set() or (until is not None and time.monotonic() >= until)
    reports = {t: TableReport(t, "log_based") for t in tables}
    source = f"log://{log.mark}"

    def load(group: list[str]) -> None:
        marks = {}
        for t in group:
            v = lake.table(t).version()
            if v is not None:
                fields = [f["name"] for f in json.loads(v.schema)["fields"]]
                changelog.check_shape(fields, as_changelog)
                other = [s for s in v.state if s.startswith("log://") and s != source]
                if other:
                    raise InvalidInput(f"{t} follows another server's log; replace it first")
            marks[t] = int(v.state[source]["watermark"]) if v and source in v.state else None
            replica = v is not None and not as_changelog
            retained, much = log.check(t, marks[t], StructType.fromJson(json.loads(v.schema)) if replica else None, warn_above)
            if much:
                reports[t].note = f"the log retains {retained} bytes"
        if group_start(marks) is None:
            for t in group:
                rows = log.snapshot(t)
                cdc.check_table(rows.schema, log.pk(t))
                if as_changelog:
                    rows = changelog.baseline(rows, log.meta["snapshot_lsn"])
                table = lake.table(t)
                n, _ = table.replace(rows, source, pk=log.pk(t), mode="log_based", mark=str(log.meta["snapshot_lsn"]))
                if not n:
                    raise TransferError(f"{t}: the snapshot is empty")
                reports[t].rows = n

    def drain(t: str) -> None:
        pk, table, counted = log.pk(t), lake.table(t), [0]

        rest = dict(stop_line=log.stop_line, aborts=log.aborts(t), first_lsn=int(log.meta["snapshot_lsn"]))

        def window(df: DataFrame, batch_id: int) -> None:
            counted[0] += apply_window(table, df, source, pk, as_changelog, f"{checkpoint}/{t}:{batch_id}", hold=True, **rest)

        if not over():
            q: StreamingQuery = log.stream(t, files, max_bytes).writeStream.foreachBatch(window).option("checkpointLocation", f"{checkpoint}/{t}").trigger(availableNow=True).start()
            while not q.awaitTermination(1):
                if over():
                    q.stop()
                    break
            if q.exception() is not None:
                raise TransferError(str(q.exception()))
            if not over():
                counted[0] += apply_window(table, None, source, pk, as_changelog, f"{checkpoint}/{t}:-1", **rest)
        reports[t].rows += counted[0]
        reports[t].watermark = table.version().state[source]["watermark"]

    def run(group: list[str]) -> None:
        try:
            load(group)
        except Exception as e:  # noqa: BLE001
            for t in group:
                reports[t].error = str(e)
            return
        for t in group:
            try:
                drain(t)
            except Exception as e:  # noqa: BLE001
                reports[t].error = str(e)

    threads = [threading.Thread(target=run, args=(g,)) for g in cut_groups(tables, slots) if g]
    for th in threads:
        th.start()
    for th in threads:
        th.join()
    STOP.clear()
    return [reports[t] for t in tables]
