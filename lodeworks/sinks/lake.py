"""A versioned table of Parquet files, published atomically.

<root>/<table>/data/<id>/ holds part files, <root>/<table>/log/<n>.json the
state of version n: data folders with their sequence number, folders of deleted
keys, the key columns, and the watermark of every source. Rows and watermark
become visible with one rename, which fails if another writer took the number;
the commit is then tried again upon the newer version.

A merge writes only the new rows and their keys. A row is gone for the reader if
its key was deleted at a later sequence than its own; compact() settles that.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeworks.errors import InvalidInput, TransferError
from lodeworks.functions.scalar import partition_column
from lodeworks.operators.incremental import check_drift, latest_per_key, sort_for
from lodeworks.plans import watermark

TRIES = 3
#: Folders that no version names stay this long: a running writer may still publish them.
STAGED_SECONDS = 86_400
PARTITION = "_month"


@dataclass
class Version:
    number: int = 0
    schema: str = ""
    pk: list[str] = field(default_factory=list)
    seq: int = 0
    data: list[list] = field(default_factory=list)  # [folder, seq, rows]
    deletes: list[list] = field(default_factory=list)  # [folder, seq]
    state: dict[str, dict] = field(default_factory=dict)  # by source
    extra: dict[str, str] = field(default_factory=dict)
    part: str | None = None  # what the table is partitioned by


class LakeTable:
    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _p(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._p(self.path).getFileSystem(self._conf)

    def version(self) -> Version | None:
        """The newest version, or None where there is no table."""
        fs, log = self._fs(), self._p(f"{self.path}/log")
        if not fs.exists(log):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return None
        stream = fs.open(self._p(f"{self.path}/log/{max(numbers):010d}.json"))
        try:
            return Version(**json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
        finally:
            stream.close()

    def _commit(self, v: Version) -> bool:
        """Make v visible; False if its number is taken."""
        fs = self._fs()
        log = f"{self.path}/log"
        fs.mkdirs(self._p(log))
        scratch = self._p(f"{log}/.{uuid.uuid4().hex}.tmp")
        out = fs.create(scratch, False)
        out.write(bytearray(json.dumps(asdict(v)).encode()))
        out.close()
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(scratch.toUri(), self._conf) if scratch.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
            none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(scratch, self._p(f"{log}/{v.number:010d}.json"), none)
            return True
        except Exception as e:  # noqa: BLE001
            fs.delete(scratch, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def publish(self, change) -> Version:
        """change(newest version or None) -> next version, until a commit holds."""
        for _ in range(TRIES):
            now = self.version()
            new = change(now)
            new.number = (now.number if now else 0) + 1
            if self._commit(new):
                return new
        raise TransferError(f"{self.name}: {TRIES} commits lost to other writers")

    def frame(self, v: Version | None = None) -> DataFrame:
        """The rows of a version (default: the newest)."""
        v = v or self.version()
        if v is None:
            raise InvalidInput(f"no table {self.name!r}")
        schema = StructType.fromJson(json.loads(v.schema))
        if not v.data:
            return self.spark.createDataFrame([], schema)
        first_delete = min((s for _, s in v.deletes), default=None)
        dels = [(d, s) for d, s in v.deletes if any(seq < s for _, seq, _ in v.data)]
        calm = [d for d, seq, _ in v.data if first_delete is None or all(seq >= s for _, s in dels)]
        rest = [(d, seq) for d, seq, _ in v.data if d not in calm]
        parts = []
        read = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        if calm:
            parts.append(read.parquet(*[f"{self.path}/data/{d}" for d in calm]).select(*[F.col(f"`{c}`") for c in schema.fieldNames()]))
        if rest:
            rows = None
            for seq in sorted({s for _, s in rest}):
                one = read.parquet(*[f"{self.path}/data/{d}" for d, s in rest if s == seq]).select(*[F.col(f"`{c}`") for c in schema.fieldNames()], F.lit(seq).alias("_seq_"))
                rows = one if rows is None else rows.unionByName(one)
            keys = None
            for d, s in dels:
                one = read.parquet(f"{self.path}/data/{d}").select(*v.pk).withColumn("_del_", F.lit(s))
                keys = one if keys is None else keys.unionByName(one)
            keys = keys.groupBy(*v.pk).agg(F.max("_del_").alias("_del_"))
            met = rows.join(keys, v.pk, "left").where("_del_ is null or _del_ <= _seq_")
            parts.append(met.select(*[F.col(f"`{c}`") for c in schema.fieldNames()]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _write(self, df: DataFrame, cursor: str | None, order_by: str | None, partition_by: str | None) -> tuple[str, int, str | None]:
        """Stage df: folder, rows and greatest cursor, counted while the rows are written."""
        folder = uuid.uuid4().hex
        seen = Observation()
        kind = df.schema[cursor].dataType if cursor else None
        marks = [watermark.rendered(F.col(f"`{cursor}`"), kind).alias("mark")] if cursor else []
        out = sort_for(df.observe(seen, F.count(F.lit(1)).alias("rows"), *marks), order_by)
        writer = out.write.option("compression", "zstd")
        if partition_by:
            names = df.columns
            out = out.withColumn(PARTITION, partition_column(partition_by, names))
            writer = out.write.option("compression", "zstd").partitionBy(PARTITION)
        writer.parquet(f"{self.path}/data/{folder}")
        got = seen.get
        return folder, int(got["rows"]), got.get("mark")

    def drop_staged(self, folder: str) -> None:
        self._fs().delete(self._p(f"{self.path}/data/{folder}"), True)

    def staged(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{folder}")

    def _state(self, source: str, cursor: str | None, mark: str | None, mode: str, rows: int) -> dict:
        return {source: {"cursor": cursor, "watermark": mark, "mode": mode, "rows": rows, "synced_at": time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())}}

    def replace(self, df: DataFrame, source: str, cursor: str | None = None, pk=(), order_by: str | None = None, partition_by: str | None = None, mode: str = "replace", extra: dict | None = None, mark: str | None = None) -> tuple[int, str | None]:
        """Put df in place of everything; no rows change nothing. The states of all sources go. mark: the watermark to note, if it isn't the cursor's greatest."""
        folder, rows, seen = self._write(df, cursor, order_by, partition_by)
        mark = mark or seen
        if not rows:
            self.drop_staged(folder)
            return 0, None
        schema = json.dumps(df.schema.jsonValue())

        def change(now: Version | None) -> Version:
            seq = (now.seq if now else 0) + 1
            return Version(schema=schema, pk=list(pk), seq=seq, data=[[folder, seq, rows]], state=self._state(source, cursor, mark, mode, rows), extra=extra or {}, part=partition_by)

        self.publish(change)
        return rows, mark

    def append(self, df: DataFrame, source: str, cursor: str, order_by: str | None = None, partition_by: str | None = None, extra: dict | None = None) -> tuple[int, str | None]:
        now = self.version()
        check_drift(self.spark.createDataFrame([], StructType.fromJson(json.loads(now.schema))), df)
        folder, rows, mark = self._write(df, cursor, order_by, partition_by or now.part)
        if not rows:
            self.drop_staged(folder)
            return 0, now.state.get(source, {}).get("watermark")
        numeric = watermark.is_numeric(df.schema[cursor].dataType)

        def change(v: Version) -> Version:
            self._check_same(now, v)
            v.seq += 1
            v.data.append([folder, v.seq, rows])
            old = v.state.get(source, {}).get("watermark")
            v.state.update(self._state(source, cursor, watermark.later(old, mark, numeric), "append", rows))
            v.extra.update(extra or {})
            return v

        self.publish(change)
        return rows, mark

    def merge(self, df: DataFrame, source: str, cursor: str, order_by: str | None = None, deletes: DataFrame | None = None, extra: dict | None = None, mark: str | None = None, wipe: bool = False) -> tuple[int, str | None]:
        """Upsert the newest row of each key; deletes: keys that go; wipe: all older rows go."""
        now = self.version()
        if not now.pk:
            raise InvalidInput(f"{self.name}: merge needs a destination with a primary key; replace it with one first")
        schema = StructType.fromJson(json.loads(now.schema))
        check_drift(self.spark.createDataFrame([], schema), df)
        new = latest_per_key(df, now.pk, [cursor] if cursor and cursor not in now.pk else [])
        folder, rows, seen = self._write(new.select(schema.fieldNames()), cursor, order_by, now.part)
        mark = mark or seen
        gone = None
        if deletes is not None:
            gone = uuid.uuid4().hex
            deletes.select(*now.pk).write.option("compression", "zstd").parquet(f"{self.path}/data/{gone}")
        if not rows and gone is None and not wipe:
            self.drop_staged(folder)
            return 0, now.state.get(source, {}).get("watermark")
        numeric = bool(cursor) and watermark.is_numeric(df.schema[cursor].dataType)

        def change(v: Version) -> Version:
            self._check_same(now, v)
            v.seq += 1
            if wipe:
                v.data, v.deletes = [], []
            if rows:
                v.data.append([folder, v.seq, rows])
                v.deletes.append([folder, v.seq])
            if gone is not None:
                v.deletes.append([gone, v.seq])
            old = v.state.get(source, {}).get("watermark")
            v.state.update(self._state(source, cursor, watermark.later(old, mark, numeric), "merge", rows))
            v.extra.update(extra or {})
            return v

        self.publish(change)
        return rows, mark

    def compact(self) -> None:
        """Rewrite the table without the rows that are gone; states and keys stay."""
        v = self.version()
        folder, rows, _ = self._write(self.frame(v), None, None, v.part)

        def change(now: Version) -> Version:
            if now.number != v.number:
                raise TransferError(f"{self.name} changed during compaction")
            now.seq += 1
            now.data, now.deletes = [[folder, now.seq, rows]], []
            return now

        self.publish(change)

    def _check_same(self, then: Version, now: Version | None) -> None:
        """A commit that is tried again must find the table as it was checked."""
        if now is None or (now.schema, now.pk) != (then.schema, then.pk):
            raise TransferError(f"{self.name} was replaced by another writer with another schema or key")

    def vacuum(self, older_than: float = STAGED_SECONDS) -> int:
        """Delete data folders that the newest version doesn't name and that are older
        than so many seconds; returns how many."""
        v, fs, count = self.version(), self._fs(), 0
        used = {d for d, *_ in [*v.data, *v.deletes]} | set(json.loads(v.extra.get("held", "[]"))) if v else set()
        until = (time.time() - older_than) * 1000
        at = self._p(f"{self.path}/data")
        if fs.exists(at):
            for s in fs.listStatus(at):
                if s.getPath().getName() not in used and s.getModificationTime() <= until:
                    fs.delete(s.getPath(), True)
                    count += 1
        return count

    def watermark_for(self, source: str, cursor: str, trust: watermark.Trust = watermark.Trust.STATE) -> str | None:
        """What to go on from; None for no table, and for an empty one even if it has a state."""
        v = self.version()
        if v is None or not sum(n for _, _, n in v.data):
            return None
        own = v.state.get(source, {}).get("watermark")
        siblings = any(s != source for s in v.state)
        if own is not None and trust is watermark.Trust.STATE:
            return own
        df = self.frame(v)
        kind = df.schema[cursor].dataType
        data = None if own is None and siblings else df.agg(watermark.rendered(F.col(f"`{cursor}`"), kind)).first()[0]
        return watermark.resolve(own, data, siblings, trust, watermark.is_numeric(kind), self.name, source)


class Lake:
    """A folder of versioned tables."""

    kind = "lake"
    modes = ("replace", "append", "merge", "log_based")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.url = spark, root.rstrip("/"), f"lake://{root}"

    def table(self, name: str) -> LakeTable:
        return LakeTable(self.spark, self.root, name)
