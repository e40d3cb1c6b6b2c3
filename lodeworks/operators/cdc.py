"""Change data: from a window of log events to final states, and onto a table.

Events have the columns commit_lsn, xid, sub_xid, seq, op (I, U, D, T), before
and after (structs of the table's columns) and masked (names of the columns
whose value the log leaves out because it didn't change). A cell therefore has
three states: a value, null, or masked. (commit_lsn, seq) orders the events.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lodeworks.errors import InvalidInput

ORDER = ("commit_lsn", "seq")
OPS = ("I", "U", "D", "T")


def event_schema(table: StructType) -> StructType:
    row = StructType([StructField(f.name, f.dataType, True) for f in table])
    base = [*[StructField(n, LongType()) for n in ("commit_lsn", "xid", "sub_xid", "seq")], StructField("op", StringType())]
    return StructType([*base, StructField("before", row), StructField("after", row), StructField("masked", ArrayType(StringType()))])


def check_table(schema: StructType, pk: Sequence[str], identity: Sequence[str] | None = None) -> None:
    """A table without a key, or whose log rows leave key columns out, can't be followed."""
    if not pk:
        raise InvalidInput("a table without a primary key can't be replicated from a log")
    missing = [c for c in pk if c not in schema.fieldNames()]
    if missing:
        raise InvalidInput(f"key columns not in the table: {', '.join(missing)}")
    if identity is not None and set(pk) - set(identity):
        raise InvalidInput(f"the log's row identity lacks key columns: {', '.join(sorted(set(pk) - set(identity)))}")


def committed(events: DataFrame, stop_line: int | None = None, aborts: DataFrame | None = None) -> DataFrame:
    """Events of transactions that committed up to the stop line.

    aborts (xid, sub_xid) lists rollbacks: sub_xid null aborts the transaction,
    else only the part after that savepoint.
    """
    out = events.where(F.col("commit_lsn").isNotNull())
    if stop_line is not None:
        out = out.where(F.col("commit_lsn") <= stop_line)
    if aborts is not None:
        whole = aborts.where("sub_xid is null").select("xid").distinct()
        part = aborts.where("sub_xid is not null").select("xid", "sub_xid").distinct()
        out = out.join(whole, "xid", "left_anti").join(part, ["xid", "sub_xid"], "left_anti").select(events.columns)
    return out


def _at() -> Column:
    return F.struct(*ORDER)


def _masked() -> Column:
    return F.coalesce("masked", F.array().cast("array<string>"))


def _key(row: str, pk: Sequence[str]) -> Column:
    cells = [F.when(F.col(f"{row}.`{c}`").isNull(), F.raise_error(F.lit(f"a change without a value for key column {c}")).cast("string")).otherwise(F.lit("")) for c in pk]
    return F.struct(*[F.col(f"{row}.`{c}`").alias(c) for c in pk]).alias("key"), F.concat(*cells)


def same_key(one: str, other: str, pk: Sequence[str]) -> Column:
    """Whether two rows have one key, column by column; null equals null."""
    out = F.lit(True)
    for c in pk:
        out = out & F.col(f"{one}.`{c}`").eqNullSafe(F.col(f"{other}.`{c}`"))
    return out


def horizon(events: DataFrame) -> DataFrame:
    """One row with the place of the last truncate (null: none)."""
    return events.where("op = 'T'").agg(F.max(_at()).alias("cut"))


def after_cut(events: DataFrame, cut: tuple[int, int] | None) -> DataFrame:
    """The events behind a place in the log."""
    if cut is None:
        return events
    lsn, seq = (F.lit(x).cast("bigint") for x in cut)
    return events.where((F.col("commit_lsn") > lsn) | ((F.col("commit_lsn") == lsn) & (F.col("seq") > seq)))


def keyed(events: DataFrame, pk: Sequence[str], cut: tuple[int, int] | None = None) -> DataFrame:
    """at, part, kind (D delete, U row, R row that moves from another key with cells
    masked), key, row, masked, origin; an update that changes the key is a delete
    of the old and a row of the new one, unless it leaves cells out: then it is R.
    Events up to cut, the last truncate, are dropped; unknown ops and null keys raise."""
    live = after_cut(events, cut).where("op <> 'T' or op is null")
    known = F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown change op "), F.coalesce("op", F.lit("null")))).cast("string"))
    live = live.withColumn("op", known)
    old, old_ok = _key("before", pk)
    new, new_ok = _key("after", pk)
    moved = (F.col("op") == "U") & F.col("before").isNotNull() & ~same_key("before", "after", pk)
    masked = _masked()
    row = lambda kind, key, ok, origin, body: F.struct(F.lit(kind).alias("kind"), key, ok.alias("ok"), origin.alias("origin"), body.alias("row"))
    nothing = F.lit(None).cast(events.schema["after"].dataType)
    plain = row("U", new, new_ok, F.struct(*[F.col(f"after.`{c}`").alias(c) for c in pk]), F.col("after"))
    gone = row("D", old, old_ok, F.struct(*[F.col(f"before.`{c}`").alias(c) for c in pk]), nothing)
    move = row("R", new, F.concat(new_ok, old_ok), F.struct(*[F.col(f"before.`{c}`").alias(c) for c in pk]), F.col("after"))
    parts = F.when(F.col("op") == "D", F.array(gone)).when(moved & (F.size(masked) > 0), F.array(move)).when(moved, F.array(gone, plain)).otherwise(F.array(plain))
    out = live.select(*ORDER, masked.alias("masked"), F.posexplode(parts).alias("part", "e"))
    return out.select(F.struct(*ORDER, "part").alias("at"), F.col("e.kind").alias("kind"), F.col("e.key").alias("key"), F.col("e.ok").alias("ok"), F.col("e.origin").alias("origin"), F.col("e.row").alias("row"), F.when(F.col("e.kind") == "D", F.array().cast("array<string>")).otherwise(F.col("masked")).alias("masked")).where("ok = ''").drop("ok")


@dataclass
class Collapsed:
    """states: key, op (U or D), row, holes (columns still masked), origin (the
    key under which the destination holds them); wiped: the window truncates the
    table; moved: some origin differs from its key."""

    states: DataFrame
    wiped: bool
    pk: tuple[str, ...]
    columns: tuple[str, ...]
    holes: bool = True
    moved: bool = True


def unmasked(ops: DataFrame, column: str) -> DataFrame:
    """ops, of which none may have masked cells: such a row raises."""
    checked = F.when(F.size("masked") > 0, F.raise_error(F.lit("a masked cell in a log that was said to have none")).cast("string")).otherwise(F.col(column))
    return ops.withColumn(column, checked)


def collapse(events: DataFrame, pk: Sequence[str], masks: bool = True) -> Collapsed:
    """Fold a window to one state for each key: the last write wins, a delete
    stays one even if the window made the row, a masked cell takes the last value
    that the window has for it after the key's last delete, else stays a hole.

    One aggregate does the folding: of each cell the last value, and of each key
    the last delete, behind which alone a value counts. Only keys that a row with
    masked cells moved from or to go through an ordered fold in Python. A first
    small pass tells where the last truncate is and whether any row moved so;
    masks=False is for a log whose rows are always whole.
    """
    columns = tuple(f.name for f in events.schema["after"].dataType)
    moves_so = (F.col("op") == "U") & (F.size(_masked()) > 0) & F.col("before").isNotNull() & ~same_key("before", "after", pk)
    found = events.agg(F.max(F.when(F.col("op") == "T", _at())).alias("cut"), F.count_if(moves_so).alias("moves")).first()
    cut = None if found["cut"] is None else tuple(found["cut"])
    moving = masks and found["moves"] > 0
    ops = keyed(events, pk, cut)
    done = lambda states, holes: Collapsed(states, cut is not None, tuple(pk), columns, holes, moving)
    if not masks:
        last = unmasked(ops, "kind").groupBy("key").agg(F.max_by(F.struct("kind", "row"), "at").alias("last"))
        states = last.select("key", F.col("last.kind").alias("op"), F.col("last.row").alias("row"), F.array().cast("array<string>").alias("holes"), F.col("key").alias("origin"))
        return done(states, False)
    plain, moves = ops, None
    if moving:
        moves = ops.where("kind = 'R'")
        touched = moves.select("key").unionByName(moves.select(F.col("origin").alias("key"))).distinct()
        plain = ops.join(touched, "key", "left_anti").where("kind <> 'R'").select(ops.columns)
    cells = []
    for c in columns:
        has = (F.col("kind") == "U") & ~F.array_contains("masked", c)
        cells.append(F.max(F.when(has, F.col("at"))).alias(f"t_{c}"))
        cells.append(F.max_by(F.col(f"row.`{c}`"), F.when(has, F.col("at"))).alias(f"v_{c}"))
    folded = plain.groupBy("key").agg(F.max_by("kind", "at").alias("op"), F.max(F.when(F.col("kind") == "D", F.col("at"))).alias("died"), *cells)
    told = lambda c: F.col(f"`t_{c}`").isNotNull() & (F.col("died").isNull() | (F.col(f"`t_{c}`") > F.col("died")))
    row = F.struct(*[F.when(told(c), F.col(f"`v_{c}`")).alias(c) for c in columns])
    holes = F.array_compact(F.array(*[F.when(~told(c), F.lit(c)) for c in columns]))
    states = folded.select("key", "op", F.when(F.col("op") == "U", row).alias("row"), F.when(F.col("op") == "U", holes).otherwise(F.array().cast("array<string>")).alias("holes"), F.col("key").alias("origin"))
    if moving:
        chain = ops.join(touched, "key", "left_semi").unionByName(moves.join(touched, "key", "left_anti")).select(ops.columns)
        states = states.unionByName(_fold_moves(chain, states.schema, columns, tuple(pk)))
    return done(states, True)


def _fold_moves(ops: DataFrame, schema: StructType, columns: tuple[str, ...], pk: tuple[str, ...]) -> DataFrame:
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict[tuple, tuple] = {}
        names: dict[tuple, dict] = {}
        order = sorted(range(len(pdf)), key=lambda i: tuple(pdf["at"].iloc[i][k] for k in ("commit_lsn", "seq", "part")))
        for i in order:
            kind, row, masked = pdf["kind"].iloc[i], pdf["row"].iloc[i], list(pdf["masked"].iloc[i])
            key, origin = dict(pdf["key"].iloc[i]), dict(pdf["origin"].iloc[i])
            k, o = tuple(key[c] for c in pk), tuple(origin[c] for c in pk)
            names[k] = key
            if kind == "D":
                state[k] = ("D", None, [], key)
                continue
            base = state.get(o)
            values, place = dict(row), origin
            if base is not None and base[0] == "U":
                place = base[3]
                for c in masked:
                    values[c] = base[1][c]
                masked = [c for c in masked if c in base[2]]
            if kind == "R":
                names[o] = origin
                state[o] = ("D", None, [], origin)
            state[k] = ("U", values, masked, place)
        rows = [(names[k], s[0], s[1], s[2], s[3]) for k, s in state.items()]
        return pd.DataFrame(rows, columns=["key", "op", "row", "holes", "origin"])

    return ops.groupBy(F.lit(1).alias("_one")).applyInPandas(lambda pdf: fold(pdf), schema)


def _filled(target: DataFrame, c: Collapsed) -> DataFrame:
    """The upserts as table rows, their holes taken from the row the target has at origin."""
    rows = c.states.where("op = 'U'")
    if not c.holes:
        return rows.select("row.*")
    whole = rows.where(F.size("holes") == 0).select("row.*")
    open_ = rows.where(F.size("holes") > 0)
    held = target.select(F.struct(*[F.col(f"`{k}`").alias(k) for k in c.pk]).alias("origin"), F.struct(*[F.col(f"`{n}`").alias(n) for n in c.columns]).alias("held"))
    met = open_.join(held, "origin", "left")
    cell = lambda n: F.when(~F.array_contains("holes", n), F.col(f"row.`{n}`")).when(F.col("held").isNull(), F.raise_error(F.lit(f"the row that holds the unchanged column {n} is gone")).cast(target.schema[n].dataType)).otherwise(F.col(f"held.`{n}`")).alias(n)
    return whole.unionByName(met.select(*[cell(n) for n in c.columns]))


def _base(target: DataFrame, c: Collapsed) -> DataFrame:
    return target.limit(0) if c.wiped else target


def apply_delete_insert(target: DataFrame, c: Collapsed) -> DataFrame:
    """Clear all touched keys, then insert the final rows."""
    base = _base(target, c)
    keys = c.states.select("key.*")
    return base.join(keys, list(c.pk), "left_anti").select(target.columns).unionByName(_filled(base, c).select(target.columns))


def apply_merge(target: DataFrame, c: Collapsed) -> DataFrame:
    """The same as one full outer join on the key, as MERGE would do it: the row
    that it meets also fills the holes of one that stayed under its key. Rows
    that moved with holes take them from where they were, by a join before."""
    base = _base(target, c)
    if c.moved and c.holes:
        new = _filled(base, c)
        states = new.select(F.struct(*[F.col(f"`{k}`").alias(k) for k in c.pk]).alias("key"), F.lit("U").alias("op"), F.struct(*[F.col(f"`{n}`").alias(n) for n in c.columns]).alias("row"), F.array().cast("array<string>").alias("holes"))
        gone = c.states.where("op = 'D'").select("key", "op", F.lit(None).cast(states.schema["row"].dataType).alias("row"), "holes")
        states = states.unionByName(gone)
    else:
        states = c.states.select("key", "op", "row", "holes")
    states = states.select(*[F.col(f"key.`{k}`").alias(f"_k_{k}") for k in c.pk], F.col("op").alias("_op"), F.col("row").alias("_row"), F.col("holes").alias("_holes"))
    on = [F.col(f"`{k}`") == F.col(f"`_k_{k}`") for k in c.pk]
    met = base.withColumn("_held", F.lit(True)).join(states, on, "full_outer").where("_op is null or _op <> 'D'")

    def cell(n: str) -> Column:
        gone = F.raise_error(F.lit(f"the row that holds the unchanged column {n} is gone")).cast(target.schema[n].dataType)
        kept = F.when(F.col("_held"), F.col(f"`{n}`")).otherwise(gone) if c.holes else gone
        return F.when(F.col("_op").isNull(), F.col(f"`{n}`")).when(~F.array_contains("_holes", n), F.col(f"_row.`{n}`")).otherwise(kept).alias(n)

    return met.select(*[cell(n) for n in target.columns])
