"""Changelog tables: every change is kept, the current state is a view of them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.errors import InvalidInput
from lodeworks.operators.cdc import OPS, ORDER, same_key, unmasked

META = ("_op", "_lsn", "_seq", "_at")


def check_names(columns: Sequence[str]) -> None:
    low = {c.lower() for c in columns}
    clash = [m for m in META if m in low]
    if clash:
        raise InvalidInput(f"source columns named like changelog columns: {', '.join(clash)}")


def is_changelog(columns: Sequence[str]) -> bool:
    """Whether a table is a changelog; a table with only some of its columns is refused."""
    there = [m for m in META if m in {c.lower() for c in columns}]
    if there and len(there) < len(META):
        raise InvalidInput(f"half a changelog: only {', '.join(there)} are there")
    return bool(there)


def check_shape(columns: Sequence[str], changelog: bool) -> None:
    if is_changelog(columns) != changelog:
        raise InvalidInput("the destination is a " + ("replica" if changelog else "changelog") + "; run it in that shape, or replace it")


def baseline(rows: DataFrame, lsn: int, at: Column | None = None) -> DataFrame:
    """A full load as changelog rows: op B, seq 0."""
    check_names(rows.columns)
    return rows.select(F.lit("B").alias("_op"), F.lit(lsn).cast("bigint").alias("_lsn"), F.lit(0).cast("bigint").alias("_seq"), (F.current_timestamp() if at is None else at).alias("_at"), *[F.when(F.lit(True), F.col(f"`{c}`")).alias(c) for c in rows.columns])


def capture(events: DataFrame, pk: Sequence[str], at: Column | None = None, current: DataFrame | None = None, masks: bool = True) -> DataFrame:
    """All events of a window in order: op, lsn, seq, landing time and the row.

    A change of key is D of the old and U of the new one; a truncate is one T
    row without data and wipes nothing; a delete has only what the log gives
    (often just the key). lsn is the commit's, seq grows within it (twice the
    event's, plus one, or two for the second part of a change of key), so a replay
    gives the same rows, without a sort of the commit. Masked cells take the last value in the window
    (of the new key, else of the old one), else that of the current view, else
    the change is torn and raises. masks=False is for a log whose rows are whole.
    """
    columns = [f.name for f in events.schema["after"].dataType]
    check_names(columns)
    row_type = events.schema["after"].dataType
    moved = (F.col("op") == "U") & F.col("before").isNotNull() & ~same_key("before", "after", pk)
    known = F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(F.raise_error(F.lit("unknown change op")).cast("string"))
    masked = F.coalesce("masked", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    cell = lambda op, row, m, origin: F.struct(F.lit(op).alias("op") if isinstance(op, str) else op.alias("op"), row.alias("row"), m.alias("masked"), origin.alias("origin"))
    gone = cell("D", F.col("before"), none, F.lit(None).cast(row_type))
    parts = (
        F.when(F.col("op") == "D", F.array(gone))
        .when(F.col("op") == "T", F.array(cell("T", F.lit(None).cast(row_type), none, F.lit(None).cast(row_type))))
        .when(moved, F.array(gone, cell("U", F.col("after"), masked, F.col("before"))))
        .otherwise(F.array(cell(F.col("op"), F.col("after"), masked, F.lit(None).cast(row_type))))
    )
    flat = events.withColumn("op", known).select(*ORDER, F.posexplode(parts).alias("part", "e"))
    flat = flat.select(*ORDER, "part", "e.*")
    flat = flat.withColumn("n", (F.col("seq") * 2 + F.col("part") + 1).cast("bigint"))
    fill = [F.col(f"row.`{c}`").alias(c) for c in columns]
    if not masks:
        flat = unmasked(flat, "op")
    elif "masked" in events.columns:
        flat, fill = _resolved(flat, columns, pk, current)
    return flat.select(F.col("op").alias("_op"), F.col("commit_lsn").alias("_lsn"), F.col("n").alias("_seq"), (F.current_timestamp() if at is None else at).alias("_at"), *fill)


def _resolved(flat: DataFrame, columns: list[str], pk: Sequence[str], current: DataFrame | None) -> tuple[DataFrame, list[Column]]:
    """flat with all masked cells filled; only keys with a masked change are looked at again."""
    key = lambda side: F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in pk])
    kind = flat.schema["row"].dataType
    keyed = flat.withColumn("key", key("row"))
    asked = keyed.where(F.size("masked") > 0)
    moves = asked.where("origin is not null")
    touched = moves.select("key").unionByName(moves.select(key("origin").alias("key"))).distinct()
    if current is None:
        have = flat.sparkSession.createDataFrame([], f"k3 struct<{','.join(f'`{c}`:{kind[c].dataType.simpleString()}' for c in pk)}>, cur {kind.simpleString()}")
    else:
        have = current.select(key_of(pk).alias("k3"), F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("cur"))

    # rows that stay under their key: a running window, then the current view
    calm = keyed.join(touched, "key", "left_anti")
    story = calm.where("op not in ('D', 'T')").join(asked.select("key").distinct(), "key", "left_semi")
    w = W.partitionBy("key").orderBy("commit_lsn", "n").rowsBetween(W.unboundedPreceding, 0)
    seen = [F.last(F.when(~F.array_contains("masked", c), F.struct(F.col(f"row.`{c}`").alias("v"))), ignorenulls=True).over(w).alias(f"s_{c}") for c in columns]
    told = story.select("commit_lsn", "n", "op", "key", "row", "masked", *seen).where(F.size("masked") > 0).join(have, F.col("key") == F.col("k3"), "left")
    row = []
    for c in columns:
        torn = F.raise_error(F.lit(f"torn change: no value anywhere for the unchanged column {c}")).cast(kind[c].dataType)
        row.append(F.when(~F.array_contains("masked", c), F.col(f"row.`{c}`")).when(F.col(f"`s_{c}`").isNotNull(), F.col(f"`s_{c}`.v")).when(F.col("cur").isNotNull(), F.col(f"cur.`{c}`")).otherwise(torn).alias(c))
    solved = told.select("commit_lsn", "n", "op", F.struct(*row).alias("row"))

    # rows that moved with cells masked, few by nature: an ordered fold
    chain = keyed.join(touched, "key", "left_semi").join(have, F.col("key") == F.col("k3"), "left").select("commit_lsn", "n", "op", "key", "row", "masked", "origin", "cur")
    wiped = keyed.where("op = 'T'").select("commit_lsn", "n", "op", "key", "row", "masked", "origin", F.lit(None).cast(kind).alias("cur"))
    names = list(pk)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict[tuple, dict] = {}
        for k, cur in zip(pdf["key"], pdf["cur"]):
            if cur is not None:
                state.setdefault(tuple(k[c] for c in names), dict(cur))
        left: dict[tuple, dict] = {}
        out = []
        for r in pdf.sort_values(["commit_lsn", "n"]).itertuples(index=False):
            if r.op == "T":
                state, left = {}, {}
                continue
            k = tuple(r.key[c] for c in names)
            values = dict(r.row)
            if r.op == "D":
                if k in state:
                    left[k] = state.pop(k)
            else:
                base = state.get(k) if r.origin is None else left.get(tuple(r.origin[c] for c in names))
                for c in r.masked:
                    if base is None:
                        raise ValueError(f"torn change: no value anywhere for the unchanged column {c}")
                    values[c] = base[c]
                state[k] = values
            out.append((r.commit_lsn, r.n, r.op, values))
        return pd.DataFrame(out, columns=["commit_lsn", "n", "op", "row"])

    folded = chain.unionByName(wiped).groupBy(F.lit(1).alias("_one")).applyInPandas(lambda pdf: fold(pdf), solved.schema)
    both = calm.where(F.size("masked") == 0).select("commit_lsn", "n", "op", "row").unionByName(solved).unionByName(folded)
    return both, [F.col(f"row.`{c}`").alias(c) for c in columns]


def key_of(pk: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in pk])


def current_view(log: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The table's current rows: of what came after the newest T, the newest row of
    each key by (lsn, seq), without those that are deletes. No T keeps all rows;
    a row that a replay landed twice counts once."""
    at = F.struct("_lsn", "_seq")
    cut = log.where("_op = 'T'").agg(F.max(at).alias("cut"))
    live = log.crossJoin(F.broadcast(cut)).where((F.col("_op") != "T") & (F.col("cut").isNull() | (at > F.col("cut"))))
    rest = [c for c in log.columns if c not in META and c not in pk]
    best = F.max_by(F.struct("_op", *[F.col(f"`{c}`") for c in rest]), at).alias("b")
    newest = live.groupBy(*[F.col(f"`{c}`") for c in pk]).agg(best).where("b._op <> 'D'")
    return newest.select(*[F.col(f"`{c}`") if c in pk else F.col(f"b.`{c}`") for c in log.columns if c not in META])
