import io
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodeworks.errors import InvalidInput
from lodeworks.functions import scalar as S
from lodeworks.progress import Progress, human
from lodeworks.streaming import guards


def test_ddl():
    for s in ("ALTER TABLE t ADD c int", "  create index i on t(a)", "/* hi */ DROP TABLE t", "-- x\nrename table a to b"):
        assert guards.is_ddl(s)
    for s in ("BEGIN", "insert into t values (1)", "update t set drop=1", "", "/* create */ delete from t"):
        assert not guards.is_ddl(s)


def test_settings():
    guards.check_settings({"binlog_format": "ROW", "binlog_row_image": "full", "log_bin": "ON", "other": "x"})
    for bad in ({"binlog_format": "STATEMENT"}, {"binlog_row_image": "minimal"}, {"log_bin": "OFF"}, {"binlog_transaction_compression": "ON"}, {"binlog_row_value_options": "PARTIAL_JSON"}, {"wal_level": "replica"}):
        with pytest.raises(InvalidInput, match=next(iter(bad))):
            guards.check_settings(bad)


def test_positions_and_schema():
    guards.check_position(5, 6, 9)
    for bad in ((4, 6, 9), (10, 6, 9)):
        with pytest.raises(InvalidInput):
            guards.check_position(*bad)
    a = StructType([StructField("a", LongType())])
    guards.check_schema(a, a)
    with pytest.raises(InvalidInput):
        guards.check_schema(a, StructType([StructField("a", StringType())]))


def test_progress():
    t = iter([0.0, 1.0, 2.0])
    out = io.StringIO()
    p = Progress("json", out, lambda: next(t))
    p.add("t", 10, 100)
    p.add("t", 5, done=True)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert lines[1] == {"table": "t", "rows": 15, "bytes": 100, "seconds": 2.0, "done": True}
    assert human(999) == "999" and human(1_500_000) == "1.5M"
    with pytest.raises(ValueError):
        Progress("loud")


def test_retained(spark, tmp_path):
    (tmp_path / "t" / "log").mkdir(parents=True)
    (tmp_path / "t" / "log" / "f.parquet").write_bytes(b"x" * 50)
    assert guards.retained_bytes(spark, str(tmp_path), "t", 10) == (50, True)


def test_scalars(spark):
    row = spark.range(1).select(
        S.tsv_escaped(F.lit("a\t\\\n")).alias("tsv"), S.tsv_escaped(F.lit(None).cast("string")).alias("tsv0"), S.csv_field(F.lit('a"b')).alias("csv"), S.csv_field(F.lit("")).alias("csv0"),
        S.from_base10000(F.array(F.lit(12), F.lit(3456), F.lit(7000)), F.lit(1), 4).alias("num"), S.set_labels(F.lit(5), ["a", "b", "c"]).alias("labels"), S.enum_label(F.lit(2), ["x", "y"]).alias("enum"),
        S.signed_time(F.lit(-3725)).alias("time"), S.signed_time(F.lit(838 * 3600)).alias("long_time"), S.lsn_number(F.lit("16/B374D848")).alias("lsn"), S.bit_text(F.lit(5)).alias("bits"), S.typed(F.lit(r"\xff00"), "binary").alias("bin"),
        S.without_offset(F.lit("2024-01-01 00:00:00+00")).alias("off"), S.from_epoch_days(F.lit(1)).cast("string").alias("day"), S.bool_to_text(F.lit(True)).alias("bool"),
    ).first()
    assert (row.tsv, row.tsv0, row.csv, row.csv0) == ("a\\t\\\\\\n", "\\N", '"a""b"', '""')
    assert str(row.num) == "123456.7000" and row.labels == "a,c" and row.enum == "y" and row.time == "-01:02:05" and row.long_time == "838:00:00"
    assert row.lsn == (0x16 << 32) + 0xB374D848 and row.bits == "101" and bytes(row.bin) == b"\xff\x00" and row.off == "2024-01-01 00:00:00" and row.day == "1970-01-02" and row.bool == "1"
    with pytest.raises(Exception, match="not a boolean"):
        spark.range(1).select(S.bool_from_text(F.lit("maybe"))).collect()
