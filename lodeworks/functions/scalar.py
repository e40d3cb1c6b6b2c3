"""Column functions of the transfer lanes, all of them built-in expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def tsv_escaped(c: Column) -> Column:
    r"""Text for a tab-separated COPY: backslash, tab, line feed and carriage return escaped, null as \N."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, mark in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return F.coalesce(out, F.lit("\\N"))


def csv_field(c: Column) -> Column:
    """A CSV field in which null is empty and an empty string is two quotes."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), "").when((c == "") | c.rlike('[",\\r\\n]'), quoted).otherwise(c)


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    return F.unhex(c)


def base64_text(c: Column) -> Column:
    return F.base64(c)


def bool_from_text(c: Column) -> Column:
    """t/f, true/false, 1/0 as a boolean; anything else raises."""
    low = F.lower(F.trim(c))
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(low.isin("t", "true", "1"), True).when(low.isin("f", "false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def bool_to_text(c: Column) -> Column:
    return F.when(c, "1").when(~c, "0")


def typed(c: Column, kind: str) -> Column:
    """A staged text cell as its type; a bad value raises."""
    if kind == "boolean":
        return bool_from_text(c)
    if kind == "binary":
        return F.unhex(F.regexp_replace(c, r"^\\\\?x", ""))
    return c.cast(kind)


def without_offset(c: Column) -> Column:
    """A timestamp's text without a trailing zero offset."""
    return F.regexp_replace(c, r"(\+00(:?00)?|Z)$", "")


def micros_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def epoch_days(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def from_epoch_days(c: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), c.cast("int"))


def from_base10000(groups: Column, weight: Column, scale: int) -> Column:
    """An exact decimal from groups of four digits; weight is the power of 10000 of the first group."""
    digits = F.array_join(F.transform(groups, lambda g: F.lpad(g.cast("string"), 4, "0")), "")
    whole = F.greatest(weight + 1, F.lit(0)) * 4
    padded = F.rpad(F.concat(F.repeat(F.lit("0"), F.greatest(-weight - 1, F.lit(0)) * 4), digits), F.greatest(F.length(digits) + F.greatest(-weight - 1, F.lit(0)) * 4, whole), "0")
    text = F.concat(F.lit("0"), F.substring(padded, F.lit(1), whole), F.lit("."), F.substring(padded, whole + 1, F.length(padded)), F.lit("0"))
    return F.when(F.size(groups) == 0, F.lit(0)).otherwise(text.cast(f"decimal(38,{scale})")).cast(f"decimal(38,{scale})")


def json_text(c: Column, *path: str) -> Column:
    """A value below a path of keys as text, without NUL characters; JSON null and no value give null."""
    return F.translate(F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path)), "\0", "")


def tail_number(c: Column) -> Column:
    """The whole number at the end of a text, such as the last part of a URL."""
    return F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).cast("bigint")


def month_partition(c: Column) -> Column:
    return F.date_format(c, "yyyyMM")


def partition_column(clause: str, columns: list[str]) -> Column:
    """The partition value: by month for a bare column name, else the expression as it is."""
    return month_partition(F.col(f"`{clause}`")) if clause in columns else F.expr(clause)


def enum_label(index: Column, labels: list[str]) -> Column:
    """The label of a 1-based enum index; 0 is the empty (invalid) value."""
    return F.when(index == 0, "").otherwise(F.try_element_at(F.array(*map(F.lit, labels)), index.cast("int")))


def set_labels(mask: Column, labels: list[str]) -> Column:
    """The labels of a set's bits, comma separated."""
    return F.concat_ws(",", *[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, name) for i, name in enumerate(labels)])


def bit_text(c: Column) -> Column:
    return F.bin(c)


def signed_time(seconds: Column) -> Column:
    """Seconds as [-]HH:MM:SS, hours may exceed a day."""
    s = F.abs(seconds)
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    text = F.concat_ws(":", F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), text)


def lsn_number(c: Column) -> Column:
    """A log position X/Y (two hex numbers) as one whole number."""
    part = lambda i: F.conv(F.element_at(F.split(c, "/"), i), 16, 10).cast("bigint")
    return F.shiftleft(part(1), 32) + part(2)


def lsn_text(c: Column) -> Column:
    return F.concat(F.hex(F.shiftright(c, 32)), F.lit("/"), F.hex(c.bitwiseAND(F.lit((1 << 32) - 1))))


def binlog_position(file: Column, offset: Column) -> Column:
    """The number at the end of a log file's name and an offset in it, as one growing number."""
    return F.shiftleft(F.regexp_extract(file, r"(\d+)$", 1).cast("bigint"), 40) + offset.cast("bigint")


def hash_bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def server_mark(*parts: str) -> str:
    """A short fingerprint of a server, kept beside its watermark."""
    return hashlib.blake2b("\0".join(parts).encode(), digest_size=8).hexdigest()
