"""Column expressions of the key-value model: op codes, sizes, key suffixes, names, expiry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Op codes, bytes that each entry adds to its request, the ends of table file names.
INSERT, UPDATE, DELETE, READ = 0, 1, 2, 3
ENTRY_OVERHEAD = 8
TABLE_SUFFIX = ".sst"


def op_code(name: Column) -> Column:
    """The code of insert, update, delete or read; null for other names, which writers reject."""
    return F.when(name == "insert", INSERT).when(name == "update", UPDATE).when(name == "delete", DELETE).when(name == "read", READ)


def entry_size(key: Column, value: Column) -> Column:
    """Bytes of an entry in a request."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + ENTRY_OVERHEAD).cast("long")


def key_with_ts(key: Column, micros: Column) -> Column:
    """The key with a big-endian 8-byte suffix of microseconds since the epoch."""
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(micros), 16, "0")))


def parse_ts(key: Column) -> Column:
    """The microseconds of a suffixed key; 0 where it is no longer than a suffix."""
    raw = key.cast("binary")
    return F.when(F.octet_length(raw) <= 8, F.lit(0).cast("long")).otherwise(F.conv(F.hex(F.substring(raw, -8, 8)), 16, 10).cast("long"))


def table_name(table_id: Column) -> Column:
    """The file name of a table: its id in six digits or more."""
    digits = table_id.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")), F.lit(TABLE_SUFFIX))


def parse_table_id(name: Column) -> Column:
    """The id in a table's file name or path; null for other files."""
    digits = F.regexp_extract(name, r"^(?:.*/)?(\d{1,18})\.sst$", 1)
    return F.when(digits != "", digits.cast("long"))


def is_live(expires_at: Column, now: Column) -> Column:
    """No expiry, or one after now."""
    return expires_at.isNull() | (expires_at > now)


def overlaps(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Closed key ranges that share a key."""
    return (lo_a <= hi_b) & (lo_b <= hi_a)
