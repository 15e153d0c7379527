"""Scalar column expressions: text, time, JSON and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(col: Column, default) -> Column:
    """``default`` where the value is null."""
    return F.coalesce(col, F.lit(default))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def safe_filename(col: Column, default: str = "unknown_image") -> Column:
    """Path, tag and digest separators become underscores, spaces go, empty gets a default."""
    return F.coalesce(F.nullif(F.replace(F.translate(col, "/:@", "___"), F.lit(" ")), F.lit("")), F.lit(default))


def split_tags(col: Column, sep: str = ",") -> Column:
    """Separated tag text to an array of trimmed tags."""
    return F.transform(F.split(col, sep), lambda tag: F.trim(tag))


def epoch_seconds(text: Column) -> Column:
    """ISO-8601 text to epoch seconds; unparsable text gives null."""
    return F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6)


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp with or without zone (session zone must be UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def whole(us: Column, unit: int) -> Column:
    """Floor of ``us / unit`` in whole-number arithmetic."""
    return ((us - F.pmod(us, F.lit(unit))) / unit).cast("long")


def whole_up(us: Column, unit: int) -> Column:
    """Ceiling of ``us / unit`` in whole-number arithmetic."""
    return ((us + F.pmod(-us, F.lit(unit))) / unit).cast("long")


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def snapshot_name(ts: Column) -> Column:
    """Timestamp as ``yyyymmdd_hhmmss``."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def json_number(doc: Column, path: str, default: float | None = None) -> Column:
    """Numeric value at a JSON path, ``default`` where it is missing or malformed."""
    value = F.get_json_object(doc, path).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def percent(col: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col * 100)


def hash_int(*parts: Column) -> Column:
    """32-bit non-negative integer from the md5 of the joined parts; the same in any SQL engine."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def row_digest(cols: list[Column]) -> Column:
    """60-bit integer from the md5 of one row; nulls and empty text stay apart."""
    text = F.to_json(F.array(*[c.cast("string") for c in cols]))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
