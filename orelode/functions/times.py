"""Time parsing and ages. All times are UTC wall-clock values (``timestamp_ntz``)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_MINUTES = r"^(\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})((?:Z|[+-]\d{2}:?\d{2})?\s*)$"
_HAS_ZONE = r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"


def utc_now() -> str:
    """One value per job run, at second precision."""
    return datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None).isoformat() + "Z"


def parse_time(c: Column) -> Column:
    """ISO text to UTC wall-clock time; text without a zone is UTC, junk is NULL."""
    c = F.regexp_replace(c, _MINUTES, "$1:00$2")  # Spark reads no time without seconds before a zone
    zoned = F.when(c.rlike(_HAS_ZONE) | ~c.contains(":"), c).otherwise(F.concat(c, F.lit("Z")))
    # a bare date would be read in the session zone, so give it midnight UTC
    zoned = F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), F.concat(F.trim(c), F.lit("T00:00:00Z"))).otherwise(zoned)
    instant = F.try_to_timestamp(F.nullif(zoned, F.lit("")))
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def moment(value: str | datetime | Column) -> Column:
    """An ``as_of`` argument as a UTC wall-clock column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
    else:
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def hours_since(then: Column, as_of: str | datetime | Column) -> Column:
    """Age in hours, never negative, two decimals; NULL where either side is NULL."""
    micros = F.timestamp_diff("MICROSECOND", then, moment(as_of))
    return F.when(micros.isNotNull(), F.round(F.greatest(F.lit(0.0), micros / F.lit(3.6e9)), 2))


def duration_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, never negative."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.when(micros.isNotNull(), F.floor(F.greatest(F.lit(0).cast("long"), micros) / F.lit(1000000)).cast("long"))


def normalize_latest(c: Column) -> Column:
    """Newest-timestamp text of a table: empty is NULL, a bare date is midnight UTC."""
    text = F.nullif(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^.{4}-.{2}-.{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(text)


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def one_decimal(c: Column) -> Column:
    """A number in a message, half up to one decimal."""
    return c.cast("decimal(18,1)").cast("string")
