"""Identifiers, null rules and small value conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(*parts: Column | str) -> Column:
    """First 24 hex digits of the SHA-1 of the parts joined by ``|``; NULL counts as empty."""
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *columns)), 1, 24)


def filled(*choices: Column) -> Column:
    """First choice that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def empty_to_null(df: DataFrame) -> DataFrame:
    """Sink rule: empty strings become NULL, numbers stay."""
    strings = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in strings else F.col(c) for c in df.columns])


def validate_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows a table with these NOT NULL columns would accept."""
    return df.dropna(how="any", subset=columns)


def integer_or_none(c: Column) -> Column:
    return c.try_cast("bigint")


def symbol_text(c: Column) -> Column:
    return F.upper(F.trim(c))
