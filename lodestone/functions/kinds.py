"""Tests of a value's type, for typed columns and for VARIANT ones, and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col

_INTEGER = "^(?:TINYINT|SMALLINT|INT|BIGINT)$"
_NUMBER = r"^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))$"


def kind_of(x: C, variant: bool = False) -> Column:
    """The type's name in upper case; of a VARIANT, that of the value in it."""
    return F.upper(F.schema_of_variant(col(x)) if variant else F.typeof(col(x)))


def is_int(x: C, variant: bool = False) -> Column:
    return F.coalesce(kind_of(x, variant).rlike(_INTEGER), F.lit(False))


def is_number(x: C, variant: bool = False) -> Column:
    return F.coalesce(kind_of(x, variant).rlike(_NUMBER), F.lit(False))


def is_string(x: C, variant: bool = False) -> Column:
    return F.coalesce(kind_of(x, variant) == "STRING", F.lit(False))


def is_list(x: C, variant: bool = False) -> Column:
    return F.coalesce(F.startswith(kind_of(x, variant), F.lit("ARRAY")), F.lit(False))


def is_dict(x: C, variant: bool = False) -> Column:
    return F.coalesce(kind_of(x, variant).rlike("^(?:MAP|STRUCT|OBJECT)<"), F.lit(False))


def is_container(x: C, variant: bool = False) -> Column:
    """Lists and dicts; a text isn't one."""
    return is_list(x, variant) | is_dict(x, variant)


def is_iterable(x: C, variant: bool = False) -> Column:
    """Lists, dicts and texts."""
    return is_container(x, variant) | is_string(x, variant)


# ---- clocks: one value for a whole query


def now() -> Column:
    return F.current_timestamp()


def utc_now() -> Column:
    """Wall-clock time of UTC, without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def today() -> Column:
    return F.current_date()


def now_string(fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.current_timestamp(), fmt)


def today_string(fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.current_date(), fmt)
