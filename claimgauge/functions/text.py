"""Text helpers: trimming, file-name parts, number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def file_name_part(text: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def fixed(value: Column, places: int) -> Column:
    """``1234.5`` as ``1234.50``."""
    return F.format_string(f"%.{places}f", value.cast("double"))


def grouped(value: Column, places: int = 0) -> Column:
    """``1234.5`` as ``1,234.50``."""
    return F.format_number(value, places)


def percent(rate: Column, places: int) -> Column:
    """``0.1234`` as ``12.3%``."""
    return F.concat(fixed(F.round(rate * 100, places), places), F.lit("%"))
