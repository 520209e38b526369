"""CSV cells: guarded against formulas, quoted, with fixed decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "﻿"


def guard(text: Column) -> Column:
    """A leading sign that a spreadsheet would run gets an apostrophe before it."""
    return F.when(text.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(guard(F.coalesce(text, F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))


def fixed3(x: Column) -> Column:
    """Three decimals, blank for null."""
    return F.coalesce(F.call_function("format_number", x, F.lit("0.000")), F.lit(""))
