"""Column expressions for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.clean import ColumnLike, as_column


def tokens(column: ColumnLike) -> Column:
    """Lower-case words of a text: letters and digits of any script, and underscores."""
    return F.regexp_extract_all(F.lower(as_column(column)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def numbered_id(key: ColumnLike, number: ColumnLike) -> Column:
    """``key_number``, null if either is missing."""
    return F.concat(as_column(key).cast("string"), F.lit("_"), as_column(number).cast("string"))
