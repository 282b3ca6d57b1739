"""Column expressions for cleaning values.

A comparison with a missing value counts as false here, never as null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    """A column by its literal name, dots and blanks included."""
    if isinstance(value, Column):
        return value
    return F.col("`" + value.replace("`", "``") + "`")


def holds(condition: Column) -> Column:
    """The condition, with unknown read as false."""
    return F.coalesce(condition, F.lit(False))


def null_if(column: ColumnLike, values: Sequence) -> Column:
    """Null where the value is one of the sentinels."""
    column = as_column(column)
    return F.when(~holds(column.isin(*values)), column)


def null_outside(
    column: ColumnLike, lo=None, hi=None, lo_inclusive: bool = True, hi_inclusive: bool = True, of: Column | None = None
) -> Column:
    """Null where the value, or ``of`` computed from it, lies outside the range."""
    column = as_column(column)
    measured = column if of is None else of
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (measured >= F.lit(lo) if lo_inclusive else measured > F.lit(lo))
    if hi is not None:
        inside = inside & (measured <= F.lit(hi) if hi_inclusive else measured < F.lit(hi))
    return F.when(inside, column)


def null_if_not_after(end: ColumnLike, start: ColumnLike) -> Column:
    """Null an end that is not after its start; an unknown start keeps the end."""
    end, start = as_column(end), as_column(start)
    return F.when(~holds(end <= start), end)


def fill_from(column: ColumnLike, *fallbacks) -> Column:
    """First known value among the column, other columns and constants."""
    return F.coalesce(as_column(column), *[f if isinstance(f, Column) else F.lit(f) for f in fallbacks])


def map_values(column: ColumnLike, mapping: Mapping, default="keep") -> Column:
    """Replace codes by labels; an unmapped value stays, or becomes ``default``."""
    column = as_column(column)
    table = F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])
    rest = column if default == "keep" else F.lit(default)
    return F.coalesce(table[column], rest)


def to_flag(column: ColumnLike, unknown: bool | None = True) -> Column:
    """Yes/no text to boolean: missing is no, any other text is ``unknown``."""
    text = F.upper(F.coalesce(as_column(column), F.lit("NO")))
    return F.when(text == "YES", True).when(text == "NO", False).otherwise(F.lit(unknown))


def to_number(column: ColumnLike, kind: str = "double") -> Column:
    """Number, or null where the text is none."""
    return as_column(column).try_cast(kind)


def bin_fixed(column: ColumnLike, lo: int, hi: int, width: int, right: bool = True) -> Column:
    """Label ``from-to`` of the equal-width bin; outside ``lo``..``hi`` there is none.

    Bins are closed on the right, or on the left with ``right=False``.
    """
    column = as_column(column)
    steps = (column - F.lit(lo)) / F.lit(width)
    index = (F.ceil(steps) - 1 if right else F.floor(steps)).cast("bigint")
    last = (hi - lo) // width - 1
    start = F.lit(lo) + index * F.lit(width)
    label = F.concat_ws("-", start.cast("string"), (start + F.lit(width)).cast("string"))
    return F.when((index >= 0) & (index <= last), label)


def row_sum(columns: Sequence[ColumnLike]) -> Column:
    """Sum over flags or numbers of a row, missing ones as zero."""
    return reduce(add, [F.coalesce(as_column(c).cast("bigint"), F.lit(0).cast("bigint")) for c in columns])


def row_mean(columns: Sequence[ColumnLike]) -> Column:
    """Share of flags of a row that are set."""
    return row_sum(columns) / F.lit(len(columns))
