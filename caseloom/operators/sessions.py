"""Gaps to the previous row of an entity, cases and stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.clean import holds
from caseloom.functions.dates import floor_days
from caseloom.functions.text import numbered_id
from caseloom.operators.ordered import MAX_GROUP_ROWS, OrderedGroups


def days_since_prev(
    df: DataFrame, key: str, ts: str, tie: Sequence[str] = (), name: str = "days_since_prev",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Whole days since the entity's previous row, null for its first."""
    scan = OrderedGroups(df, [key], [ts, *tie], max_group_rows=max_group_rows).previous(_before=ts)
    return scan.with_columns(**{name: floor_days("_before", ts)}).result().drop("_before")


def same_as_prev(
    df: DataFrame, key: str, order: Sequence[str], col: str, name: str = "same_as_prev",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Does the column equal its value in the entity's previous row? Missing values never do."""
    scan = OrderedGroups(df, [key], order, max_group_rows=max_group_rows).previous(_before=col)
    return scan.with_columns(**{name: holds(F.col(col) == F.col("_before"))}).result().drop("_before")


def running_sum(
    df: DataFrame, key: str, order: Sequence[str], flag: Column, name: str, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Number of rows of the entity so far for which the flag holds."""
    scan = OrderedGroups(df, [key], order, max_group_rows=max_group_rows)
    return scan.running_sum(name, holds(flag).cast("bigint")).result()


def assign_cases(
    df: DataFrame,
    key: str,
    ts: str,
    gap_days: int,
    terminator: Column,
    id_col: str,
    tie: Sequence[str] = (),
    number_col: str | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Group an entity's rows into cases and give each row its case id ``key_number``.

    A case starts at the entity's first row, after a gap of more than ``gap_days`` whole
    days, and after a row that fulfils ``terminator``. Rows without a key get no case.
    """
    scan = OrderedGroups(df, [key], [ts, *tie], max_group_rows=max_group_rows)
    scan = scan.previous(_before=ts, _ended=holds(terminator))
    gap = floor_days("_before", ts)
    starts = gap.isNull() | (gap > gap_days) | holds(F.col("_ended"))
    scan = scan.running_sum("_number", starts.cast("bigint"))
    scan = scan.with_columns(**{id_col: numbered_id(key, "_number")})
    out = scan.result().drop("_before", "_ended")
    return out.withColumnRenamed("_number", number_col) if number_col else out.drop("_number")


def assign_stays(
    df: DataFrame,
    key: str,
    ts: str,
    same_col: str,
    gap_days: int,
    id_col: str,
    tie: Sequence[str] = (),
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Group an entity's rows into stays and give each row its stay id ``key_number``.

    A row continues the stay if ``same_col`` is as in the previous row or if at most
    ``gap_days`` whole days have passed since then.
    """
    scan = OrderedGroups(df, [key], [ts, *tie], max_group_rows=max_group_rows)
    scan = scan.previous(_before=ts, _same=same_col)
    goes_on = holds(F.col(same_col) == F.col("_same")) | holds(floor_days("_before", ts) <= gap_days)
    scan = scan.running_sum("_number", (~goes_on).cast("bigint"))
    return scan.with_columns(**{id_col: numbered_id(key, "_number")}).result().drop("_before", "_same", "_number")


def flag_repeat(
    df: DataFrame,
    key: str,
    ts: str,
    days: int,
    condition: Column,
    name: str,
    tie: Sequence[str] = (),
    gap_col: str | None = None,
    among: Column | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Flag rows that fulfil the condition at most ``days`` days after the row before.

    The row before is the entity's previous row of any kind, or with ``among`` the last
    earlier one that fulfils it. ``gap_col`` keeps the gap in days.
    """
    scan = OrderedGroups(df, [key], [ts, *tie], max_group_rows=max_group_rows)
    if among is None:
        scan = scan.previous(_before=ts)
    else:
        scan = scan.last_known("_seen", F.when(holds(among), F.col(ts))).previous(_before="_seen")
    gap = floor_days("_before", ts)
    scan = scan.with_columns(**{gap_col or "_gap": gap, name: holds(gap <= days) & holds(condition)})
    return scan.result().drop("_before", "_seen", *([] if gap_col else ["_gap"]))
