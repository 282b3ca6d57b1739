"""Ordered scans within groups that stay parallel when one group is huge.

A window function runs each group in a single task. That is fine for most entities and
fatal for one that holds a third of all rows. :class:`OrderedGroups` therefore looks for hot
groups first. Those above the limit are cut, along the order, into slices of about that
many rows; the window runs per slice, and what a slice needs from the slices before it (a
last row, a running total) comes from a per-slice aggregate.

Sizes: only hot groups are cut, see :mod:`caseloom.operators.skew`, so there are at most
``MAX_SLICES`` of them and ``2 * MAX_SLICES`` slices however large the table is. Those bounded
tables are the only things collected or broadcast here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.skew import MAX_GROUP_ROWS, NULL_PARTS, Sizes, hot_keys

SAMPLES_PER_SLICE = 200
BLOCK = 32

SLICE = "_slice"


def position(order: Sequence[str]) -> Column:
    """Comparable value of a row's place in the order, missing values last."""
    parts = []
    for i, name in enumerate(order):
        parts.append(F.col(name).isNull().alias(f"n{i}"))
        parts.append(F.col(name).alias(f"v{i}"))
    return F.struct(*parts)


def _position_type(df: DataFrame, order: Sequence[str]) -> T.StructType:
    fields = []
    for i, name in enumerate(order):
        fields.append(T.StructField(f"n{i}", T.BooleanType()))
        fields.append(T.StructField(f"v{i}", df.select(F.col(name)).schema[0].dataType))
    return T.StructType(fields)


def _cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame | None, limit: int) -> DataFrame:
    """Positions that split each hot group into slices of about ``limit`` rows.

    They come from a sample by hash, so the same data always gives the same cuts.
    """
    every = max(1, limit // SAMPLES_PER_SLICE)
    per_cut = max(1, limit // every)
    rows = df if hot is None else df.join(F.broadcast(hot), list(keys))
    sample = rows.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(every)) == 0)
    ranks = Window.partitionBy(*keys).orderBy("_at")
    cuts = (
        sample.select(*keys, position(order).alias("_at"))
        .withColumn("_rank", F.row_number().over(ranks))
        .filter(F.col("_rank") % per_cut == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("_at")).alias("_cuts"))
    )
    kinds = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField("_cuts", T.ArrayType(_position_type(df, order)))]
    )
    bounded = df.sparkSession.createDataFrame(cuts.collect(), kinds)
    ends = F.transform(
        F.sequence(F.lit(1), F.size("_cuts")), lambda i: F.when(i % BLOCK == 0, F.element_at("_cuts", i))
    )
    return bounded.withColumn("_block_ends", F.filter(ends, lambda e: e.isNotNull()))


def _slice_number(at: Column) -> Column:
    """How many cuts lie at or before the row: whole blocks first, then inside one block."""
    blocks = F.size(F.filter("_block_ends", lambda e: e <= at))
    rest = F.slice("_cuts", blocks * BLOCK + 1, F.lit(BLOCK))
    return blocks * BLOCK + F.size(F.filter(rest, lambda c: c <= at))


class OrderedGroups:
    """Rows grouped by ``keys`` and ordered by ``order`` (ascending, missing values last).

    ``order`` must be unique within a group; with ``descending`` the scan runs backwards.
    Rows with a missing key belong to no group: they are kept, and every result is null.

    Looking for hot groups reads the key columns of ``df`` once more. If ``df`` is costly to
    derive, ``sizes_from`` may name a cheaper table with about as many rows per key.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        descending: bool = False,
        max_group_rows: int = MAX_GROUP_ROWS,
        sizes_from: DataFrame | Sizes | None = None,
    ):
        self.keys, self.order, self.descending = list(keys), list(order), descending
        self.columns = list(df.columns)
        self.sliced = False
        hot, limit = hot_keys(df if sizes_from is None else sizes_from, self.keys, max_group_rows)
        if hot is not None:
            df = self._slice(df, hot, limit)
        self.df = df

    @classmethod
    def _of(cls, parent: OrderedGroups, df: DataFrame, added: Sequence[str]) -> OrderedGroups:
        child = cls.__new__(cls)
        child.keys, child.order, child.descending = parent.keys, parent.order, parent.descending
        child.sliced = parent.sliced
        child.columns = [*parent.columns, *[a for a in added if a not in parent.columns]]
        child.df = df
        return child

    def _slice(self, df: DataFrame, hot: DataFrame, limit: int) -> DataFrame:
        self.sliced = True
        known = [F.col(k).isNotNull() for k in self.keys]
        cuts = _cut_points(df, self.keys, self.order, hot.select(*self.keys) if self.keys else None, limit)
        at = position(self.order)
        if self.keys:
            marked = df.join(F.broadcast(cuts), self.keys, "left")
        else:
            marked = df.withColumns(
                {
                    "_cuts": cuts.select("_cuts").scalar(),
                    "_block_ends": cuts.select("_block_ends").scalar(),
                }
            )
        number = F.when(F.col("_cuts").isNotNull(), _slice_number(at))
        for test in known:
            number = F.when(~test, -2 - F.pmod(F.xxhash64(*self.order), F.lit(NULL_PARTS)).cast("int")).otherwise(number)
        return marked.select(*df.columns, F.coalesce(number, F.lit(-1)).alias(SLICE))

    def _window(self):
        keys = [*self.keys, SLICE] if self.sliced else self.keys
        by = [F.col(o).desc_nulls_first() if self.descending else F.col(o).asc_nulls_last() for o in self.order]
        return Window.partitionBy(*keys).orderBy(*by)

    def _across(self):
        by = F.col(SLICE).desc() if self.descending else F.col(SLICE).asc()
        return Window.partitionBy(*self.keys).orderBy(by)

    def _known(self, value: Column) -> Column:
        """The value, null in rows without a group."""
        for k in self.keys:
            value = F.when(F.col(k).isNotNull(), value)
        return value

    def _with_edges(self, per_slice: Column, carried) -> DataFrame:
        """Attach to each slice what ``carried`` picks from the slices scanned before it."""
        edges = (
            self.df.filter(F.col(SLICE) >= 0)
            .groupBy(*self.keys, SLICE)
            .agg(per_slice.alias("_edge"))
            .withColumn("_edge", carried(F.col("_edge"), self._across()))
            .filter(F.col("_edge").isNotNull())
        )
        return self.df.join(F.broadcast(edges), [*self.keys, SLICE], "left")

    def _last_by(self, value: Column, where: Column | None = None) -> Column:
        at = position(self.order) if where is None else F.when(where, position(self.order))
        return F.min_by(value, at) if self.descending else F.max_by(value, at)

    def with_columns(self, **columns: Column) -> OrderedGroups:
        """Add plain columns between scans."""
        return self._of(self, self.df.withColumns(columns), list(columns))

    def previous(self, **columns: Column | str) -> OrderedGroups:
        """Add each column's value in the row scanned before this one."""
        picks = {name: F.col(c) if isinstance(c, str) else c for name, c in columns.items()}
        window = self._window()
        if not self.sliced:
            return self._of(
                self, self.df.withColumns({n: self._known(F.lag(c).over(window)) for n, c in picks.items()}), list(picks)
            )
        payload = F.struct(*[c.alias(n) for n, c in picks.items()])
        df = self._with_edges(self._last_by(payload), lambda edge, across: F.lag(edge).over(across))
        first = F.row_number().over(window) == 1
        df = df.withColumns(
            {n: self._known(F.when(first, F.col("_edge")[n]).otherwise(F.lag(c).over(window))) for n, c in picks.items()}
        )
        return self._of(self, df.drop("_edge"), list(picks))

    def running_sum(self, name: str, value: Column | str) -> OrderedGroups:
        """Add the sum of ``value`` over the rows scanned so far, this one included."""
        value = F.col(value) if isinstance(value, str) else value
        window = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        within = F.sum(value).over(window)
        if not self.sliced:
            return self._of(self, self.df.withColumn(name, self._known(within)), [name])
        df = self._with_edges(
            F.sum(value), lambda edge, across: F.sum(edge).over(across.rowsBetween(Window.unboundedPreceding, -1))
        )
        total = F.coalesce(within + F.col("_edge"), within, F.col("_edge"))
        return self._of(self, df.withColumn(name, self._known(total)).drop("_edge"), [name])

    def last_known(self, name: str, value: Column | str) -> OrderedGroups:
        """Add the last non-null ``value`` among the rows scanned so far, this one included."""
        value = F.col(value) if isinstance(value, str) else value
        window = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        within = F.last(value, ignorenulls=True).over(window)
        if not self.sliced:
            return self._of(self, self.df.withColumn(name, self._known(within)), [name])
        df = self._with_edges(
            self._last_by(value, value.isNotNull()),
            lambda edge, across: F.last(edge, ignorenulls=True).over(
                across.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        return self._of(
            self, df.withColumn(name, self._known(F.coalesce(within, F.col("_edge")))).drop("_edge"), [name]
        )

    def result(self) -> DataFrame:
        """All rows with the columns added so far."""
        return self.df.select(*self.columns)
