"""Grouped aggregation: one aggregate, its partial and its merging half, and a raw path without pre-aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> (update over raw input, merge over partial states)
_FUNCTIONS = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
    "bit_or": (F.bit_or, F.bit_or),
    "bit_and": (F.bit_and, F.bit_and),
    "bit_xor": (F.bit_xor, F.bit_xor),
}


@dataclass(frozen=True)
class Agg:
    """One aggregate of a spec: ``fn`` over ``expr`` (a column name, a Column or a literal), called ``name``.

    fn: a name of ``_FUNCTIONS``, or the user's own pair (update over raw input, merge over partial states) of functions from a
    Column to an aggregate Column. ``cast`` fixes the result type; counts are bigint.
    """

    name: str
    fn: str | tuple[Callable[[Column], Column], Callable[[Column], Column]] = "count"
    expr: str | int | Column = 1
    cast: str | None = None

    def _input(self) -> Column:
        if isinstance(self.expr, str):
            return F.col(self.expr)
        return self.expr if isinstance(self.expr, Column) else F.lit(self.expr)

    def _pair(self) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
        return _FUNCTIONS[self.fn] if isinstance(self.fn, str) else self.fn

    def update(self) -> Column:
        return self._typed(self._pair()[0](self._input()))

    def merge(self) -> Column:
        return self._typed(self._pair()[1](F.col(self.name)))

    def _typed(self, c: Column) -> Column:
        kind = self.cast or ("bigint" if self.fn == "count" else None)
        return (c.cast(kind) if kind else c).alias(self.name)


@dataclass(frozen=True)
class AggSpec:
    """Group keys and aggregates; several of either are allowed."""

    keys: Sequence[str]
    aggs: Sequence[Agg] = (Agg("cnt"),)


def group_aggregate(df: DataFrame, spec: AggSpec) -> DataFrame:
    """Partial aggregate, exchange on the keys, final aggregate: what Catalyst plans for a groupBy."""
    return df.groupBy(*spec.keys).agg(*[a.update() for a in spec.aggs])


def partial(df: DataFrame, spec: AggSpec, *by: str) -> DataFrame:
    """Bounded partial states: one row for each key and bound (page range, chunk); a key may appear several times."""
    return df.groupBy(*by, *spec.keys).agg(*[a.update() for a in spec.aggs])


def merge(states: DataFrame, spec: AggSpec) -> DataFrame:
    """Merge partial states into one row a key."""
    return states.groupBy(*spec.keys).agg(*[a.merge() for a in spec.aggs])


def raw_aggregate(df: DataFrame, spec: AggSpec, partitions: int | None = None) -> DataFrame:
    """Exchange raw rows on the keys first and aggregate after it: pays when nearly every key is unique.

    Only the columns that the aggregate needs cross the exchange. The session's shuffle partitions (and adaptive coalescing) decide how
    many tasks aggregate, or ``partitions`` if it is more. Fewer partitions are shared by that many tasks, each with keys of its own:
    with a task to a partition, that task would hold all of the partition's groups.
    """
    needed = [*spec.keys, *[a.expr for a in spec.aggs if isinstance(a.expr, str)]]
    slim = df if any(isinstance(a.expr, Column) for a in spec.aggs) else df.select(*dict.fromkeys(needed))
    keys = [F.col(k) for k in spec.keys]
    more = partitions and partitions > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = slim.repartition(partitions, *keys) if more else slim.repartition(*keys)
    return group_aggregate(moved, spec)


def audit(grouped: DataFrame, count: str = "cnt") -> DataFrame:
    """The two invariants of any grouped count: number of groups and number of input rows."""
    return grouped.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(count), F.lit(0)).cast("bigint").alias("n_rows"))
