"""Grouped statistics as aggregate expressions. Where order matters it is that of the id, never of partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, FieldError
from ..names import resolve


@dataclass(frozen=True)
class Statistic:
    """A function of a field: ``kind`` is one of ``KINDS``."""

    kind: str
    field: str
    delimiter: str = ","

    @property
    def output(self) -> str:
        return f"{PREFIXES[_kind(self.kind)]}_{self.field}"

    def over(self, df: DataFrame, order: str) -> Column:
        """The aggregate expression, named; ``order`` is the id column."""
        name = resolve(self.field, df.columns)
        if name is None:
            raise FieldError(f"no field {self.field!r}")
        kind = _kind(self.kind)
        if kind in NUMERIC and not isinstance(df.schema[name].dataType, T.NumericType):
            raise FieldError(f"{kind} needs a numeric field, {name!r} is {df.schema[name].dataType.simpleString()}")
        return _FUNCTIONS[kind](F.col(name), F.col(order), self.delimiter).alias(self.output)


def _finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _mode(c: Column, o: Column, _: str) -> Column:
    """The most frequent value; of several the one that comes first."""
    pairs = F.collect_list(F.when(c.isNotNull(), F.struct(o.alias("o"), c.alias("v"))))
    values = F.array_distinct(F.transform(F.array_sort(pairs), lambda p: p["v"]))
    counts = F.transform(values, lambda v, i: F.struct(F.size(F.filter(pairs, lambda p: p["v"] == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(counts)["v"]


_FUNCTIONS: dict[str, Callable[[Column, Column, str], Column]] = {
    "average": lambda c, o, d: F.avg(c).cast("double"),
    "median": lambda c, o, d: F.median(_finite(c)),
    "minimum": lambda c, o, d: F.min(c),
    "maximum": lambda c, o, d: F.max(c),
    "range": lambda c, o, d: F.max(c) - F.min(c),
    "standard_deviation": lambda c, o, d: F.stddev_samp(_finite(c)),
    "variance": lambda c, o, d: F.var_samp(_finite(c)),
    "summation": lambda c, o, d: F.sum(c),
    "count": lambda c, o, d: F.count(c),
    "unique": lambda c, o, d: F.count_distinct(c),
    "mode": _mode,
    "first": lambda c, o, d: F.min_by(c, F.when(c.isNotNull(), o)),
    "last": lambda c, o, d: F.max_by(c, F.when(c.isNotNull(), o)),
    "concatenate": lambda c, o, d: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(o.alias("o"), c.cast("string").alias("v"))))), lambda p: p["v"]), d),
}
KINDS = tuple(_FUNCTIONS)
ALIASES = {"avg": "average", "mean": "average", "min": "minimum", "max": "maximum", "stddev": "standard_deviation", "stdev": "standard_deviation", "var": "variance", "sum": "summation", "concat": "concatenate"}
PREFIXES = dict(zip(KINDS, "AVG MEDIAN MIN MAX RANGE STDEV VAR SUM COUNT UNIQUE MODE FIRST LAST CONCAT".split()))
NUMERIC = frozenset(KINDS[:8])


def _kind(name: str) -> str:
    kind = ALIASES.get(name.casefold(), name.casefold())
    if kind not in _FUNCTIONS:
        raise ArgumentError(f"unknown statistic {name!r}")
    return kind


def expressions(statistics: Iterable[Statistic | tuple], df: DataFrame, order: str) -> list[Column]:
    """Aggregates of all statistics; of several with one output name the first counts."""
    out: dict[str, Column] = {}
    for s in statistics:
        s = s if isinstance(s, Statistic) else Statistic(*s)
        out.setdefault(s.output.casefold(), s.over(df, order))
    return list(out.values())
