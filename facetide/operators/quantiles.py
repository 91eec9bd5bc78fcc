"""Exact percentiles of a column, with linear interpolation, at any row count."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 0  # rows up to which one aggregate may hold all values; none, so one method answers at every size
LISTED = 50_000  # rows of a search range that may be listed
SKETCH_ACCURACY = 10_000


@dataclass
class _Search:
    """One rank being located: values strictly between ``low`` and ``high`` are still open."""

    rank: int
    rows: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None

    def inside(self, x: Column) -> Column:
        after = F.lit(True) if self.low == -math.inf else x > F.lit(self.low)
        return after if self.high == math.inf else after & (x < F.lit(self.high))


def percentiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    fractions: Sequence[float],
    small: int = SMALL,
    listed: int = LISTED,
) -> tuple[int, dict[str, list[float | None]]]:
    """Row count of ``df``, and percentiles of each column's non-null values (None if none).

    Up to ``small`` values Spark's exact aggregate may answer. Otherwise each wanted rank is
    closed in by a quantile sketch, the rows around it are counted exactly, and the few
    values left are listed: no task or driver ever holds the whole column, and the counts
    make the answer exact whatever the sketch's error.
    """
    values = df.select(*[value.cast("double").alias(name) for name, value in columns.items()])
    counts = values.agg(F.count(F.lit(1)), *[F.count(name) for name in columns]).first()
    rows = dict(zip(columns, counts[1:]))
    found: dict[str, list[float | None]] = {name: [None] * len(fractions) for name in columns}
    wanted = F.array(*[F.lit(float(f)) for f in fractions])
    if direct := [name for name in columns if 0 < rows[name] <= small]:
        exact = values.agg(*[F.percentile(name, wanted).alias(name) for name in direct]).first()
        found.update({name: list(exact[name]) for name in direct})
    for name in columns:
        if rows[name] > small:
            spots = [f * (rows[name] - 1) for f in fractions]
            ranks = sorted({edge for spot in spots for edge in (math.floor(spot), math.ceil(spot))})
            column = values.select(F.col(name).alias("x")).where(F.col("x").isNotNull())
            at = _values_at(column, ranks, rows[name], listed)
            found[name] = [_between(at, spot) for spot in spots]
    return counts[0], found


def _between(at: dict[int, float], spot: float) -> float:
    low, high = at[math.floor(spot)], at[math.ceil(spot)]
    share = spot - math.floor(spot)
    return low if low == high or share == 0 else low + (high - low) * share  # equal infinite neighbours have no difference


def _values_at(values: DataFrame, ranks: Sequence[int], rows: int, listed: int) -> dict[int, float]:
    searches = [_Search(rank, rows) for rank in ranks]
    while wide := [s for s in searches if s.value is None and s.rows > listed]:
        _narrow(values, wide)
    if narrow := [s for s in searches if s.value is None]:
        x = F.col("x")
        lists = [F.sort_array(F.collect_list(F.when(s.inside(x), x))).alias(f"l{i}") for i, s in enumerate(narrow)]
        found = values.agg(*[F.get(lst, F.lit(s.rank - s.below)).alias(f"v{i}") for i, (lst, s) in enumerate(zip(lists, narrow))])
        for search, value in zip(narrow, found.first()):
            search.value = value
    return {s.rank: s.value for s in searches}


def _narrow(values: DataFrame, searches: list[_Search]) -> None:
    x = F.col("x")
    margin = 2.0 / SKETCH_ACCURACY
    guesses = []
    for s in searches:
        centre = (s.rank - s.below) / s.rows
        ends = F.array(F.lit(max(0.0, centre - margin)), F.lit(min(1.0, centre + margin)))
        guesses.append(F.percentile_approx(F.when(s.inside(x), x), ends, SKETCH_ACCURACY))
    brackets = values.agg(*[g.alias(f"g{i}") for i, g in enumerate(guesses)]).first()
    counts = []
    for s, (left, right) in zip(searches, brackets):
        open_range = s.inside(x)
        for part in (x < left, x == left, (x > left) & (x < right), (x == right) & F.lit(left != right), x > right):
            counts.append(F.count(F.when(open_range & part, 1)).alias(f"c{len(counts)}"))
    counted = values.agg(*counts).first()
    for i, (s, (left, right)) in enumerate(zip(searches, brackets)):
        ranges = ((s.low, left), (left, left), (left, right), (right, right), (right, s.high))
        for (low, high), size in zip(ranges, counted[5 * i : 5 * i + 5]):
            if s.rank < s.below + size:
                if low == high:
                    s.value = low
                else:
                    s.low, s.high, s.rows = low, high, size
                break
            s.below += size
