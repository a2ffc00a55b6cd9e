"""Window functions.  Every window names its partition and its order; a window without partition goes through the
ordered two-pass form of ``ordered`` when tables are large."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidewell.functions.guards import demand, finite

_AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}


def spec(partition_by: list[str], order_by: list[Column | str]) -> WindowSpec:
    return Window.partitionBy(*partition_by).orderBy(*[F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order_by])


def rank(w: WindowSpec, dense: bool = False) -> Column:
    return (F.dense_rank() if dense else F.rank()).over(w).cast("bigint")


def cumulative(x: Column, w: WindowSpec, how: str = "sum") -> Column:
    """Null until the first value."""
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(F.count(x).over(frame) >= 1, _AGGREGATES[how](finite(x)).over(frame))


def rolling(x: Column, w: WindowSpec, window: int, how: str = "mean", min_periods: int = 0) -> Column:
    """Over the last ``window`` rows; ``min_periods`` 0 asks for a full window of values."""
    if window < 1 or min_periods > window:
        raise ValueError("a window has at least one row and no more periods than rows")
    frame = w.rowsBetween(1 - window, Window.currentRow)
    return F.when(F.count(x).over(frame) >= (min_periods or window), _AGGREGATES[how](finite(x)).over(frame))


def lag(x: Column, w: WindowSpec, rows: int = 1, direction: str = "lag") -> Column:
    return (F.lag if direction == "lag" else F.lead)(x, rows).over(w)


def difference(x: Column, w: WindowSpec, order: int = 1) -> Column:
    """The difference of the given order, as one sum of lags with binomial weights."""
    if order < 1:
        raise ValueError("the order is at least 1")
    total = finite(x)
    for k in range(1, order + 1):
        total = total + F.lit(float((-1) ** k * comb(order, k))) * F.lag(finite(x), k).over(w)
    return total


def percent_change(x: Column, w: WindowSpec, periods: int = 1) -> Column:
    before = F.lag(finite(x), periods).over(w)
    return F.when(before != 0, finite(x) / before - 1)


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def backward_fill(x: Column, w: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))


def panel_difference(x: Column, entity: str, time: str, order: int = 1) -> Column:
    """Within each entity in the order of time; a repeated or missing (entity, time) is an error."""
    once = F.count(F.lit(1)).over(Window.partitionBy(entity, time)) == 1
    sound = once & F.col(entity).isNotNull() & F.col(time).isNotNull()
    return demand(sound, difference(x, spec([entity], [time]), order), "entity and time are no key")
