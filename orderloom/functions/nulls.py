"""Missing-data semantics: missing is NULL, never NaN; arithmetic on it stays NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nn(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def sdiv(a: Column | str, b: Column | str) -> Column:
    """Division that gives NULL for a zero or missing divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clip that keeps NULL (least and greatest would drop it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def tnum(c: Column | str, default: float | None = None) -> Column:
    """Number of a text, or a default where it is none."""
    found = col(c).try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(default))


def gate(c: Column | str, predicate: Column) -> Column:
    """A value that counts only where a predicate holds."""
    return F.when(predicate, col(c))


def plausible(c: Column | str, low: float, high: float) -> Column:
    return F.when(col(c).between(low, high), col(c))


def first_of(*choices: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, name of its source) of the first choice that is present."""
    value = F.coalesce(*(c for _, c in choices))
    return value, reduce(lambda w, kv: w.when(kv[1].isNotNull(), F.lit(kv[0])), choices, F.when(F.lit(False), F.lit("")))


def patch(old: Column | str, cell: Column | str) -> Column:
    """Three-state cell: NA clears, empty or missing keeps, a number sets."""
    cell = col(cell)
    return F.when(cell == "NA", None).when(cell.isNull() | (cell == ""), col(old)).otherwise(tnum(cell))


def _present(cols: list[Column | str]) -> Column:
    return F.filter(F.array(*(col(c).cast("double") for c in cols)), lambda x: x.isNotNull() & ~F.isnan(x))


def row_count(*cols: Column | str) -> Column:
    return F.size(_present(list(cols)))


def row_sum(*cols: Column | str) -> Column:
    return F.aggregate(_present(list(cols)), F.lit(0.0), lambda a, x: a + x)


def row_mean(*cols: Column | str) -> Column:
    return sdiv(row_sum(*cols), row_count(*cols))


def row_median(*cols: Column | str) -> Column:
    a = F.array_sort(_present(list(cols)))
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def row_std(*cols: Column | str) -> Column:
    """Sample deviation of a row's present values."""
    a, m = _present(list(cols)), row_mean(*cols)
    return F.when(F.size(a) > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(a) - 1)))


def corr(x: Column | str, y: Column | str) -> Column:
    """Correlation aggregate; NULL where either side does not vary, for which the built-in one fails."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
