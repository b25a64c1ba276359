"""Rolling functions of one symbol over the last n rows; a window with a missing value gives a missing value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelkit.functions.normal import inverse_cauchy, inverse_normal
from panelkit.functions.nulls import EPSILON, safe_div

#: Ranks are kept this far from 0 and 1 before an inverse distribution function (fixed value).
CLIP = 1e-6


@dataclass(frozen=True)
class Frame:
    """Where windows run: the symbol column and the columns that order its rows."""

    symbol: str
    order: tuple[str, ...]
    #: Window expressions by their text: the optimizer would evaluate each use of one again, so each gets a column.
    pulled: dict[str, tuple[str, Column]] | None = field(default=None, compare=False)

    def pull(self, window: Column) -> Column:
        """A window expression, or, while a plan is compiled, the column that will hold it."""
        if self.pulled is None:
            return window
        return F.col(self.pulled.setdefault(str(window), (f"_w{len(self.pulled)}", window))[0])

    def rows(self) -> Window:
        return Window.partitionBy(self.symbol).orderBy(*self.order)

    def last(self, n: int) -> Window:
        return self.rows().rowsBetween(-(n - 1), 0)

    def number(self) -> Column:
        return self.pull(F.row_number().over(self.rows()))

    def full(self, x: Column, n: int) -> Column:
        return self.pull(F.count(x).over(self.last(n))) == n


def _aggregate(make: Callable[[Column], Column]):
    def rolling(f: Frame, x: Column, n: int) -> Column:
        return F.when(f.full(x, n), f.pull(make(x).over(f.last(n))))

    return rolling


ts_sum = _aggregate(F.sum)
ts_mean = _aggregate(F.avg)
ts_std = _aggregate(F.stddev_samp)
ts_min = _aggregate(F.min)
ts_max = _aggregate(F.max)
ts_product = _aggregate(F.product)
ts_median = _aggregate(lambda x: F.percentile(x, 0.5))


def ts_rank(f: Frame, x: Column, n: int) -> Column:
    """Share of the window that is not above its last value; missing where all values are equal."""
    w = f.last(n)
    below = F.size(F.filter(f.pull(F.collect_list(x).over(w)), lambda e: e <= x))
    return F.when(f.full(x, n) & (f.pull(F.min(x).over(w)) != f.pull(F.max(x).over(w))), below / F.lit(float(n)))


def ts_argmin(f: Frame, x: Column, n: int, number: Column) -> Column:
    """Rows since the least value, the oldest on ties."""
    return F.when(f.full(x, n), (number - f.pull(F.min_by(number, F.struct(x, number)).over(f.last(n)))).cast("double"))


def ts_argmax(f: Frame, x: Column, n: int, number: Column) -> Column:
    return F.when(f.full(x, n), (number - f.pull(F.max_by(number, F.struct(x, -number)).over(f.last(n)))).cast("double"))


def ts_scale(f: Frame, x: Column, n: int, constant: float) -> Column:
    low, high = ts_min(f, x, n), ts_max(f, x, n)
    return safe_div(x - low, high - low) + F.lit(float(constant))


def ts_zscore(f: Frame, x: Column, n: int) -> Column:
    return safe_div(x - ts_mean(f, x, n), ts_std(f, x, n))


def ts_quantile(f: Frame, x: Column, n: int, driver: str) -> Column:
    p = F.least(F.greatest(ts_rank(f, x, n), F.lit(CLIP)), F.lit(1 - CLIP))
    p = F.when(ts_rank(f, x, n).isNotNull(), p)
    return {"gaussian": inverse_normal, "uniform": lambda v: v, "cauchy": inverse_cauchy}[driver](p)


def ts_kurtosis(f: Frame, x: Column, n: int) -> Column:
    """Population excess kurtosis."""
    w = f.last(n)
    return F.when(f.full(x, n) & (f.pull(F.stddev_pop(x).over(w)) >= EPSILON), f.pull(F.kurtosis(x).over(w)))


def ts_skew_of(f: Frame, d: Column, n: int) -> Column:
    """Skewness from deviations that are there already."""
    if n <= 2:
        return F.lit(None).cast("double")
    w = f.last(n)
    square = f.pull(F.sum(d * d).over(w))
    scale = F.pow(square, F.lit(1.5)) * float((n - 1) * (n - 2))
    return F.when(f.full(d, n), safe_div(F.lit(float(n)) * f.pull(F.sum(d * d * d).over(w)), scale))


def ts_cov(f: Frame, x: Column, y: Column, n: int) -> Column:
    return F.when(f.full(x, n) & f.full(y, n), f.pull(F.covar_samp(x, y).over(f.last(n))))


def ts_corr(f: Frame, x: Column, y: Column, n: int) -> Column:
    w = f.last(n)
    varies = (f.pull(F.min(x).over(w)) != f.pull(F.max(x).over(w))) & (f.pull(F.min(y).over(w)) != f.pull(F.max(y).over(w)))
    scale = f.pull(F.stddev_samp(x).over(w)) * f.pull(F.stddev_samp(y).over(w))
    return F.when(f.full(x, n) & f.full(y, n) & varies, F.try_divide(f.pull(F.covar_samp(x, y).over(w)), scale))


def ts_cv(f: Frame, x: Column, n: int) -> Column:
    return ts_std(f, x, n) / (F.abs(ts_mean(f, x, n)) + EPSILON)


def ts_jumpiness(f: Frame, x: Column, step: Column, n: int) -> Column:
    return safe_div(ts_sum(f, F.abs(step), n), ts_max(f, x, n) - ts_min(f, x, n) + EPSILON)


def ts_reversal_count(f: Frame, x: Column, n: int) -> Column:
    """Share of sign changes between the differences of neighbouring rows in the window; from three values on."""
    w = f.last(n)
    # Structs keep missing values, so that neighbours are rows, not values.
    values = F.transform(f.pull(F.collect_list(F.struct(x.alias("v"))).over(w)), lambda s: s["v"])
    steps = F.filter(F.transform(values, lambda v, i: F.when(i > 0, v - F.get(values, i - 1))), lambda d: d.isNotNull())
    changes = F.size(F.filter(F.transform(steps, lambda d, i: F.when(i > 0, d * F.get(steps, i - 1))), lambda p: p < 0))
    return F.when((f.pull(F.count(x).over(w)) >= 3) & (F.size(steps) >= 2), F.try_divide(changes.cast("double"), (F.size(steps) - 1).cast("double")))


def ts_vr(f: Frame, one: Column, many: Column, n: int, k: int) -> Column:
    """Variance of k-step differences over k times that of single steps."""
    return safe_div(F.pow(ts_std(f, many, n), F.lit(2.0)), k * F.pow(ts_std(f, one, n), F.lit(2.0)) + EPSILON)


def of_series(function: Callable) -> Callable[[Column], Column]:
    """A function of a pandas series to a number as an aggregate; values of a window go to Python in Arrow batches."""
    import pandas as pd

    def aggregate(values):
        return float(function(values))

    # Annotations of this module are text, which the kind of the function can't be read from.
    aggregate.__annotations__ = {"values": pd.Series, "return": float}
    return F.pandas_udf(aggregate, "double")


def cs_guarded(f: Frame, x: Column, w: Window, value: Column) -> Column:
    """One missing value voids the cross-section."""
    return F.when(f.pull(F.count(x).over(w)) == f.pull(F.count(F.lit(1)).over(w)), value)
