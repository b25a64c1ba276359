"""Factors: named numeric expressions over a panel, with their algebra."""

from __future__ import annotations

import math
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import nulls, rolling
from panelkit.operators.panel import KEYS, Panel
from panelkit.plans.tree import Const, Field, Node, Scalar, Windowed, compile_nodes

Number = int | float


def _is_number(value: object) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _window(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n <= 0:
        raise ValueError(f"window must be a positive integer, not {n!r}")
    return n


class Factor:
    """A lazy column on a panel; every operator keeps the rows of the panel and gives a new factor."""

    __hash__ = object.__hash__

    def __init__(self, source: Panel | DataFrame | Factor, name: str | None = None, *, node: Node | None = None):
        if isinstance(source, Factor):
            source, node, name = source.panel, node or source.node, name or source.name
        if isinstance(source, DataFrame):
            source, node = _from_frame(source)
        if not isinstance(source, Panel):
            raise TypeError("a factor is made of a panel, a DataFrame or a file")
        if node is None:
            first = next((c for c in source.cols if c not in source.keys), None)
            if first is None:
                raise ValueError("No factor columns found")
            node = Field("factor" if "factor" in source.cols else first)
        self.panel, self.node = source, node
        self.name = name or (node.name if isinstance(node, Field) else "factor")

    @classmethod
    def of_column(cls, panel: Panel, column: str) -> Factor:
        return cls(panel, column, node=Field(column))

    @classmethod
    def read(cls, spark: SparkSession, path: str | Path, name: str | None = None) -> Factor:
        """A factor from a CSV or Parquet file of keys and values."""
        kind = Path(str(path)).suffix
        if kind == ".csv":
            return cls(spark.read.csv(str(path), header=True, inferSchema=True), name)
        if kind == ".parquet":
            return cls(spark.read.parquet(str(path)), name)
        raise ValueError(f"neither CSV nor Parquet: {path}")

    @classmethod
    def from_expression(cls, expression: str, context: dict[str, Factor], name: str | None = None) -> Factor:
        from panelkit.plans.parser import evaluate

        found = evaluate(expression, context)
        return cls(found, name or found.name)

    def df(self) -> DataFrame:
        """The keys and ``factor``."""
        return factors_df({"factor": self})

    to_df = df

    def sorted(self) -> DataFrame:
        return self.df().orderBy("end_time", "symbol", "start_time", *self.panel.keys[3:])

    def __len__(self) -> int:
        return self.panel.df.count()

    def __repr__(self) -> str:
        return f"Factor({self.name})"

    # Building blocks

    def _scalar(self, key: tuple, make: Callable[..., Column], name: str, *others: Factor) -> Factor:
        return Factor(self.panel, name, node=Scalar(key, make, (self.node, *(o.node for o in others))))

    def _rolling(self, key: tuple, make: Callable[..., Column], name: str, *others: Factor) -> Factor:
        return Factor(self.panel, name, node=Windowed(key, make, (self.node, *(o.node for o in others))))

    def _aligned(self, *others: Factor) -> tuple[Factor, ...]:
        """The factors on one panel: the same one without a join, else an inner join on the keys."""
        found = (self, *others)
        for k in range(1, len(found)):
            if found[k].panel is not found[0].panel and found[k].panel.df is not found[0].panel.df:
                joined = _joined(found[0], found[k])
                # Earlier ones share the first panel, so they move along with it.
                moved = [_joined_part(found[0], x, joined) for x in found[:k]]
                found = (*moved, Factor(joined, found[k].name, node=Field("_right")), *found[k + 1 :])
        return found

    def _binary(self, other: Factor | Number, op: str, make: Callable[[Column, Column], Column]) -> Factor:
        if isinstance(other, Factor):
            a, b = self._aligned(other)
            return a._scalar((op,), make, f"({self.name}{op}{other.name})", b)
        if not _is_number(other):
            return NotImplemented
        node = Scalar((op,), make, (self.node, Const(float(other))))
        return Factor(self.panel, f"({self.name}{op}{other})", node=node)

    def _reflected(self, other: Number, op: str, make: Callable[[Column, Column], Column]) -> Factor:
        if not _is_number(other):
            return NotImplemented
        return Factor(self.panel, f"({other}{op}{self.name})", node=Scalar((op,), make, (Const(float(other)), self.node)))

    # Arithmetic and comparison

    def __neg__(self) -> Factor:
        return self._scalar(("neg",), lambda x: -x, f"-{self.name}")

    def __add__(self, other):
        return self._binary(other, "+", lambda x, y: x + y)

    def __radd__(self, other):
        return self._reflected(other, "+", lambda x, y: x + y)

    def __sub__(self, other):
        return self._binary(other, "-", lambda x, y: x - y)

    def __rsub__(self, other):
        return self._reflected(other, "-", lambda x, y: x - y)

    def __mul__(self, other):
        return self._binary(other, "*", lambda x, y: x * y)

    def __rmul__(self, other):
        return self._reflected(other, "*", lambda x, y: x * y)

    def __truediv__(self, other):
        """By a number, missing only if it is 0; by a factor, where it is within 1e-10 of 0."""
        if _is_number(other):
            return self._binary(other, "/", nulls.div_nonzero)
        return self._binary(other, "/f", nulls.safe_div)._renamed_op("/f", "/")

    def _renamed_op(self, old: str, new: str) -> Factor:
        return Factor(self, self.name.replace(old, new, 1))

    def __rtruediv__(self, other):
        return self._reflected(other, "/", nulls.div_nonzero)

    def __pow__(self, other):
        return self.pow(other)

    def __lt__(self, other):
        return self._binary(other, "<", lambda x, y: nulls.compare(x < y, 0))

    def __le__(self, other):
        return self._binary(other, "<=", lambda x, y: nulls.compare(x <= y, 0))

    def __gt__(self, other):
        return self._binary(other, ">", lambda x, y: nulls.compare(x > y, 0))

    def __ge__(self, other):
        return self._binary(other, ">=", lambda x, y: nulls.compare(x >= y, 0))

    def __eq__(self, other):
        return self._binary(other, "==", lambda x, y: nulls.compare(x == y, 0))

    def __ne__(self, other):
        return self._binary(other, "!=", lambda x, y: nulls.compare(x != y, 1))

    def add(self, other):
        return self + other

    def sub(self, other):
        return self - other

    def mul(self, other):
        return self * other

    def div(self, other):
        return self / other

    # Functions of one row

    def abs(self) -> Factor:
        return self._scalar(("abs",), F.abs, f"abs({self.name})")

    def sign(self) -> Factor:
        return self._scalar(("sign",), F.signum, f"sign({self.name})")

    def inverse(self) -> Factor:
        return self._scalar(("inverse",), lambda x: F.when(x != 0, 1 / x), f"inverse({self.name})")

    def log(self, base: Number | None = None) -> Factor:
        if base is None:
            return self._scalar(("log",), lambda x: F.when(x > 0, F.log(x)), f"log({self.name})")
        if base <= 0 or base == 1:
            raise ValueError("the base of a logarithm is positive and not 1")
        scale = math.log(base)
        return self._scalar(("log", base), lambda x: F.when(x > 0, F.log(x) / scale), f"log({self.name},{base})")

    def ln(self) -> Factor:
        return self.log()

    def sqrt(self) -> Factor:
        """Missing for 0 as for negative values."""
        return self._scalar(("sqrt",), lambda x: F.when(x > 0, F.sqrt(x)), f"sqrt({self.name})")

    def signed_log1p(self) -> Factor:
        return self._scalar(("signed_log1p",), lambda x: F.signum(x) * F.log1p(F.abs(x)), f"signed_log1p({self.name})")

    def _with(self, other: Factor | Number, op: str, make: Callable[[Column, Column], Column]) -> Factor:
        made = self._binary(other, op, make)
        if made is NotImplemented:
            raise TypeError(f"{op}: a factor or a number is needed")
        named = other.name if isinstance(other, Factor) else other
        return Factor(made, f"{op}({self.name},{named})")

    def pow(self, exponent: Factor | Number) -> Factor:
        return self._with(exponent, "pow", lambda x, e: F.pow(x, e))

    def signed_pow(self, exponent: Factor | Number) -> Factor:
        return self._with(exponent, "signed_pow", lambda x, e: F.signum(x) * F.pow(F.abs(x), e))

    def max(self, other: Factor | Number) -> Factor:
        return self._with(other, "max", lambda x, y: nulls.both(x, y, F.greatest(x, y)))

    def min(self, other: Factor | Number) -> Factor:
        return self._with(other, "min", lambda x, y: nulls.both(x, y, F.least(x, y)))

    def where(self, cond: Factor, other: Factor | Number | None = None) -> Factor:
        """The value where ``cond`` is there and not 0, else ``other``."""
        if not isinstance(cond, Factor):
            raise ValueError("the condition must be a factor")
        make = lambda x, c, o: F.when(F.coalesce(c != 0, F.lit(False)), x).otherwise(o)
        if isinstance(other, Factor):
            x, c, o = self._aligned(cond, other)
            return x._scalar(("where",), make, f"where({self.name},{cond.name},{other.name})", c, o)
        if other is not None and not _is_number(other):
            raise TypeError("the other value must be a factor or a number")
        fill = None if other is None or math.isnan(other) else float(other)
        x, c = self._aligned(cond)
        return Factor(x.panel, f"where({self.name},{cond.name},{other})", node=Scalar(("where",), make, (x.node, c.node, Const(fill))))

    def reverse(self) -> Factor:
        return Factor(-self, f"reverse({self.name})")

    # Functions of a cross-section, all symbols at one end time

    def _across(self, kind: str, make: Callable[..., Column], validate: bool) -> Factor:
        from pyspark.sql import Window

        def value(f: rolling.Frame, x: Column) -> Column:
            w = Window.partitionBy("end_time")
            return rolling.cs_guarded(f, x, w, make(f, x, w))

        if validate and self.df().where("factor IS NOT NULL").isEmpty():
            raise ValueError("All factor values are NaN")
        return self._rolling((f"cs_{kind}",), value, f"{kind}({self.name})")

    def rank(self, validate: bool = False) -> Factor:
        """Least rank over group size; missing where all values are equal."""
        return self._across(
            "rank",
            lambda f, x, w: F.when(f.pull(F.min(x).over(w)) != f.pull(F.max(x).over(w)), f.pull(F.rank().over(w.orderBy(x))) / f.pull(F.count(F.lit(1)).over(w))),
            validate,
        )

    def mean(self, validate: bool = False) -> Factor:
        return self._across("mean", lambda f, x, w: f.pull(F.avg(x).over(w)), validate)

    def median(self, validate: bool = False) -> Factor:
        return self._across("median", lambda f, x, w: f.pull(F.percentile(x, 0.5).over(w)), validate)

    def cs_apply(self, function: Callable) -> Factor:
        """A function of the pandas series of a cross-section to one number for all its rows; missing where a value is missing."""
        aggregate = rolling.of_series(function)
        return self._across(f"apply_{id(function)}", lambda f, x, w: f.pull(aggregate(x).over(w)), False)

    # Functions of a symbol's last rows

    def ts_apply(self, function: Callable, window: int) -> Factor:
        """A function of the pandas series of the last ``window`` values to a number; missing where a value of them is missing.

        For what no operator here does: values go through Python, window by window.
        """
        aggregate = rolling.of_series(function)
        return self._last(f"ts_apply_{id(function)}", window, lambda f, x, n: F.when(f.full(x, n), f.pull(aggregate(x).over(f.last(n)))))

    def _last(self, kind: str, window: int, make: Callable[..., Column]) -> Factor:
        _window(window)
        return self._rolling((kind, window), lambda f, x: make(f, x, window), f"{kind}({self.name},{window})")

    def ts_rank(self, window: int) -> Factor:
        return self._last("ts_rank", window, rolling.ts_rank)

    def ts_sum(self, window: int) -> Factor:
        return self._last("ts_sum", window, rolling.ts_sum)

    def ts_product(self, window: int) -> Factor:
        return self._last("ts_product", window, rolling.ts_product)

    def ts_mean(self, window: int) -> Factor:
        return self._last("ts_mean", window, rolling.ts_mean)

    def ts_median(self, window: int) -> Factor:
        return self._last("ts_median", window, rolling.ts_median)

    def ts_std(self, window: int) -> Factor:
        return self._last("ts_std", window, rolling.ts_std)

    def ts_min(self, window: int) -> Factor:
        return self._last("ts_min", window, rolling.ts_min)

    def ts_max(self, window: int) -> Factor:
        return self._last("ts_max", window, rolling.ts_max)

    def ts_step(self, start: int = 1) -> Factor:
        """The row's number within its symbol, from ``start``."""
        return self._rolling(("ts_step", start), lambda f, x: (f.number() - 1 + start).cast("double"), f"ts_step({self.name},{start})")

    def _argument(self, kind: str, window: int, make: Callable[..., Column]) -> Factor:
        number = self.ts_step(1)
        return self._rolling((kind, _window(window)), lambda f, x, n: make(f, x, window, n), f"{kind}({self.name},{window})", number)

    def ts_argmin(self, window: int) -> Factor:
        return self._argument("ts_argmin", window, rolling.ts_argmin)

    def ts_argmax(self, window: int) -> Factor:
        return self._argument("ts_argmax", window, rolling.ts_argmax)

    def ts_scale(self, window: int, constant: Number = 0) -> Factor:
        _window(window)
        return self._rolling(("ts_scale", window, constant), lambda f, x: rolling.ts_scale(f, x, window, constant), f"ts_scale({self.name},{window},{constant})")

    def ts_zscore(self, window: int) -> Factor:
        return self._last("ts_zscore", window, rolling.ts_zscore)

    def ts_quantile(self, window: int, driver: str = "gaussian") -> Factor:
        if driver not in ("gaussian", "uniform", "cauchy"):
            raise ValueError(f"unknown driver: {driver}")
        _window(window)
        return self._rolling(("ts_quantile", window, driver), lambda f, x: rolling.ts_quantile(f, x, window, driver), f"ts_quantile({self.name},{window},{driver})")

    def ts_kurtosis(self, window: int) -> Factor:
        return self._last("ts_kurtosis", window, rolling.ts_kurtosis)

    def ts_skewness(self, window: int) -> Factor:
        """Each value against its own trailing mean, so that 2 * window - 1 rows are needed."""
        d = self - self.ts_mean(window)
        return Factor(d._last("ts_skewness", window, rolling.ts_skew_of), f"ts_skewness({self.name},{window})")

    def ts_shift(self, period: int) -> Factor:
        return self._rolling(("ts_shift", period), lambda f, x: f.pull(F.lag(x, period).over(f.rows())), f"ts_shift({self.name},{period})")

    def ts_delta(self, period: int) -> Factor:
        return self._rolling(("ts_delta", period), lambda f, x: x - f.pull(F.lag(x, period).over(f.rows())), f"ts_delta({self.name},{period})")

    def _pair(self, other: Factor, kind: str, window: int, make: Callable[..., Column]) -> Factor:
        if not isinstance(other, Factor):
            raise TypeError(f"{kind} needs another factor")
        _window(window)
        a, b = self._aligned(other)
        if a.panel is not self.panel and a.panel.df.isEmpty():
            raise ValueError("No common data between factors")
        return a._rolling((kind, window), lambda f, x, y: make(f, x, y, window), f"{kind}({self.name},{other.name},{window})", b)

    def ts_corr(self, other: Factor, window: int) -> Factor:
        return self._pair(other, "ts_corr", window, rolling.ts_corr)

    def ts_cov(self, other: Factor, window: int) -> Factor:
        return self._pair(other, "ts_cov", window, rolling.ts_cov)

    def ts_cv(self, window: int) -> Factor:
        return self._last("ts_cv", window, rolling.ts_cv)

    def ts_jumpiness(self, window: int) -> Factor:
        _window(window)
        return self._rolling(("ts_jumpiness", window), lambda f, x, d: rolling.ts_jumpiness(f, x, d, window), f"ts_jumpiness({self.name},{window})", self.ts_delta(1))

    def ts_autocorr(self, window: int, lag: int = 1) -> Factor:
        if lag <= 0:
            raise ValueError("the lag must be positive")
        return Factor(self.ts_corr(self.ts_shift(lag), window), f"ts_autocorr({self.name},{window},{lag})")

    def ts_reversal_count(self, window: int) -> Factor:
        if _window(window) < 3:
            raise ValueError("the window must be 3 or more")
        return self._last("ts_reversal_count", window, rolling.ts_reversal_count)

    def ts_vr(self, window: int, k: int = 2) -> Factor:
        if k <= 0:
            raise ValueError("k must be positive")
        _window(window)
        one, many = self.ts_delta(1), self.ts_delta(k)
        return one._rolling(("ts_vr", window, k), lambda f, x, y: rolling.ts_vr(f, x, y, window, k), f"ts_vr({self.name},{window},{k})", many)

    # Evaluation and plots

    def eval(self, prices: Factor, periods: tuple[int, ...] = (1, 5, 10), quantiles: int = 5, save_path=None, **options):
        """The report of this signal against prices; ``save_path`` draws its figure, ``options`` are those of the evaluator."""
        from panelkit.operators.evaluate import FactorEvaluator

        return FactorEvaluator(self, prices, **options).run_full_report(periods, quantiles, save_path)

    def plot(self, plot_type: str = "timeseries", **options):
        from panelkit.operators.plotdata import FactorPlotter

        return FactorPlotter(self).plot(plot_type, **options)


BaseFactor = Factor


def _from_frame(df: DataFrame) -> tuple[Panel, Node]:
    """A panel of a frame of keys and values; the value column is ``factor``, or else the first that is no key."""
    keys = [k for k in (*KEYS, "bar_id") if k in df.columns]
    value = "factor" if "factor" in df.columns else next((c for c in df.columns if c not in keys), None)
    if value is None:
        raise ValueError("No factor columns found")
    return Panel(df), Field(value)


def _joined(left: Factor, right: Factor) -> Panel:
    keys = [k for k in left.panel.keys if k in right.panel.keys]
    a = compile_nodes(left.panel.df, left.panel.frame, left.panel.keys, {"_left": left.node})
    b = compile_nodes(right.panel.df, right.panel.frame, right.panel.keys, {"_right": right.node})
    if "bar_id" in b.columns and "bar_id" not in keys:
        b = b.drop("bar_id")
    return Panel(a.join(b, keys, "inner"))


def _joined_part(first: Factor, part: Factor, joined: Panel) -> Factor:
    if part is first or part.node == first.node:
        return Factor(joined, part.name, node=Field("_left"))
    more = _joined(Factor(joined, node=Field("_left")), part)
    joined.df = joined.df.join(more.df.select(*joined.keys, F.col("_right").alias(f"_p{id(part)}")), list(joined.keys), "inner")
    return Factor(joined, part.name, node=Field(f"_p{id(part)}"))


def factors_df(factors: dict[str, Factor]) -> DataFrame:
    """The keys and a column for each factor; factors of one panel are one plan and share what they have in common."""
    first = next(iter(factors.values()))
    aligned = first._aligned(*list(factors.values())[1:]) if len(factors) > 1 else (first,)
    panel = aligned[0].panel
    return compile_nodes(panel.df, panel.frame, panel.keys, {n: f.node for n, f in zip(factors, aligned, strict=True)})
