"""Factor evaluation: forward returns, rank information coefficient, turnover, quantile layers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import pi, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.nulls import clean
from panelkit.functions.order import percentiles
from panelkit.operators.factor import Factor

#: Points of the density of a report's correlations.
DENSITY_POINTS = 200


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of a group; missing for constant input, where the built-in one raises."""
    varies = (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    return F.when(varies, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def average_rank(x: str, by: str) -> Column:
    """Rank of the values of a group, equal values sharing the mean of their ranks."""
    w = Window.partitionBy(by).orderBy(x)
    ties = Window.partitionBy(by, x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


@dataclass
class Report:
    """The results of an evaluation; the series are lazy."""

    ic_series: DataFrame
    turnover_series: DataFrame
    layer_returns: DataFrame
    ic_mean: dict[str, float | None]
    ic_ir: dict[str, float | None]
    turnover_mean: float | None
    spread: dict[str, float | None]

    def __getitem__(self, key: str):
        return getattr(self, key)

    def keys(self) -> list[str]:
        return list(self.__dataclass_fields__)


class FactorEvaluator:
    """Holds a signal against the returns of prices. ``fill='pad'`` carries prices forward over gaps, ``None`` does not."""

    def __init__(self, factor: Factor, prices: Factor, fill: str | None = "pad"):
        if fill not in ("pad", None):
            raise ValueError("fill is 'pad' or None")
        self.factor, self.prices, self.fill = factor, prices, fill
        self.signal = factor.df().select("end_time", "symbol", "factor")

    def forward_returns(self, periods: tuple[int, ...], at: DataFrame | None = None) -> DataFrame:
        """``end_time``, ``symbol`` and ``return_p`` for each period, over that many of the distinct times of all prices.

        Rows are those of ``at`` (default: the prices') whose time is one of the prices. Times are numbered once; each row
        looks up the last price at its time and ``p`` times later among its symbol's, in one pass over the union of both.
        """
        if any(p <= 0 for p in periods):
            raise ValueError("periods must be positive")
        prices = self.prices.df().select("end_time", "symbol", F.col("factor").alias("price"))
        times = numbered_times(prices)
        cells = (prices if at is None else at).select("end_time", "symbol").distinct().join(times, "end_time")
        asks = cells.select("end_time", "symbol", "last", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), (F.col("number") + p).alias("number")) for p in (0, *periods)))).alias("ask"))
        asks = asks.select("end_time", "symbol", F.col("ask.p").alias("p"), F.col("ask.number").alias("number"), (F.col("ask.number") <= F.col("last")).alias("there"))
        known = prices.where("price IS NOT NULL").join(times, "end_time").select("symbol", "number", F.struct("number", "price").alias("known"))
        w = Window.partitionBy("symbol").orderBy("number", F.col("known").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = known.unionByName(asks, allowMissingColumns=True).withColumn("known", F.last("known", ignorenulls=True).over(w)).where("p IS NOT NULL")
        fresh = F.col("there") if self.fill else F.col("there") & (F.col("known.number") == F.col("number"))
        found = found.withColumn("price", F.when(fresh, F.col("known.price")))
        # The rows of a symbol are together already, so this is no exchange.
        wide = found.groupBy("symbol", "end_time").agg(*(F.max(F.when(F.col("p") == p, F.col("price"))).alias(f"_{p}") for p in (0, *periods)))
        return wide.select("end_time", "symbol", *(clean(F.try_divide(F.col(f"_{p}"), F.col("_0")) - 1).alias(f"return_{p}") for p in periods))

    def prepare(self, periods: tuple[int, ...]) -> DataFrame:
        """Every row of the signal with its forward returns."""
        return self.signal.join(self.forward_returns(periods, self.signal), ["end_time", "symbol"], "left")

    def calculate_ic(self, data: DataFrame, periods: tuple[int, ...]) -> DataFrame:
        """Per ``end_time`` the Spearman correlation of signal and return, ``IC_{p}d``, over rows that have both."""
        out = data.select("end_time").distinct()
        for p in periods:
            r = f"return_{p}"
            rows = data.where(F.col("factor").isNotNull() & F.col(r).isNotNull()).select("end_time", "factor", r)
            ranked = rows.select("end_time", average_rank("factor", "end_time").alias("a"), average_rank(r, "end_time").alias("b"))
            out = out.join(ranked.groupBy("end_time").agg(correlation("a", "b").alias(f"IC_{p}d")), "end_time", "left")
        return out

    def calculate_turnover(self) -> DataFrame:
        """Per ``end_time`` the correlation of ranks with those of the time before; near 1 for a steady signal."""
        rows = self.signal.where("factor IS NOT NULL")
        n = F.count(F.lit(1)).over(Window.partitionBy("end_time"))
        ranked = rows.select("end_time", "symbol", (average_rank("factor", "end_time") / n).alias("rank"))
        times = numbered_times(self.signal)
        rows = ranked.join(times, "end_time")
        w = Window.partitionBy("symbol").orderBy("number")
        # The row before counts only if it is of the time before.
        rows = rows.withColumn("before", F.when(F.lag("number").over(w) == F.col("number") - 1, F.lag("rank").over(w)))
        pairs = rows.where("before IS NOT NULL")
        return times.select("end_time").join(pairs.groupBy("end_time").agg(correlation("rank", "before").alias("turnover")), "end_time", "left")

    def run_layer_test(self, data: DataFrame, periods: tuple[int, ...], quantiles: int = 5) -> DataFrame:
        """Mean return by ``quantile`` of the signal over the whole sample; equal edges merge, as do their layers."""
        if quantiles < 1:
            raise ValueError("quantiles must be positive")
        edges = list(dict.fromkeys(percentiles(data, "factor", [k / quantiles for k in range(quantiles + 1)])))
        rows = data.where(F.col("factor").isNotNull() & F.lit(len(edges) > 1))
        below = reduce(lambda total, e: total + F.when(F.col("factor") > e, 1).otherwise(0), edges, F.lit(0))
        rows = rows.withColumn("quantile", F.greatest(below - 1, F.lit(0)).cast("long"))
        return rows.groupBy("quantile").agg(*(F.avg(f"return_{p}").alias(f"return_{p}") for p in periods))

    def run_full_report(self, periods: tuple[int, ...] = (1, 5, 10), quantiles: int = 5, save_path: str | Path | None = None) -> Report:
        """The report; with ``save_path`` its figure is drawn as well, for which matplotlib is needed."""
        data = self.prepare(tuple(periods))
        ic, turnover = self.calculate_ic(data, periods), self.calculate_turnover()
        layers = self.run_layer_test(data, periods, quantiles)
        names = [f"IC_{p}d" for p in periods]
        means = ic.agg(*(F.avg(n).alias(n) for n in names), *(F.stddev_samp(n).alias(f"{n}_std") for n in names)).first()
        ratio = lambda m, s: m / s if m is not None and s else None
        ends = layers.agg(*(F.max_by(f"return_{p}", "quantile").alias(f"top_{p}") for p in periods), *(F.min_by(f"return_{p}", "quantile").alias(f"low_{p}") for p in periods)).first()
        gap = lambda a, b: a - b if a is not None and b is not None else None
        report = Report(
            ic_series=ic,
            turnover_series=turnover,
            layer_returns=layers,
            ic_mean={n: means[n] for n in names},
            ic_ir={n: ratio(means[n], means[f"{n}_std"]) for n in names},
            turnover_mean=turnover.agg(F.avg("turnover")).first()[0],
            spread={f"return_{p}": gap(ends[f"top_{p}"], ends[f"low_{p}"]) for p in periods},
        )
        if save_path is not None:
            draw_report(report, save_path, self.factor.name)
        return report


def numbered_times(df: DataFrame) -> DataFrame:
    """The distinct ``end_time`` of some rows, their ``number`` in order and the ``last`` one; a row for each time of bars, whatever the symbols."""
    times = df.select("end_time").distinct()
    return times.select("end_time", F.row_number().over(Window.orderBy("end_time")).alias("number"), F.count(F.lit(1)).over(Window.partitionBy()).alias("last"))


def density(df: DataFrame, columns: list[str], points: int, margin: float) -> DataFrame:
    """``column``, ``x`` and ``density``: Gaussian kernel densities (bandwidth by Scott's rule) of some columns on one grid of ``points``.

    The grid reaches ``margin`` of the common range beyond it, or 0.1 where all values are equal. A column of fewer than two
    or of equal values has no density. Every value adds to every point map-side, and sums meet by point.
    """
    long = df.unpivot([], columns, "column", "v").where("v IS NOT NULL")
    ends = long.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if ends.low is None:
        return long.select("column", F.col("v").alias("x"), F.col("v").alias("density"))
    room = margin * (ends.high - ends.low) if ends.high > ends.low else 0.1
    low, step = ends.low - room, (ends.high - ends.low + 2 * room) / (points - 1)
    widths = {r.column: r.s * r.n**-0.2 for r in long.groupBy("column").agg(F.stddev_samp("v").alias("s"), F.count(F.lit(1)).alias("n")).collect() if r.n > 1 and r.s}
    if not widths:
        return long.select("column", F.col("v").alias("x"), F.col("v").alias("density")).limit(0)
    width = F.create_map(*(F.lit(x) for pair in widths.items() for x in pair))
    x = F.lit(low) + F.col("k") * step
    spread = long.withColumn("h", F.try_element_at(width, F.col("column"))).where("h IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    part = F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), 2)) / (F.col("h") * sqrt(2 * pi))
    return spread.groupBy("column", "k").agg(F.avg(part).alias("density")).select("column", x.alias("x"), "density")


def report_data(report: Report) -> dict[str, DataFrame]:
    """The data of a report's figure: correlations and turnover over time, layers of the longest period, densities of the correlations."""
    names = [c for c in report.ic_series.columns if c != "end_time"]
    last = report.layer_returns.columns[-1]
    return {
        "ic": report.ic_series,
        "layers": report.layer_returns.select("quantile", F.col(last).alias("mean_return")),
        "density": density(report.ic_series, names, DENSITY_POINTS, 0.1),
        "turnover": report.turnover_series.where("turnover IS NOT NULL"),
    }


def draw_report(report: Report, path: str | Path, name: str = "factor") -> None:
    """The figure of a report, two by two, as an image file."""
    try:
        from matplotlib.figure import Figure
    except ImportError as e:
        raise RuntimeError("drawing needs matplotlib; report_data gives the data of the figure without it") from e
    data = {k: v.toPandas() for k, v in report_data(report).items()}
    figure = Figure(figsize=(15, 12))
    figure.suptitle(f"Evaluation of {name}")
    (ic_axes, layer_axes), (density_axes, turnover_axes) = figure.subplots(2, 2)
    ic = data["ic"].sort_values("end_time")
    for column in ic.columns[1:]:
        ic_axes.plot(ic["end_time"], ic[column], label=column)
    layers = data["layers"].sort_values("quantile")
    layer_axes.bar(layers["quantile"], layers["mean_return"])
    for column, own in data["density"].sort_values("x").groupby("column"):
        density_axes.plot(own["x"], own["density"], label=column)
    turnover = data["turnover"].sort_values("end_time")
    turnover_axes.plot(turnover["end_time"], turnover["turnover"])
    for axes, title in ((ic_axes, "Rank correlation"), (layer_axes, "Layers, longest period"), (density_axes, "Density of the correlations"), (turnover_axes, "Rank autocorrelation")):
        axes.set_title(title)
        if axes in (ic_axes, density_axes):
            axes.legend()
    figure.savefig(path)
