"""Data of factor plots, prepared in Spark; drawing needs matplotlib and happens at the edge."""

from __future__ import annotations

from math import pi, sqrt
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.factor import Factor
from panelkit.operators.panel import to_millis

TYPES = ("timeseries", "heatmap", "distribution")
#: Points of a density curve, and cells that values are counted in for it.
POINTS, CELLS = 1_000, 4_096
#: Symbols up to which a histogram is by symbol.
BY_SYMBOL = 10


class FactorPlotter:
    def __init__(self, factor: Factor):
        self.factor = factor

    def _filtered(self, symbols=None, start_time=None, end_time=None) -> DataFrame:
        """Rows of some symbols whose ``end_time`` is within both bounds."""
        df = self.factor.df()
        if symbols is not None:
            df = df.where(F.col("symbol").isin([symbols] if isinstance(symbols, str) else list(symbols)))
        if start_time is not None:
            df = df.where(F.col("end_time") >= to_millis(start_time))
        if end_time is not None:
            df = df.where(F.col("end_time") <= to_millis(end_time))
        return df

    def timeseries(self, symbols=None, start_time=None, end_time=None) -> DataFrame:
        return self._filtered(symbols, start_time, end_time).select("symbol", "end_time", "factor").orderBy("symbol", "end_time")

    def heatmap(self, symbols=None, start_time=None, end_time=None) -> DataFrame:
        """One row per symbol, one column per end time, the first value of each."""
        df = self._filtered(symbols, start_time, end_time)
        return df.groupBy("symbol").pivot("end_time").agg(F.first("factor", ignorenulls=True)).orderBy("symbol")

    def distribution(self, symbols=None, start_time=None, end_time=None, dist_type: str = "histogram", bins: int | None = None) -> DataFrame:
        """Counts by bin: over all symbols (50 bins) or, for ten named ones or fewer, by symbol (30 bins).

        ``density`` adds each bin's share of the rows over its width; ``kde`` gives Gaussian kernel densities instead, ``x`` and
        ``density`` at 1,000 points, of values counted in 4,096 cells of the range.
        """
        if dist_type not in ("histogram", "density", "kde"):
            raise ValueError(f"unknown distribution: {dist_type}")
        together = symbols is None or (not isinstance(symbols, str) and len(symbols) > BY_SYMBOL)
        bins = bins or (50 if together else 30)
        df = self._filtered(symbols, start_time, end_time).where("factor IS NOT NULL")
        by = [] if together else ["symbol"]
        edges = df.groupBy(*by).agg(F.min("factor").alias("low"), F.max("factor").alias("high"), F.count(F.lit(1)).alias("rows"))
        rows = df.join(F.broadcast(edges), by) if by else df.crossJoin(F.broadcast(edges))
        place = F.floor(F.try_divide((F.col("factor") - F.col("low")) * bins, F.col("high") - F.col("low")))
        rows = rows.withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("long"))
        counted = rows.groupBy(*by, "bin", "low", "high", "rows").agg(F.count(F.lit(1)).alias("n"))
        width = (F.col("high") - F.col("low")) / bins
        out = counted.select(*by, "bin", (F.col("low") + F.col("bin") * width).alias("left"), (F.col("low") + (F.col("bin") + 1) * width).alias("right"), "n", "rows")
        if dist_type == "kde":
            return self._curve(rows, by)
        if dist_type == "density":
            out = out.withColumn("density", F.try_divide(F.col("n") / F.col("rows"), F.col("right") - F.col("left")))
        return out.drop("rows")

    def _curve(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """Kernel densities by Scott's rule; cells are counted first, so that the points meet cells and not rows."""
        spans = F.col("high") - F.col("low")
        cell = F.least(F.floor(F.try_divide((F.col("factor") - F.col("low")) * CELLS, spans)), F.lit(CELLS - 1))
        counted = rows.where("high > low").withColumn("cell", cell).groupBy(*by, "low", "high", "rows", "cell").agg(F.count(F.lit(1)).alias("n"), F.avg("factor").alias("v"))
        spread = rows.where("high > low").groupBy(*by).agg((F.stddev_samp("factor") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"))
        counted = counted.join(F.broadcast(spread), by) if by else counted.crossJoin(F.broadcast(spread))
        # From half the range before the least to half the range after the greatest value.
        x = F.col("low") + spans * (F.col("k") * (2.0 / (POINTS - 1)) - 0.5)
        part = F.col("n") / F.col("rows") * F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), 2)) / (F.col("h") * sqrt(2 * pi))
        points = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))))
        return points.groupBy(*by, "k", x.alias("x")).agg(F.sum(part).alias("density")).select(*by, "x", "density")

    def plot(self, plot_type: str = "timeseries", save_path: str | Path | None = None, **options) -> DataFrame:
        """The data of a plot; with ``save_path`` drawn as well, for which matplotlib is needed."""
        kind = plot_type.lower()
        if kind not in TYPES:
            raise ValueError(f"unknown plot type: {plot_type}")
        data = getattr(self, kind)(**options)
        if save_path is not None:
            if data.isEmpty():
                raise ValueError("no data to plot")
            _draw(kind, data, save_path)
        return data


def _draw(kind: str, data: DataFrame, path: str | Path) -> None:
    try:
        from matplotlib.figure import Figure
    except ImportError as e:
        raise RuntimeError("drawing needs matplotlib; the data of the plot doesn't") from e
    figure = Figure(figsize=(10, 5))
    axes = figure.add_subplot()
    rows = data.toPandas()
    if kind == "timeseries":
        for symbol, own in rows.groupby("symbol"):
            axes.plot(own["end_time"], own["factor"], label=symbol)
        axes.legend()
    elif kind == "heatmap":
        axes.imshow(rows.drop(columns="symbol").to_numpy(float), aspect="auto")
        axes.set_yticks(range(len(rows)), rows["symbol"])
    elif "x" in rows:
        for symbol, own in rows.sort_values("x").groupby("symbol") if "symbol" in rows else [("all", rows.sort_values("x"))]:
            axes.plot(own["x"], own["density"], label=symbol)
    else:
        axes.bar(rows["left"], rows["n"], width=rows["right"] - rows["left"], align="edge", alpha=0.6)
    figure.savefig(path)
