"""Long panels of bars: one row per symbol and bar."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.rolling import Frame

KEYS = ("start_time", "end_time", "symbol")


def to_millis(value: str | int | dt.datetime | dt.date) -> int:
    """Epoch milliseconds of a time literal: text and naive datetimes are UTC, integers have 13 (ms) or 10 (s) digits."""
    if isinstance(value, bool):
        raise ValueError(f"not a time: {value!r}")
    if isinstance(value, int):
        digits = len(str(abs(value)))
        if digits == 13:
            return value
        if digits == 10:
            return value * 1000
        raise ValueError(f"a time of 10 or 13 digits is needed, not {value}")
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if not isinstance(value, dt.datetime):
        raise ValueError(f"not a time: {value!r}")
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.UTC)
    return (value - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1)


def millis(df: DataFrame, name: str) -> Column:
    """A key column in epoch milliseconds, whichever of timestamp, date or number it is."""
    kind = df.schema[name].dataType.typeName()
    column = F.col(f"`{name}`")
    return F.unix_millis(column.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else column.cast("long")


class Panel:
    """A lazy panel over a DataFrame; nothing is sorted, joined or collected until asked for.

    ``start_time`` and ``end_time`` are epoch milliseconds (timestamps are converted). Where two bars of a symbol can end
    at one time, ``bar_id`` tells them apart and is a key as well.
    """

    def __init__(self, bars: DataFrame | Iterable[DataFrame | object]):
        if isinstance(bars, DataFrame):
            df = bars
        elif isinstance(bars, Iterable) and not isinstance(bars, str | bytes):
            frames = [b if isinstance(b, DataFrame) else b.bars for b in bars]
            if not frames:
                raise ValueError("No objects to concatenate")
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        else:
            raise TypeError("a panel is made of a DataFrame or of bars")
        if missing := [k for k in KEYS if k not in df.columns]:
            raise ValueError(f"missing key columns: {', '.join(missing)}")
        times = {k: millis(df, k) for k in KEYS[:2] if df.schema[k].dataType.typeName() != "long"}
        self.df = df.withColumns(times) if times else df
        self.keys = KEYS + (("bar_id",) if "bar_id" in df.columns else ())

    @property
    def frame(self) -> Frame:
        return Frame("symbol", ("end_time", "start_time", *self.keys[3:]))

    @classmethod
    def from_bars(cls, bars: Iterable) -> Panel:
        return cls(list(bars))

    @classmethod
    def from_df(cls, df: DataFrame) -> Panel:
        return cls(df)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str | Path) -> Panel:
        return cls(spark.read.csv(str(path), header=True, inferSchema=True))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str | Path) -> Panel:
        return cls(spark.read.parquet(str(path)))

    def to_df(self) -> DataFrame:
        return self.df

    def to_csv(self, path: str | Path) -> str:
        self.df.write.mode("overwrite").csv(str(path), header=True)
        return str(path)

    def to_parquet(self, path: str | Path) -> str:
        self.df.write.mode("overwrite").parquet(str(path))
        return str(path)

    def copy(self) -> Panel:
        return Panel(self.df)

    def sorted(self) -> DataFrame:
        return self.df.orderBy("end_time", "symbol", "start_time", *self.keys[3:])

    def __getitem__(self, key: str | list[str]):
        """A factor of one column, or a panel of the keys and the named columns."""
        from panelkit.operators.factor import Factor

        if isinstance(key, str):
            if key not in self.df.columns:
                raise KeyError(key)
            return Factor.of_column(self, key)
        if isinstance(key, list):
            if missing := [k for k in key if k not in self.df.columns]:
                raise KeyError(", ".join(missing))
            return Panel(self.df.select(*dict.fromkeys([*self.keys, *key])))
        raise TypeError("a column name or a list of them")

    def slice(self, start=None, end=None, symbols: str | list[str] | None = None) -> Panel:
        """Bars that start at ``start`` or later, end at ``end`` or earlier, of some symbols."""
        df = self.df
        if start is not None:
            df = df.where(F.col("start_time") >= to_millis(start))
        if end is not None:
            df = df.where(F.col("end_time") <= to_millis(end))
        if symbols is not None:
            df = df.where(F.col("symbol").isin([symbols] if isinstance(symbols, str) else list(symbols)))
        return Panel(df)

    @property
    def cols(self) -> list[str]:
        return self.df.columns

    def symbols_df(self) -> DataFrame:
        return self.df.select("symbol").distinct()

    @property
    def symbols(self) -> list[str]:
        return [r.symbol for r in self.symbols_df().orderBy("symbol").collect()]

    def timestamps_df(self) -> DataFrame:
        """All distinct start and end times."""
        both = self.df.select(F.explode(F.array("start_time", "end_time")).alias("timestamp"))
        return both.distinct()

    @property
    def timestamps(self) -> list[int]:
        return [r.timestamp for r in self.timestamps_df().orderBy("timestamp").collect()]

    def info(self) -> DataFrame:
        """Per symbol: bars, first start, last end, and missing cells of all columns but the symbol."""

        def missing(name: str) -> Column:
            column = F.col(f"`{name}`")
            gone = column.isNull()
            if self.df.schema[name].dataType.typeName() in ("double", "float"):
                gone = gone | F.isnan(column)
            return gone.cast("long")

        cells = reduce(lambda a, b: a + b, (missing(c) for c in self.df.columns if c != "symbol"))
        return self.df.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("num_kbar"),
            F.timestamp_millis(F.min("start_time")).alias("start_time"),
            F.timestamp_millis(F.max("end_time")).alias("end_time"),
            F.sum(cells).alias("num_nan"),
        )

    def with_columns(self, columns: dict[str, Column]) -> Panel:
        return Panel(self.df.withColumns(columns))

    def __len__(self) -> int:
        return self.df.count()

    def __repr__(self) -> str:
        return f"Panel({', '.join(self.df.columns)})"


AggBar = Panel
