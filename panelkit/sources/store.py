"""Hive-partitioned tick stores: paths, date ranges, pruned scans, CSV conversion."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators.bars import TimeBar
from panelkit.operators.panel import Panel

DATA_TYPES = ("trades", "klines", "aggTrades", "bookTicker", "bookDepth")
MARKETS = ("spot", "futures")
FUTURES = ("cm", "um")
#: Columns of files without a header (fixed formats).
RAW_COLUMNS = {
    "aggTrades": "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, transact_time long, is_buyer_maker boolean",
    "trades": "id long, price double, qty double, quote_qty double, time long, is_buyer_maker boolean",
    "klines": "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, count long, taker_buy_volume double, taker_buy_quote_volume double, ignore string",
}
PARTITIONS = ("market", "data_type", "symbol", "year", "month", "day")
#: Time, price and size columns of the tick data types (fixed formats).
TICK_COLUMNS = {"aggTrades": ("transact_time", "price", "quantity"), "trades": ("time", "price", "qty")}


def get_market_string(market_type: str, futures_type: str = "") -> str:
    if market_type not in MARKETS:
        raise ValueError(f"unknown market: {market_type}")
    if market_type == "spot":
        return "spot"
    if futures_type not in FUTURES:
        raise ValueError(f"unknown futures type: {futures_type}")
    return f"futures_{futures_type}"


def build_hive_path(base: str | Path, market: str, data_type: str, symbol: str, year: int, month: int, day: int) -> str:
    return f"{base}/market={market}/data_type={data_type}/symbol={symbol}/year={year}/month={month:02d}/day={day:02d}"


def _date(value: str | dt.date | dt.datetime) -> dt.datetime:
    if isinstance(value, str):
        return dt.datetime.fromisoformat(value)
    return value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)


def date_range(start_date=None, end_date=None, days: int | None = None, now: Callable[[], dt.datetime] = dt.datetime.now) -> tuple[dt.datetime, dt.datetime]:
    """Start and exclusive end: as given; or ``days`` from a start; or else the last ``days`` (7) ending now."""
    if start_date is not None and end_date is not None:
        start, end = _date(start_date), _date(end_date)
        if start > end:
            raise ValueError("the start is after the end")
        return start, end
    if days is not None and days < 1:
        raise ValueError("days must be 1 or more")
    if start_date is not None and days is not None:
        start = _date(start_date)
        return start, start + dt.timedelta(days=days)
    end = now()
    return end - dt.timedelta(days=(days or 7) - 1), end


def date_filter(start: dt.datetime, end: dt.datetime) -> Column:
    """The day partitions from ``start`` up to but not with ``end``; prunes partitions."""
    day = F.col("year") * 10000 + F.col("month") * 100 + F.col("day")
    number = lambda d: d.year * 10000 + d.month * 100 + d.day
    return (day >= number(start)) & (day < number(end))


def read_hive_parquet(spark: SparkSession, base: str | Path, columns: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
    """A partitioned store; columns and partitions are pruned by the plan."""
    df = spark.read.option("basePath", str(base)).parquet(str(base))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


@dataclass
class Store:
    """A tick store below ``base``."""

    spark: SparkSession
    base: str
    #: Called with (symbol, data_type, market, days) for days without a file; see ``panelkit.sources.fetch``.
    fetch: Callable[[str, str, str, list[dt.date]], None] | None = None

    def _exists(self, path: str) -> bool:
        """Whether a folder has a file of data; one that is empty or holds only marks of a write does not count."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return system.exists(place) and any(not f.getPath().getName().startswith(("_", ".")) and f.getLen() > 0 for f in system.listStatus(place))

    def missing_days(self, symbol: str, data_type: str, market: str, start: dt.datetime, end: dt.datetime) -> list[dt.date]:
        days = [(start + dt.timedelta(days=k)).date() for k in range((end.date() - start.date()).days)]
        return [d for d in days if not self._exists(build_hive_path(self.base, market, data_type, symbol, d.year, d.month, d.day))]

    def load_ticks(self, symbols: str | list[str], data_type: str = "aggTrades", market_type: str = "spot", futures_type: str = "cm", start_date=None, end_date=None, days: int | None = None, columns: list[str] | None = None, force_download: bool = False) -> DataFrame:
        """Ticks of all symbols in one scan; ``symbol`` is kept whatever ``columns`` says.

        Days without a file are fetched first, if there is a way to; with ``force_download`` all days are.
        """
        if data_type not in DATA_TYPES:
            raise ValueError(f"unknown data type: {data_type}")
        named = [symbols] if isinstance(symbols, str) else list(symbols)
        if not named:
            raise ValueError("No objects to concatenate")
        market = get_market_string(market_type, futures_type)
        start, end = date_range(start_date, end_date, days)
        if self.fetch is not None:
            for symbol in named:
                every = [(start + dt.timedelta(days=k)).date() for k in range((end.date() - start.date()).days)]
                if gaps := every if force_download else self.missing_days(symbol, data_type, market, start, end):
                    self.fetch(symbol, data_type, market, gaps)
        elif force_download:
            raise ValueError("there is no way to fetch: the store has no fetcher")
        where = (F.col("market") == market) & (F.col("data_type") == data_type) & F.col("symbol").isin(named) & date_filter(start, end)
        df = read_hive_parquet(self.spark, self.base, None, where)
        return df.select(*dict.fromkeys([*columns, "symbol"])) if columns else df

    def load_aggbar(self, symbols: list[str], data_type: str = "aggTrades", interval_ms: int = 60_000, timestamp_col: str | None = None, price_col: str | None = None, volume_col: str | None = None, **where) -> Panel:
        """A panel of time bars of several symbols: one scan and one aggregation."""
        ts, price, volume = TICK_COLUMNS.get(data_type, ("time", "price", "size"))
        ticks = self.load_ticks(symbols, data_type, **where)
        return Panel(TimeBar(ticks, timestamp_col or ts, price_col or price, volume_col or volume, interval_ms).bars)


def has_header(spark: SparkSession, path: str | Path) -> bool:
    """Whether the first cell of a CSV file is no number; an empty file has no header."""
    first = spark.read.text(str(path)).first()
    if first is None or not first.value:
        return False
    try:
        float(first.value.split(",")[0].strip().strip('"'))
    except ValueError:
        return True
    return False


def read_csv(spark: SparkSession, path: str | Path, data_type: str | None = None) -> DataFrame:
    """A CSV file with a header, or without one if its data type is known."""
    if has_header(spark, path):
        return spark.read.csv(str(path), header=True, inferSchema=True)
    if data_type not in RAW_COLUMNS:
        raise ValueError("a file without a header needs a known data type")
    return spark.read.csv(str(path), schema=RAW_COLUMNS[data_type])


def csv_to_parquet(spark: SparkSession, path: str | Path, output_dir: str | Path, compression: str = "zstd", data_type: str | None = None) -> str:
    read_csv(spark, path, data_type).write.mode("overwrite").option("compression", compression).parquet(str(output_dir))
    return str(output_dir)


def write_store(ticks: DataFrame, base: str | Path, market: str, data_type: str, timestamp_col: str, compression: str = "zstd") -> str:
    """Ticks with a ``symbol`` as a partitioned store, months and days padded to two digits.

    The days of a symbol that are written take the place of what the store had of them; other days stay. A large day may
    have several files.
    """
    at = F.timestamp_millis(F.col(timestamp_col))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = {"market": F.lit(market), "data_type": F.lit(data_type), "year": F.year(at).cast("string"), "month": pad(F.month(at)), "day": pad(F.dayofmonth(at))}
    rows = ticks.withColumns(parts)
    dealt = rows.hint("rebalance", "symbol", "year", "month", "day")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(*PARTITIONS).parquet(str(base))
    return str(base)
