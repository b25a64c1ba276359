"""Tick to bar aggregation: time, tick, volume and dollar sampling, over many symbols at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.panel import millis

MAKER = "is_buyer_maker"
_KEYS = ("symbol", "bar_id")
#: Milliseconds of a slot that ticks of a symbol are numbered in.
SLOT_MS = 3_600_000
#: Ticks that are folded one by one where bars are shorter than this, and together where they are longer.
LONG_BAR = 48


def _ticks(df: DataFrame, ts: str, price: str, volume: str, order: tuple[str, ...]) -> DataFrame:
    """``_ts``, ``_price``, ``_size``, ``_order`` and, where they are there, ``symbol`` and ``_maker``."""
    columns = [
        millis(df, ts).alias("_ts"),
        F.col(price).cast("double").alias("_price"),
        F.col(volume).cast("double").alias("_size"),
        F.struct(millis(df, ts).alias("ts"), *(F.col(c) for c in order)).alias("_order"),
    ]
    if "symbol" in df.columns:
        columns.append(F.col("symbol"))
    if MAKER in df.columns:
        columns.append(F.col(MAKER).cast("boolean").alias("_maker"))
    return df.select(*columns)


def _aggregate(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: a hash aggregate with a map-side part; open and close are the first and last price that is there."""
    at = F.when(F.col("_price").isNotNull(), F.col("_order"))
    amounts = [
        F.min("_ts").alias("start_time"),
        F.max("_ts").alias("end_time"),
        F.min_by("_price", at).alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", at).alias("close"),
        F.sum("_size").alias("volume"),
        F.try_divide(F.sum(F.col("_price") * F.col("_size")), F.sum("_size")).alias("vwap"),
    ]
    if "_maker" in ticks.columns:
        buyer = ~F.col("_maker")
        amounts += [
            F.count_if(buyer).alias("num_buyer"),
            F.count_if("_maker").alias("num_seller"),
            F.sum(F.when(buyer, F.coalesce("_size", F.lit(0.0))).otherwise(0.0)).alias("num_buyer_volume"),
            F.sum(F.when(F.col("_maker"), F.coalesce("_size", F.lit(0.0))).otherwise(0.0)).alias("num_seller_volume"),
        ]
    return ticks.groupBy(*keys).agg(*amounts)


def _symbol_keys(ticks: DataFrame) -> list[str]:
    return ["symbol"] if "symbol" in ticks.columns else []


def _positive(value: float, name: str) -> None:
    if isinstance(value, bool) or not isinstance(value, int | float) or not value > 0:
        raise ValueError(f"{name} must be positive, not {value!r}")


class BaseBar:
    """Bars of some ticks; lazy. ``order_cols`` break ties of equal times.

    Ticks of all symbols may be in one table. A missing price is no open, high, low or close; a missing size counts as 0.
    """

    def __init__(self, df: DataFrame, timestamp_col: str, price_col: str, volume_col: str, order_cols: tuple[str, ...] = ()):
        self._columns = (timestamp_col, price_col, volume_col)
        self.ticks = _ticks(df, timestamp_col, price_col, volume_col, tuple(order_cols))
        self._bars = self._build()

    def _build(self) -> DataFrame:
        raise NotImplementedError

    def _by_id(self, ticks: DataFrame) -> DataFrame:
        keys = [*_symbol_keys(ticks), "bar_id"]
        bars = _aggregate(ticks, keys)
        return bars.select(*_symbol_keys(ticks), "start_time", "end_time", *(c for c in bars.columns if c not in (*_KEYS, "start_time", "end_time")), "bar_id")

    @property
    def bars(self) -> DataFrame:
        return self._bars

    def apply(self, features: dict[str, Column | Callable[[DataFrame], Column]]) -> BaseBar:
        """Adds columns in order; later ones see earlier ones. A feature is a column, or a function of the bars to one."""
        for name, feature in features.items():
            made = feature(self._bars) if callable(feature) and not isinstance(feature, Column) else feature
            if isinstance(made, int | float):
                made = F.lit(made)
            if not isinstance(made, Column):
                raise ValueError(f"feature {name} gives no column but {type(made).__name__}")
            self._bars = self._bars.withColumn(name, made)
        return self

    with_features = apply

    def __len__(self) -> int:
        return self._bars.count()


class TimeBar(BaseBar):
    """Bars of fixed length, aligned to the epoch, end exclusive; intervals without ticks have no bar."""

    def __init__(self, df: DataFrame, timestamp_col: str = "ts_init", price_col: str = "price", volume_col: str = "size", interval_ms: int = 60_000, order_cols: tuple[str, ...] = ()):
        _positive(interval_ms, "interval_ms")
        self.interval = int(interval_ms)
        super().__init__(df, timestamp_col, price_col, volume_col, order_cols)

    def _build(self) -> DataFrame:
        start = F.col("_ts") - F.pmod(F.col("_ts"), F.lit(self.interval))
        keys = _symbol_keys(self.ticks)
        bars = _aggregate(self.ticks.withColumn("_start", start), [*keys, "_start"]).drop("start_time", "end_time")
        times = [F.col("_start").alias("start_time"), (F.col("_start") + self.interval).alias("end_time")]
        return bars.select(*keys, *times, *(c for c in bars.columns if c not in (*keys, "_start")))


class TickBar(BaseBar):
    """Bars of a fixed number of ticks; the last one may have fewer."""

    def __init__(self, df: DataFrame, timestamp_col: str = "ts_init", price_col: str = "price", volume_col: str = "size", interval_ticks: int = 100_000, order_cols: tuple[str, ...] = ()):
        _positive(interval_ticks, "interval_ticks")
        self.interval = int(interval_ticks)
        super().__init__(df, timestamp_col, price_col, volume_col, order_cols)

    def _build(self) -> DataFrame:
        # Ticks are numbered slot by slot of time, after what the slots before have: no symbol is ordered in one task.
        keys = _symbol_keys(self.ticks)
        ticks = self.ticks.withColumn("_slot", F.floor(F.col("_ts") / SLOT_MS))
        counts = ticks.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_slot").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        same = F.col("_slot").eqNullSafe(F.col("_at"))
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        number = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy("_order"))
        rows = ticks.join(before, same).withColumn("bar_id", F.floor((number - 1) / self.interval).cast("long"))
        return self._by_id(rows.drop("_slot", "_at", "_before", *(f"_of_{k}" for k in keys)))


class _Fold:
    """The sum of one symbol's ticks since its last bar, and the number of the bar. Sums are taken one tick after the other, as
    whichever way they are taken they must be the same."""

    def __init__(self, target: float):
        self.target, self.total, self.bar, self.length = target, 0.0, 0, 2 * LONG_BAR

    def take(self, amount: np.ndarray) -> np.ndarray:
        """The bar of each tick."""
        out, at = np.empty(len(amount), np.int64), 0
        while at < len(amount):
            if self.length < LONG_BAR:
                began, first = at, self.bar
                ids = []
                for x in amount[at : at + 16 * LONG_BAR].tolist():
                    ids.append(self.bar)
                    self.total += x
                    if self.total >= self.target:
                        self.total, self.bar = 0.0, self.bar + 1
                at += len(ids)
                out[began:at] = ids
                self.length = (at - began) // max(1, self.bar - first)
                continue
            sums = amount[at : at + 2 * self.length].copy()
            sums[0] += self.total
            np.cumsum(sums, out=sums)
            over = sums >= self.target
            end = int(over.argmax())
            if over[end]:
                out[at : at + end + 1] = self.bar
                self.length, self.total, self.bar = max(1, end + 1), 0.0, self.bar + 1
                at += end + 1
            else:
                out[at : at + len(sums)] = self.bar
                self.total = float(sums[-1])
                at += len(sums)
        return out


class _ResetBar(BaseBar):
    """The tick that takes the sum to the target closes its bar, and the sum starts again from 0.

    The sum is a fold over a symbol's ticks in order. It streams through one sorted partition with a single number of
    state; a running total cannot stand in for it, as what a bar has over its target is dropped.
    """

    interval: float

    def _amount(self) -> Column:
        raise NotImplementedError

    def _build(self) -> DataFrame:
        keys, target = _symbol_keys(self.ticks), float(self.interval)
        rows = self.ticks.withColumn("_amount", F.coalesce(self._amount(), F.lit(0.0))).withColumn("bar_id", F.lit(0).cast("long"))
        rows = rows.withColumn("_group", F.col("symbol").cast("string") if keys else F.lit(""))
        names = rows.columns
        group_at, amount_at, id_at = (names.index(c) for c in ("_group", "_amount", "bar_id"))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, fold = None, _Fold(target)
            for batch in batches:
                group = batch.column(group_at).dictionary_encode()
                code, amount = group.indices.fill_null(-1).to_numpy(), batch.column(amount_at).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
                ids = [np.zeros(0, np.int64)]
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    if low == high:
                        continue
                    own = (batch.column(group_at)[low].as_py(),)
                    if own != current:
                        current, fold = own, _Fold(target)
                    ids.append(fold.take(amount[low:high]))
                columns = list(batch.columns)
                columns[id_at] = pa.array(np.concatenate(ids), pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names)

        placed = rows.repartition("_group") if keys else rows.coalesce(1)
        return self._by_id(placed.sortWithinPartitions("_group", "_order").mapInArrow(number, rows.schema))


class VolumeBar(_ResetBar):
    def __init__(self, df: DataFrame, timestamp_col: str = "time", price_col: str = "price", volume_col: str = "quote_qty", interval_volume: float = 100_000, order_cols: tuple[str, ...] = ()):
        _positive(interval_volume, "interval_volume")
        self.interval = interval_volume
        super().__init__(df, timestamp_col, price_col, volume_col, order_cols)

    def _amount(self) -> Column:
        return F.col("_size")


class DollarBar(_ResetBar):
    def __init__(self, df: DataFrame, timestamp_col: str = "ts_init", price_col: str = "price", volume_col: str = "size", interval_dollar: float = 100_000, order_cols: tuple[str, ...] = ()):
        _positive(interval_dollar, "interval_dollar")
        self.interval = interval_dollar
        super().__init__(df, timestamp_col, price_col, volume_col, order_cols)

    def _amount(self) -> Column:
        return F.col("_price") * F.col("_size")
