"""Time bars of a stream: tumbling windows with a watermark, so that state is dropped and late ticks have a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_time_bars(ticks: DataFrame, timestamp_col: str = "ts_init", price_col: str = "price", volume_col: str = "size", interval_ms: int = 60_000, watermark: str = "10 minutes", order_cols: tuple[str, ...] = ()) -> DataFrame:
    """Bars per symbol as ``TimeBar`` makes them; a bar comes out once the watermark has passed its end.

    ``timestamp_col`` is a timestamp, or epoch milliseconds. Ticks later than the watermark are left out.
    """
    if interval_ms <= 0:
        raise ValueError("interval_ms must be positive")
    kind = ticks.schema[timestamp_col].dataType.typeName()
    at = F.col(timestamp_col) if kind == "timestamp" else F.timestamp_millis(F.col(timestamp_col).cast("long"))
    order = F.struct(at.alias("ts"), *(F.col(c) for c in order_cols))
    price, size = F.col(price_col).cast("double"), F.col(volume_col).cast("double")
    rows = ticks.select(F.col("symbol"), at.alias("_at"), price.alias("_price"), size.alias("_size"), F.when(price.isNotNull(), order).alias("_order"))
    window = F.window("_at", f"{interval_ms} milliseconds")
    bars = rows.withWatermark("_at", watermark).groupBy("symbol", window.alias("w")).agg(
        F.min_by("_price", "_order").alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", "_order").alias("close"),
        F.sum("_size").alias("volume"),
        F.try_divide(F.sum(F.col("_price") * F.col("_size")), F.sum("_size")).alias("vwap"),
    )
    return bars.select("symbol", F.unix_millis("w.start").alias("start_time"), F.unix_millis("w.end").alias("end_time"), "open", "high", "low", "close", "volume", "vwap")
