import pytest
from pyspark.sql import functions as F

from panelkit import DollarBar, Panel, TickBar, TimeBar, VolumeBar

COLUMNS = "symbol string, ts long, n int, price double, size double, is_buyer_maker boolean"
T0 = 1_704_067_200_000


@pytest.fixture(scope="module")
def ticks(spark):
    rows = []
    for s, scale in (("A", 1.0), ("B", 10.0)):
        for i in range(200):
            price = None if i % 17 == 5 else scale * (100 + (i * 37) % 23)
            size = None if i % 19 == 3 else float((i * 13) % 7)
            rows.append((s, T0 + (i // 2) * 3600, i, price, size, i % 3 == 0))
    rows.append(("C", T0, 0, 5.0, 0.0, True))
    # Not in time order.
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[2] * 7919) % 211), COLUMNS)


def expected(rows, ids):
    out = {}
    for (symbol, bar), own in groups(rows, ids).items():
        prices = [r["price"] for r in own if r["price"] is not None]
        sizes = [r["size"] for r in own if r["size"] is not None]
        out[symbol, bar] = (
            prices[0] if prices else None, max(prices, default=None), min(prices, default=None), prices[-1] if prices else None,
            sum(sizes) if sizes else None, sum(not r["is_buyer_maker"] for r in own), sum(r["is_buyer_maker"] for r in own),
        )
    return out


def groups(rows, ids):
    found = {}
    for r, i in zip(rows, ids, strict=True):
        found.setdefault((r["symbol"], i), []).append(r)
    return found


def ordered(ticks):
    return [r.asDict() for r in ticks.orderBy("symbol", "ts", "n").collect()]


def got(bars, key):
    return {(r["symbol"], r[key]): (r["open"], r["high"], r["low"], r["close"], r["volume"], r["num_buyer"], r["num_seller"]) for r in bars.collect()}


def test_time_bars(ticks):
    bars = TimeBar(ticks, "ts", "price", "size", 60_000, ("n",)).bars
    rows = ordered(ticks)
    assert got(bars, "start_time") == expected(rows, [r["ts"] - r["ts"] % 60_000 for r in rows])
    assert bars.where("end_time - start_time <> 60000").isEmpty()
    # A bar without volume has no vwap; no other vwap is out of its range.
    assert bars.where("volume = 0 AND vwap IS NOT NULL").isEmpty()


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_tick_bars(ticks, n):
    rows, ids, seen = ordered(ticks), [], {}
    for r in rows:
        ids.append(seen.get(r["symbol"], 0) // n)
        seen[r["symbol"]] = seen.get(r["symbol"], 0) + 1
    assert got(TickBar(ticks, "ts", "price", "size", n, ("n",)).bars, "bar_id") == expected(rows, ids)


@pytest.mark.parametrize("kind", [VolumeBar, DollarBar])
@pytest.mark.parametrize("target", [0.5, 20, 1e9])
def test_reset_bars(ticks, kind, target):
    rows, ids, state = ordered(ticks), [], {}
    for r in rows:
        total, bar = state.get(r["symbol"], (0.0, 0))
        ids.append(bar)
        amount = (r["size"] or 0.0) if kind is VolumeBar else (r["size"] * r["price"] if None not in (r["size"], r["price"]) else 0.0)
        total += amount
        state[r["symbol"]] = (0.0, bar + 1) if total >= target else (total, bar)
    assert got(kind(ticks, "ts", "price", "size", target, ("n",)).bars, "bar_id") == expected(rows, ids)


def test_volume_is_kept_by_all_kinds(ticks):
    whole = ticks.agg(F.sum("size")).first()[0]
    for kind, target in ((TimeBar, 60_000), (TickBar, 9), (VolumeBar, 30), (DollarBar, 900)):
        assert kind(ticks, "ts", "price", "size", target, ("n",)).bars.agg(F.sum("volume")).first()[0] == whole


def test_empty_and_without_symbol(spark, ticks):
    for kind in (TimeBar, TickBar, VolumeBar, DollarBar):
        assert kind(ticks.limit(0), "ts", "price", "size", 10).bars.isEmpty()
        bars = kind(ticks.where("symbol = 'A'").drop("symbol", "is_buyer_maker"), "ts", "price", "size", 10, ("n",)).bars
        assert "symbol" not in bars.columns and "num_buyer" not in bars.columns and not bars.isEmpty()


@pytest.mark.parametrize("kind", [TimeBar, TickBar, VolumeBar, DollarBar])
@pytest.mark.parametrize("bad", [0, -1, True])
def test_intervals_are_positive(ticks, kind, bad):
    with pytest.raises(ValueError):
        kind(ticks, "ts", "price", "size", bad)


def test_features(ticks):
    bar = TimeBar(ticks, "ts", "price", "size", 60_000).apply({"r": F.col("high") - F.col("low"), "half": lambda b: b["r"] / 2, "one": 1})
    row = bar.bars.where("r IS NOT NULL").first()
    assert row.half * 2 == row.r and row.one == 1
    with pytest.raises(ValueError, match="bad"):
        bar.apply({"bad": lambda b: "text"})


def test_panel(spark, ticks):
    bars = TimeBar(ticks, "ts", "price", "size", 60_000, ("n",))
    panel = Panel.from_bars([bars])
    assert panel.symbols == ["A", "B", "C"] and len(panel) == bars.bars.count()
    assert len(panel.slice(start=T0, end=T0 + 60_000)) == 3
    assert len(panel.slice(start="2024-01-01", end=T0 // 1000 + 60, symbols="A")) == 1
    assert set(panel.timestamps) >= {T0, T0 + 60_000}
    assert panel[["close"]].cols == ["start_time", "end_time", "symbol", "close"]
    for bad, error in ((["nothing"], KeyError), ("nothing", KeyError), (3, TypeError)):
        with pytest.raises(error):
            panel[bad]
    with pytest.raises(ValueError):
        Panel(spark.createDataFrame([(1,)], "a int"))
    with pytest.raises(ValueError, match="No objects"):
        Panel([])
    with pytest.raises(ValueError):
        panel.slice(start=123)
