import datetime as dt
import hashlib
import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit import FactorEvaluator, FactorPlotter, Panel, Store
from panelkit.sources import fetch, store
from panelkit.streaming.bars import stream_time_bars

DAY = 86_400_000


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for s in range(6):
        for t in range(30):
            if (s * 7 + t) % 13 != 4:
                rows.append((f"S{s}", t * DAY, (t + 1) * DAY, 100.0 + s * t + (t * (s + 3)) % 7, float((t * (s + 2)) % 5)))
    return Panel(spark.createDataFrame(rows, "symbol string, start_time long, end_time long, price double, signal double"))


@pytest.fixture(scope="module")
def frame(panel):
    return panel.to_df().toPandas()


def test_forward_returns_and_ic(panel, frame):
    e = FactorEvaluator(panel["signal"], panel["price"])
    data = e.prepare((1, 3))
    wide = frame.pivot(index="end_time", columns="symbol", values="price").sort_index().ffill()
    for p in (1, 3):
        want = (wide.shift(-p) / wide - 1).stack(future_stack=True)
        for r in data.collect():
            w = want.get((r.end_time, r.symbol))
            assert (r[f"return_{p}"] is None) == (w is None or pd.isna(w))
            if r[f"return_{p}"] is not None:
                assert r[f"return_{p}"] == pytest.approx(w)
    local = data.toPandas()
    for r in e.calculate_ic(data, (1, 3)).collect():
        for p in (1, 3):
            own = local[local.end_time == r.end_time][["factor", f"return_{p}"]].astype(float).dropna()
            w = own.rank().corr().iloc[0, 1] if len(own) > 1 else float("nan")
            assert (r[f"IC_{p}d"] is None and pd.isna(w)) or r[f"IC_{p}d"] == pytest.approx(w)


def test_turnover_and_layers(panel, frame):
    e = FactorEvaluator(panel["signal"], panel["price"])
    ranks = frame.pivot(index="end_time", columns="symbol", values="signal").sort_index().rank(axis=1, pct=True)
    before = ranks.shift(1)
    for r in e.calculate_turnover().collect():
        a, b = ranks.loc[r.end_time], before.loc[r.end_time]
        w = a.corr(b)
        assert (r.turnover is None and pd.isna(w)) or r.turnover == pytest.approx(w)
    data = e.prepare((1,))
    local = data.toPandas()
    local["q"] = pd.qcut(local.factor, 5, labels=False, duplicates="drop")
    want = local.astype({"return_1": float}).groupby("q").return_1.mean().to_dict()
    assert {r.quantile: pytest.approx(r.return_1) for r in e.run_layer_test(data, (1,), 5).collect()} == want


def test_report_and_plots(panel):
    report = panel["signal"].eval(panel["price"], (1, 3), 3)
    assert set(report.keys()) == {"ic_mean", "ic_ir", "ic_series", "turnover_mean", "turnover_series", "layer_returns", "spread"}
    assert set(report["ic_mean"]) == {"IC_1d", "IC_3d"}
    plotter = FactorPlotter(panel["signal"])
    assert plotter.plot("HEATMAP").columns[0] == "symbol"
    assert plotter.plot("distribution").agg(F.sum("n")).first()[0] == len(panel)
    dense = plotter.plot("distribution", symbols=["S1"], dist_type="density")
    assert dense.agg(F.sum(F.col("density") * (F.col("right") - F.col("left")))).first()[0] == pytest.approx(1)
    for call in (lambda: plotter.plot("pie"), lambda: plotter.distribution(dist_type="other"), lambda: plotter.plot("timeseries", symbols=["none"], save_path="x.png")):
        with pytest.raises(ValueError):
            call()


def test_constant_signal(panel):
    e = FactorEvaluator(panel["signal"] * 0, panel["price"])
    data = e.prepare((1,))
    assert e.calculate_ic(data, (1,)).where("IC_1d IS NOT NULL").isEmpty()
    assert e.run_layer_test(data, (1,)).isEmpty()


def test_date_ranges():
    now = lambda: dt.datetime(2024, 5, 10, 12)
    assert store.date_range("2024-01-01", "2024-01-05") == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5))
    assert store.date_range("2024-01-01", days=3)[1] == dt.datetime(2024, 1, 4)
    assert store.date_range(days=7, now=now) == (dt.datetime(2024, 5, 4, 12), now())
    assert store.date_range("2024-01-01", now=now) == store.date_range(now=now)
    for bad in (("2024-02-01", "2024-01-01"), (None, None, 0)):
        with pytest.raises(ValueError):
            store.date_range(*bad)
    assert store.get_market_string("futures", "um") == "futures_um"
    assert store.build_hive_path("b", "spot", "trades", "X", 2024, 1, 2).endswith("year=2024/month=01/day=02")


def test_store(spark, tmp_path):
    start = int(dt.datetime(2024, 1, 30, tzinfo=dt.UTC).timestamp() * 1000)
    rows = [(s, start + d * DAY + k * 1000, 100.0 + k, 1.0 + k) for s in ("A", "B") for d in range(4) for k in range(5)]
    ticks = spark.createDataFrame(rows, "symbol string, transact_time long, price double, quantity double")
    base = store.write_store(ticks, tmp_path / "s", "spot", "aggTrades", "transact_time")
    fetched = []
    s = Store(spark, base, lambda *a: fetched.append(a))
    got = s.load_ticks(["A"], start_date="2024-01-31", end_date="2024-02-02", columns=["price"])
    assert got.columns == ["price", "symbol"] and got.count() == 10 and not fetched
    plan = s.load_ticks(["A"], start_date="2024-01-31", end_date="2024-02-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(market" in plan and "DataFilters: []" in plan
    panel = s.load_aggbar(["A", "B"], interval_ms=DAY, start_date="2024-01-30", end_date="2024-02-03")
    assert len(panel) == 8 and panel.df.agg(F.sum("volume")).first()[0] == 2 * 4 * 15
    s.load_ticks("A", start_date="2024-01-29", end_date="2024-01-31")
    assert fetched == [("A", "aggTrades", "spot", [dt.date(2024, 1, 29)])]
    with pytest.raises(ValueError, match="No objects"):
        s.load_ticks([])


def test_csv(spark, tmp_path):
    raw, headed, odd = tmp_path / "raw.csv", tmp_path / "headed.csv", tmp_path / "empty.csv"
    raw.write_text("1,2.5,3,1,2,1704067200000,true\n2,2.6,1,3,4,1704067201000,false\n")
    headed.write_text("a,b\n1,2\n")
    odd.write_text("")
    assert [store.has_header(spark, p) for p in (raw, headed, odd)] == [False, True, False]
    store.csv_to_parquet(spark, raw, tmp_path / "out", data_type="aggTrades")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        store.read_csv(spark, raw)


def test_fetch(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x.csv", "1,2.5,3,1,2,1704067200000,true\n")
    data = buffer.getvalue()
    calls = []

    def get(url: str) -> bytes:
        calls.append(url)
        if "2024-01-02" in url:
            raise OSError("gone")
        return hashlib.sha256(data).hexdigest().encode() + b"  x.zip" if url.endswith("CHECKSUM") else data

    f = fetch.Fetcher(spark, tmp_path / "base", "u/{symbol}-{day}.zip", tmp_path / "work", get, retry_attempts=2, retry_delay=0)
    assert f("A", "aggTrades", "spot", [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]) == [dt.date(2024, 1, 2)]
    assert Store(spark, str(tmp_path / "base")).load_ticks("A", start_date="2024-01-01", end_date="2024-01-02").count() == 1
    assert sum("2024-01-02" in c for c in calls) == 2
    assert fetch.parse_args(["-s", "A", "--url", "u"]).max_concurrent == 5
    with pytest.raises(ValueError):
        fetch.validate("other", "spot", "")


def test_streaming_bars(spark, tmp_path):
    schema = "symbol string, ts_init long, price double, size double"
    rows = [("A", t * 1000, 1.0 + t % 7, 1.0) for t in range(300)] + [("A", 3_600_000, 1.0, 1.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    bars = stream_time_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), watermark="1 second")
    query = bars.writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.table("bars").orderBy("start_time").collect()
    assert [r.start_time for r in got] == [k * 60_000 for k in range(5)]
    assert got[0].open == 1.0 and got[0].close == 1.0 + 59 % 7 and got[0].volume == 60
