"""Exact results of what is spread over tasks: order statistics, tick numbers, folds, densities, rewritten stores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit import FactorEvaluator, FactorPlotter, Panel, Store, TickBar, VolumeBar
from panelkit.functions.order import percentiles
from panelkit.operators import evaluate
from panelkit.operators.bars import LONG_BAR, _Fold
from panelkit.sources import fetch, store

DAY = 86_400_000


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=1001), np.repeat([1.0, 2.0, 5.0], [400, 5, 3]), np.array([3.0]), np.array([2.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
        shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
        assert percentiles(df, "x", shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    assert percentiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == []


@pytest.mark.parametrize("size", [1, 3, LONG_BAR, 20 * LONG_BAR])
def test_folds_are_what_a_loop_gives(size):
    rng = np.random.default_rng(size)
    amount = np.concatenate([rng.random(5000), np.zeros(200), rng.random(3000) * 50])
    target, total, bar, want = 0.5 * size, 0.0, 0, []
    for x in amount.tolist():
        want.append(bar)
        total += x
        if total >= target:
            total, bar = 0.0, bar + 1
    fold = _Fold(target)
    got = np.concatenate([fold.take(part) for part in np.split(amount, [1, 7, 900, 5100])])
    assert got.tolist() == want


def test_tick_bars_run_over_slots(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(t), 1.0 + k % 5, 1.0, k) for s in ("A", "B", None) for k, t in enumerate(rng.integers(-5_000_000, 20_000_000, 200))]
    df = spark.createDataFrame(rows, "symbol string, ts_init long, price double, size double, k long").repartition(3)
    got = sorted((str(r.symbol), r.bar_id, r.start_time, r.end_time, r.volume) for r in TickBar(df, interval_ticks=7, order_cols=("k",)).bars.collect())
    want = []
    for s in ("A", "B", None):
        times = sorted((t, k) for x, t, _, _, k in rows if x == s)
        for b in range(0, len(times), 7):
            own = [t for t, _ in times[b : b + 7]]
            want.append((str(s), b // 7, own[0], own[-1], float(len(own))))
    assert got == sorted(want)
    alone = TickBar(df.where("symbol = 'A'").drop("symbol"), interval_ticks=7, order_cols=("k",)).bars
    assert alone.count() == 29 and "symbol" not in alone.columns
    assert VolumeBar(df.limit(0), "ts_init", "price", "size", 10).bars.isEmpty()


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(f"S{s}", t * DAY, (t + 1) * DAY, 100.0 + s * t + (t * (s + 3)) % 7, float((t * (s + 2)) % 5)) for s in range(6) for t in range(30) if (s * 7 + t) % 13 != 4]
    return Panel(spark.createDataFrame(rows, "symbol string, start_time long, end_time long, price double, signal double"))


def test_plans_have_no_grid(panel):
    e = FactorEvaluator(panel["signal"], panel["price"])
    for df in (e.prepare((1, 3)), e.calculate_turnover()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "CartesianProduct" not in plan


def test_returns_without_padding(panel):
    frame = panel.to_df().toPandas()
    wide = frame.pivot(index="end_time", columns="symbol", values="price").sort_index()
    want = (wide.shift(-2) / wide - 1).stack(future_stack=True)
    for r in FactorEvaluator(panel["signal"], panel["price"], fill=None).prepare((2,)).collect():
        w = want.get((r.end_time, r.symbol))
        assert (r.return_2 is None) == bool(w is None or np.isnan(w))
        assert r.return_2 is None or r.return_2 == pytest.approx(w)


def test_report_figure(panel, tmp_path):
    report = panel["signal"].eval(panel["price"], periods=(1, 2), quantiles=2, fill="pad")
    data = evaluate.report_data(report)
    assert set(data) == {"ic", "layers", "density", "turnover"} and data["layers"].count() == 2
    curve = data["density"].where("column = 'IC_1d'").orderBy("x").collect()
    values = np.array([r.IC_1d for r in data["ic"].collect() if r.IC_1d is not None])
    other = np.array([r.IC_2d for r in data["ic"].collect() if r.IC_2d is not None])
    room = 0.1 * (max(values.max(), other.max()) - min(values.min(), other.min()))
    x = np.linspace(min(values.min(), other.min()) - room, max(values.max(), other.max()) + room, 200)
    h = values.std(ddof=1) * len(values) ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert [r.x for r in curve] == pytest.approx(x.tolist()) and [r.density for r in curve] == pytest.approx(want.tolist())
    path = tmp_path / "report.png"
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="matplotlib"):
            panel["signal"].eval(panel["price"], periods=[1, 2], quantiles=2, save_path=str(path))
    else:
        panel["signal"].eval(panel["price"], periods=[1, 2], quantiles=2, save_path=str(path))
        assert path.exists()


def test_density_curve(panel):
    plotter = FactorPlotter(panel["price"])
    for options in ({}, {"symbols": ["S1", "S2"]}):
        curve = plotter.plot("distribution", dist_type="kde", **options).toPandas().sort_values("x")
        for _, own in curve.groupby("symbol") if "symbol" in curve else [("all", curve)]:
            assert len(own) == 1000 and np.trapezoid(own.density, own.x) == pytest.approx(1, abs=0.02)
    frame = panel.to_df().toPandas()
    values = frame.price.to_numpy()
    h = values.std(ddof=1) * len(values) ** -0.2
    curve = plotter.distribution(dist_type="kde").orderBy("x").toPandas()
    want = np.exp(-0.5 * ((curve.x.to_numpy()[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.allclose(curve.density, want, rtol=1e-3, atol=1e-6)


def test_factors_without_common_rows(panel):
    early, late = panel.slice(symbols=["S0"]), panel.slice(symbols=["S1"])
    for call in (lambda: early["price"].ts_corr(late["price"], 3), lambda: early["price"].ts_cov(late["price"], 3)):
        with pytest.raises(ValueError, match="No common data between factors"):
            call()


def test_days_that_are_written_again(spark, tmp_path):
    rows = [(s, d * DAY + k, 1.0, 2.0) for s in ("A", "B") for d in range(2) for k in range(5)]
    ticks = spark.createDataFrame(rows, "symbol string, transact_time long, price double, quantity double")
    for _ in range(2):
        base = store.write_store(ticks, tmp_path / "s", "spot", "aggTrades", "transact_time")
    store.write_store(ticks.where("symbol = 'A' AND transact_time < 3"), base, "spot", "aggTrades", "transact_time")
    got = store.read_hive_parquet(spark, base).groupBy("symbol", "day").agg(F.count("*").alias("n")).collect()
    assert {(r.symbol, r.day): r.n for r in got} == {("A", 1): 3, ("A", 2): 5, ("B", 1): 5, ("B", 2): 5}


def test_forced_fetches_and_empty_days(spark, tmp_path):
    base = str(tmp_path / "s")
    ticks = spark.createDataFrame([("A", 5, 1.0, 2.0)], "symbol string, transact_time long, price double, quantity double")
    store.write_store(ticks, base, "spot", "aggTrades", "transact_time")
    (tmp_path / "s/market=spot/data_type=aggTrades/symbol=A/year=1970/month=01/day=02").mkdir(parents=True)
    calls = []
    s = Store(spark, base, lambda *a: calls.append(a[3]))
    s.load_ticks("A", start_date="1970-01-01", end_date="1970-01-03")
    s.load_ticks("A", start_date="1970-01-01", end_date="1970-01-03", force_download=True)
    assert [[d.day for d in c] for c in calls] == [[2], [1, 2]]
    with pytest.raises(ValueError):
        Store(spark, base).load_ticks("A", start_date="1970-01-01", end_date="1970-01-03", force_download=True)
    assert fetch.Fetcher(spark, base, "u").work == f"{base}/.fetch"


def test_functions_of_series(panel):
    own = panel["price"].ts_apply(lambda v: v.iloc[-1] - v.iloc[0], 4)
    want = panel["price"].ts_delta(3)
    full = panel["price"].ts_mean(4)
    rows = {(r.symbol, r.end_time): (r.factor, r.want, r.full) for r in own.df().join(want.df().withColumnRenamed("factor", "want"), ["symbol", "end_time", "start_time"]).join(full.df().withColumnRenamed("factor", "full"), ["symbol", "end_time", "start_time"]).collect()}
    assert rows and all((got is None) == (full is None) and (got is None or got == pytest.approx(w)) for got, w, full in rows.values())
    spread = {r.end_time: r.factor for r in panel["signal"].cs_apply(lambda v: v.max() - v.min()).df().collect()}
    frame = panel.to_df().toPandas().groupby("end_time").signal
    assert spread == {t: float(v.max() - v.min()) for t, v in frame}
