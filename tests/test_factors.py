"""Rolling and scalar operators against plain Python on a small panel with ties, constants and missing values."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from panelkit import Factor, Panel, register_operator

MIN = 60_000


def series(s: int) -> list:
    out = []
    for i in range(40):
        v = float(((i * (7 + s) + i * i) % 11) - 4)
        out.append(None if i in (9, 23) else 3.0 if 12 <= i <= 18 else v)
    return out


VALUES = {f"S{s}": series(s) for s in range(3)}
OTHER = {k: [None if i == 30 else (i * 5 % 13) / 3 for i in range(len(v))] for k, v in VALUES.items()}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(k, i * MIN, (i + 1) * MIN, v, OTHER[k][i]) for k, own in VALUES.items() for i, v in enumerate(own)]
    return Panel(spark.createDataFrame(rows, "symbol string, start_time long, end_time long, x double, y double"))


def values(factor: Factor) -> dict:
    out = {}
    for r in factor.df().orderBy("symbol", "end_time").collect():
        out.setdefault(r.symbol, []).append(r.factor)
    return out


def check(factor: Factor, want) -> None:
    """``want(xs, ys, i)`` is the value at row i of a symbol."""
    for symbol, have in values(factor).items():
        for i, v in enumerate(have):
            w = want(VALUES[symbol], OTHER[symbol], i)
            if w is None or (isinstance(w, float) and not math.isfinite(w)):
                assert v is None, (symbol, i, v, w)
            else:
                assert v == pytest.approx(w, rel=1e-9, abs=1e-9), (symbol, i)


def full(n, function):
    def at(xs, ys, i):
        w = xs[max(0, i - n + 1) : i + 1]
        return function(w) if len(w) == n and None not in w else None

    return at


def pair(n, function):
    def at(xs, ys, i):
        a, b = xs[max(0, i - n + 1) : i + 1], ys[max(0, i - n + 1) : i + 1]
        return function(a, b) if len(a) == n and None not in a + b else None

    return at


def corr(a, b):
    if min(a) == max(a) or min(b) == max(b):
        return None
    return statistics.correlation(a, b)


def cov(a, b):
    return statistics.covariance(a, b) if len(a) > 1 else None


def kurtosis(w):
    m, sd = statistics.fmean(w), statistics.pstdev(w)
    return None if sd < 1e-10 else statistics.fmean((v - m) ** 4 for v in w) / sd**4 - 3


ROLLING = {
    "ts_sum": sum,
    "ts_mean": statistics.fmean,
    "ts_median": statistics.median,
    "ts_std": lambda w: statistics.stdev(w) if len(w) > 1 else None,
    "ts_min": min,
    "ts_max": max,
    "ts_product": math.prod,
    "ts_rank": lambda w: None if min(w) == max(w) else sum(v <= w[-1] for v in w) / len(w),
    "ts_argmin": lambda w: len(w) - 1 - w.index(min(w)),
    "ts_argmax": lambda w: len(w) - 1 - w.index(max(w)),
    "ts_scale": lambda w: None if max(w) == min(w) else (w[-1] - min(w)) / (max(w) - min(w)),
    "ts_zscore": lambda w: None if len(w) < 2 or statistics.stdev(w) <= 1e-10 else (w[-1] - statistics.fmean(w)) / statistics.stdev(w),
    "ts_cv": lambda w: statistics.stdev(w) / (abs(statistics.fmean(w)) + 1e-10) if len(w) > 1 else None,
    "ts_kurtosis": kurtosis,
}


@pytest.mark.parametrize("n", [1, 2, 5, 40, 41])
@pytest.mark.parametrize("name", sorted(ROLLING))
def test_rolling(panel, name, n):
    if name in ("ts_cv", "ts_scale") and n == 40:
        return
    check(getattr(panel["x"], name)(n), full(n, ROLLING[name]))


def test_pairs(panel):
    check(panel["x"].ts_corr(panel["y"], 5), pair(5, corr))
    check(panel["x"].ts_cov(panel["y"], 5), pair(5, cov))


def test_shift_delta_step(panel):
    at = lambda xs, i: xs[i] if 0 <= i < len(xs) else None
    less = lambda a, b: None if None in (a, b) else a - b
    for p in (0, 1, 3, -2, 50):
        check(panel["x"].ts_shift(p), lambda xs, ys, i, p=p: at(xs, i - p))
        check(panel["x"].ts_delta(p), lambda xs, ys, i, p=p: less(xs[i], at(xs, i - p)))
    check(panel["x"].ts_step(3), lambda xs, ys, i: i + 3)


def test_reversals(panel):
    def want(xs, ys, i):
        w = xs[max(0, i - 5) : i + 1]
        if sum(v is not None for v in w) < 3:
            return None
        d = [b - a for a, b in zip(w, w[1:], strict=False) if None not in (a, b)]
        return sum(a * b < 0 for a, b in zip(d, d[1:], strict=False)) / (len(d) - 1) if len(d) > 1 else None

    check(panel["x"].ts_reversal_count(6), want)


@pytest.mark.parametrize("driver", ["gaussian", "uniform", "cauchy"])
def test_quantile(panel, driver):
    def inverse(w):
        p = ROLLING["ts_rank"](w)
        if p is None:
            return None
        p = min(max(p, 1e-6), 1 - 1e-6)
        return {"gaussian": statistics.NormalDist().inv_cdf, "uniform": float, "cauchy": lambda q: math.tan(math.pi * (q - 0.5))}[driver](p)

    check(panel["x"].ts_quantile(5, driver), full(5, inverse))


def test_row_functions(panel):
    x = panel["x"]
    one = lambda f: lambda xs, ys, i: None if xs[i] is None else f(xs[i])
    check(x.abs(), one(abs))
    check(x.sqrt(), one(lambda v: math.sqrt(v) if v > 0 else None))
    check(x.log(), one(lambda v: math.log(v) if v > 0 else None))
    check(x.inverse(), one(lambda v: 1 / v if v else None))
    check(1 / x, one(lambda v: 1 / v if v else None))
    check(x / 0, one(lambda v: None))
    check(x**-1, one(lambda v: 1 / v if v else None))
    check(x**0.5, one(lambda v: math.sqrt(v) if v >= 0 else None))
    check(x.signed_pow(-1), one(lambda v: None if v == 0 else 1 / v))
    check(2 - x * 3 + 1, one(lambda v: 3 - 3 * v))
    check(x.max(0).min(2), one(lambda v: min(max(v, 0), 2)))
    check(x.where(x > 0, -1), lambda xs, ys, i: xs[i] if xs[i] is not None and xs[i] > 0 else -1)
    check(panel["y"].where(x), lambda xs, ys, i: ys[i] if xs[i] else None)
    check(x / panel["y"], lambda xs, ys, i: None if None in (xs[i], ys[i]) or abs(ys[i]) <= 1e-10 else xs[i] / ys[i])


def test_missing_comparisons(panel):
    x = panel["x"]
    for factor, missing in ((x == x, 0), (x <= x, 0), (x != x, 1), (x < 1e9, 0)):
        row = factor.df().where("symbol = 'S0'").orderBy("end_time").collect()[9]
        assert row.factor == missing


def test_nan_and_infinity_are_missing(spark):
    rows = [("A", i, i + 1, v) for i, v in enumerate([1.0, float("nan"), float("inf"), float("-inf"), None])]
    x = Panel(spark.createDataFrame(rows, "symbol string, start_time long, end_time long, x double"))["x"]
    assert [r.factor for r in x.df().orderBy("end_time").collect()] == [1.0, None, None, None, None]
    assert [r.factor for r in (x * 1e308 * 1e308).df().orderBy("end_time").collect()] == [None] * 5


def test_cross_section(spark):
    rows = [("A", 0, 1, 1.0), ("B", 0, 1, 2.0), ("C", 0, 1, 2.0), ("A", 1, 2, 5.0), ("B", 1, 2, None), ("A", 2, 3, 4.0), ("A", 3, 4, 1.0), ("B", 3, 4, 1.0)]
    x = Panel(spark.createDataFrame(rows, "symbol string, start_time long, end_time long, x double"))["x"]
    by = lambda f: [r.factor for r in f.df().orderBy("end_time", "symbol").collect()]
    assert by(x.rank())[:3] == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    assert by(x.rank())[3:] == [None] * 5
    assert by(x.mean())[3:6] == [None, None, 4.0]
    assert by(x.median())[:3] == [2.0] * 3
    with pytest.raises(ValueError, match="All factor values"):
        (x / 0).rank(validate=True)


def test_two_panels_join(panel):
    left, right = panel.slice(end="1970-01-01T00:10:00"), panel.slice(start="1970-01-01T00:05:00")
    total = left["x"] + right["y"]
    assert len(total.df().collect()) == 3 * 5
    assert len((left["x"].where(right["y"] > 0, right["x"])).df().collect()) == 3 * 5


def test_three_panels_join(panel):
    a, b, c = (panel.slice(symbols=own) for own in (["S0", "S1"], ["S1", "S2"], ["S1"]))
    got = values(a["x"].where(b["y"] > 1, c["y"]))
    same = values(panel["x"].where(panel["y"] > 1, panel["y"]))
    assert got == {"S1": same["S1"]}


@pytest.mark.parametrize(
    "call",
    [lambda x: x.ts_mean(0), lambda x: x.ts_quantile(5, "other"), lambda x: x.ts_autocorr(5, 0), lambda x: x.ts_vr(5, 0), lambda x: x.log(1), lambda x: x.where(1), lambda x: x.ts_reversal_count(2)],
)
def test_bad_arguments(panel, call):
    with pytest.raises(ValueError):
        call(panel["x"])


def test_expressions(panel):
    context = {"x": panel["x"], "y": panel["y"]}
    same = lambda text, factor: values(Factor.from_expression(text, context)) == values(factor)
    x, y = panel["x"], panel["y"]
    assert same("ts_delta(x, 3) / ts_shift(y, 3)", x.ts_delta(3) / y.ts_shift(3))
    assert same("x -1", x - 1) and same("-x", -x) and same("x - -1", x + 1)
    assert same("x + y * 2", x + y * 2) and same("(x + y) * 2", (x + y) * 2)
    assert same("1e-3 * x", x * 1e-3) and same("2 / x", 2 / x) and same("x - y - 1", (x - y) - 1)
    register_operator("twice", lambda f: f * 2)
    assert same("twice(x)", x * 2)
    for text, error in (("nope(x)", "Unknown function"), ("x + nope", "Undefined variable"), ("(x", "Failed to parse"), ("x +", "Failed to parse"), ("", "Failed to parse"), ("x ~ y", "Failed to parse"), ("1 + 2", "no factor"), ("np(x)", "Unknown function")):
        with pytest.raises(ValueError, match=error):
            Factor.from_expression(text, context)


def test_equal_parts_are_one_column(panel):
    m = panel["x"].ts_mean(5)
    plan = (m + panel["x"].ts_mean(5) * m).df()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") == 1


def test_factor_sources(spark, panel, tmp_path):
    df = panel["x"].df().withColumn("extra", F.lit(1))
    df.write.parquet(str(tmp_path / "f.parquet"))
    assert values(Factor.read(spark, tmp_path / "f.parquet")) == VALUES
    assert Factor(df.drop("extra").withColumnRenamed("factor", "signal")).name == "signal"
    with pytest.raises(ValueError):
        Factor.read(spark, tmp_path / "f.txt")
    with pytest.raises(ValueError, match="No factor columns"):
        Factor(df.drop("extra", "factor"))
