"""Queries over the test tables, one per operator, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import normal
from panelkit.operators.bars import DollarBar, TickBar, TimeBar, VolumeBar
from panelkit.operators.evaluate import FactorEvaluator, report_data
from panelkit.operators.factor import Factor
from panelkit.operators.panel import Panel
from panelkit.operators.plotdata import FactorPlotter
from panelkit.sources.store import csv_to_parquet, date_filter, date_range, read_hive_parquet, write_store

HOUR = 3_600_000
DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


# Views of the test tables as ticks and panels


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of one symbol per event type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("value").alias("price"),
        (F.col("event_id") % 10 + 1).cast("double").alias("size"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
        "event_id",
    )


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
    )


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TimeBar(event_ticks(spark, sf_dir), "ts", "price", "size", HOUR, ("event_id",)).bars


def panel(spark: SparkSession, sf_dir: str) -> Panel:
    """Hour bars, ``x`` with a missing value in every eleventh hour, ``tie`` with few distinct values, ``z`` around 0."""
    hour = F.col("start_time") / HOUR
    return Panel(hour_bars(spark, sf_dir)).with_columns(
        {
            "x": F.when(hour % 11 != 3, F.col("close")),
            "tie": F.floor(F.col("close") / 50).cast("double"),
            "z": F.floor(F.col("close") / 10).cast("double") - 5,
        }
    )


TICKS_SQL = """ticks AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts, value AS price, CAST(event_id % 10 + 1 AS DOUBLE) AS size,
  user_id % 2 = 0 AS maker, event_id FROM events)"""
_OHLC = """arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close,
  sum(size) AS volume, sum(price * size) / sum(size) AS vwap, count(*) FILTER (NOT maker) AS num_buyer, count(*) FILTER (maker) AS num_seller,
  sum(CASE WHEN NOT maker THEN size ELSE 0 END) AS num_buyer_volume, sum(CASE WHEN maker THEN size ELSE 0 END) AS num_seller_volume"""
BARS_SQL = f"""{TICKS_SQL}, bars AS (SELECT symbol, ts - ts % {HOUR} AS start_time, ts - ts % {HOUR} + {HOUR} AS end_time, {_OHLC}
  FROM ticks GROUP BY ALL)"""
PANEL_SQL = f"""{BARS_SQL}, panel AS (SELECT *, CASE WHEN (start_time // {HOUR}) % 11 <> 3 THEN close END AS x,
  floor(close / 50) AS tie, floor(close / 10) - 5 AS z FROM bars)"""
_BAR_COLUMNS = ("open", "high", "low", "close", "volume", "vwap", "num_buyer_volume", "num_seller_volume")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, and no negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def _round_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in columns)


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def _factor(name: str, make: Callable[[Panel], Factor], sql: str | None, ctes: str = "", source: str = "panel") -> None:
    """A query of one factor: the keys and ``factor``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(make(panel(spark, sf_dir)).df())

    body = None if sql is None else f"WITH {PANEL_SQL}{ctes} SELECT symbol, start_time, end_time, round(CAST({sql} AS DOUBLE), {DIGITS}) + 0.0 AS factor FROM {source}"
    _add(name, query, body)


# Bars

_bar_sql = f"SELECT symbol, start_time, end_time, num_buyer, num_seller, {_round_sql(list(_BAR_COLUMNS))} FROM bars"
_add("bar_time_maker", lambda s, d: rounded(hour_bars(s, d)), f"WITH {BARS_SQL} {_bar_sql}")
_add(
    "bar_time",
    lambda s, d: rounded(TimeBar(line_ticks(s, d), "ts", "price", "size", 86_400_000).bars.drop("open", "close"), 8),
    f"""SELECT l_returnflag || l_linestatus AS symbol, epoch_ms(l_shipdate) - epoch_ms(l_shipdate) % 86400000 AS start_time,
      epoch_ms(l_shipdate) - epoch_ms(l_shipdate) % 86400000 + 86400000 AS end_time,
      round(max(l_extendedprice / l_quantity), 8) + 0.0 AS high, round(min(l_extendedprice / l_quantity), 8) + 0.0 AS low,
      round(sum(l_quantity), 8) + 0.0 AS volume, round(sum(l_extendedprice / l_quantity * l_quantity) / sum(l_quantity), 8) + 0.0 AS vwap
      FROM lineitem GROUP BY ALL""",
)
_ID_BARS = f"bars AS (SELECT symbol, bar_id, min(ts) AS start_time, max(ts) AS end_time, {_OHLC} FROM numbered GROUP BY ALL)"
_ID_SELECT = f"SELECT symbol, bar_id, start_time, end_time, num_buyer, num_seller, {_round_sql(list(_BAR_COLUMNS))} FROM bars"
_add(
    "bar_tick",
    lambda s, d: rounded(TickBar(event_ticks(s, d), "ts", "price", "size", 50, ("event_id",)).bars),
    f"""WITH {TICKS_SQL}, numbered AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1) // 50 AS bar_id FROM ticks), {_ID_BARS} {_ID_SELECT}""",
)


def _reset_sql(amount: str, target: float) -> str:
    return f"""WITH RECURSIVE {TICKS_SQL},
      placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS rn FROM ticks),
      walk(symbol, rn, bar_id, total) AS (
        SELECT symbol, rn, CAST(0 AS BIGINT), CAST({amount} AS DOUBLE) FROM placed WHERE rn = 1
        UNION ALL
        SELECT p.symbol, p.rn, w.bar_id + CASE WHEN w.total >= {target} THEN 1 ELSE 0 END,
          CASE WHEN w.total >= {target} THEN 0.0 ELSE w.total END + {amount.replace("price", "p.price").replace("size", "p.size")}
        FROM walk w JOIN placed p ON p.symbol = w.symbol AND p.rn = w.rn + 1),
      numbered AS (SELECT p.*, w.bar_id FROM placed p JOIN walk w USING (symbol, rn)), {_ID_BARS} {_ID_SELECT}"""


_add("bar_volume", lambda s, d: rounded(VolumeBar(event_ticks(s, d), "ts", "price", "size", 200, ("event_id",)).bars), _reset_sql("size", 200))
_add("bar_dollar", lambda s, d: rounded(DollarBar(event_ticks(s, d), "ts", "price", "size", 10_000, ("event_id",)).bars), _reset_sql("price * size", 10_000))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    bar = TimeBar(event_ticks(spark, sf_dir), "ts", "price", "size", HOUR, ("event_id",))
    bar.apply({"range": F.col("high") - F.col("low"), "double_range": lambda bars: bars["range"] * 2})
    return rounded(bar.bars.select("symbol", "start_time", "end_time", "range", "double_range"))


_add("bar_features", _features, f"WITH {BARS_SQL} SELECT symbol, start_time, end_time, round(high - low, 6) + 0.0 AS range, round((high - low) * 2, 6) + 0.0 AS double_range FROM bars")

# Panels

_add("panel_project", lambda s, d: rounded(panel(s, d)[["open", "close"]].to_df()), f"WITH {PANEL_SQL} SELECT start_time, end_time, symbol, {_round_sql(['open', 'close'])} FROM panel")



def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel(spark, sf_dir).slice("2024-01-03", "2024-01-10T12:00:00", ["click", "view", "purchase"])[["close"]].to_df())


_add(
    "panel_slice",
    _slice,
    f"""WITH {PANEL_SQL} SELECT start_time, end_time, symbol, {_round_sql(['close'])} FROM panel
      WHERE start_time >= epoch_ms(TIMESTAMP '2024-01-03') AND end_time <= epoch_ms(TIMESTAMP '2024-01-10 12:00:00') AND symbol IN ('click', 'view', 'purchase')""",
)
_add(
    "panel_info",
    lambda s, d: panel(s, d)[["x"]].info().withColumns({c: F.unix_millis(c) for c in ("start_time", "end_time")}),
    f"WITH {PANEL_SQL} SELECT symbol, count(*) AS num_kbar, min(start_time) AS start_time, max(end_time) AS end_time, count(*) - count(x) AS num_nan FROM panel GROUP BY symbol",
)
_add("panel_symbols", lambda s, d: panel(s, d).symbols_df(), f"WITH {PANEL_SQL} SELECT DISTINCT symbol FROM panel")
_add("panel_timestamps", lambda s, d: panel(s, d).timestamps_df(), f"WITH {PANEL_SQL} SELECT start_time AS timestamp FROM panel UNION SELECT end_time FROM panel")


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = event_ticks(spark, sf_dir)
    bars = [TimeBar(ticks.where(F.col("symbol") == x), "ts", "price", "size", HOUR, ("event_id",)) for x in ("click", "view")]
    return rounded(Panel.from_bars(bars).to_df().select("symbol", "start_time", "end_time", "close"))


_add("panel_union", _union, f"WITH {BARS_SQL} SELECT symbol, start_time, end_time, {_round_sql(['close'])} FROM bars WHERE symbol IN ('click', 'view')")

# Arithmetic and comparison

_DIV = "CASE WHEN abs({y}) > 1e-10 THEN {x} / {y} END"
_factor("f_add", lambda p: p["x"] + p["open"], "x + open")
_factor("f_sub", lambda p: p["x"] - p["open"], "x - open")
_factor("f_mul", lambda p: p["x"] * p["open"], "x * open")
_factor("f_div", lambda p: p["close"] / p["z"], _DIV.format(x="close", y="z"))
_factor("f_div_scalar", lambda p: p["x"] / 4, "x / 4")
_factor("f_div_zero", lambda p: p["x"] / 0, "CAST(NULL AS DOUBLE)")
_factor("f_div_eps", lambda p: p["close"] * 1e-10 / (p["z"] * 1e-10), "CASE WHEN abs(z * 1e-10) > 1e-10 THEN close * 1e-10 / (z * 1e-10) END")
_factor("f_rdiv", lambda p: 2 / p["z"], "CASE WHEN z <> 0 THEN 2 / z END")
_factor("f_neg", lambda p: -p["x"], "-x")
_factor("f_radd", lambda p: 1 + p["x"], "1 + x")
_factor("f_rsub", lambda p: 1 - p["x"], "1 - x")
_factor("f_rmul", lambda p: 2 * p["x"], "2 * x")
_factor("f_method_add", lambda p: p["x"].add(p["z"]).sub(1).mul(p["tie"]).div(3), "(x + z - 1) * tie / 3")
for _name, _sign in {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=="}.items():
    _factor(f"f_{_name}", lambda p, s=_sign: {"<": p["x"] < p["open"], "<=": p["x"] <= p["open"], ">": p["x"] > p["open"], ">=": p["x"] >= p["open"], "==": p["x"] == p["open"]}[s], f"coalesce(x {_sign} open, FALSE)")
_factor("f_ne", lambda p: p["x"] != p["close"], "coalesce(x <> close, TRUE)")
_factor("f_cmp_missing", lambda p: (p["x"] == p["x"]) + (p["x"] != p["x"]) * 10 + (p["x"] > -1e9) * 100, "CASE WHEN x IS NULL THEN 10 ELSE 101 END")

# Functions of one row

_factor("m_abs", lambda p: p["z"].abs(), "abs(z)")
_factor("m_sign", lambda p: p["z"].sign(), "sign(z)")
_factor("m_inverse", lambda p: p["z"].inverse(), "CASE WHEN z <> 0 THEN 1 / z END")
_factor("m_log", lambda p: p["z"].log(), "CASE WHEN z > 0 THEN ln(z) END")
_factor("m_log_base", lambda p: p["z"].log(2), "CASE WHEN z > 0 THEN ln(z) / ln(2) END")
_factor("m_ln", lambda p: p["x"].ln(), "CASE WHEN x > 0 THEN ln(x) END")
_factor("m_sqrt", lambda p: p["z"].sqrt(), "CASE WHEN z > 0 THEN sqrt(z) END")
_factor("m_signed_log1p", lambda p: p["z"].signed_log1p(), "sign(z) * ln(1 + abs(z))")
_factor("m_pow", lambda p: p["x"].pow(1.5), "CASE WHEN x >= 0 THEN pow(x, 1.5) END")
_factor("m_pow_factor", lambda p: (p["z"].abs() + 1).pow(p["tie"]), "pow(abs(z) + 1, tie)")
_factor("m_pow_operator", lambda p: p["z"] ** -1, "CASE WHEN z <> 0 THEN pow(z, -1) END")
_factor("m_signed_pow", lambda p: p["z"].signed_pow(0.5), "sign(z) * pow(abs(z), 0.5)")
_factor("m_signed_pow_factor", lambda p: p["z"].signed_pow(p["tie"]), "sign(z) * pow(abs(z), tie)")
_factor("m_where", lambda p: p["x"].where(p["z"] > 0, p["open"]), "CASE WHEN z > 0 THEN x ELSE open END")
_factor("m_where_missing", lambda p: p["open"].where(p["x"]), "CASE WHEN coalesce(x <> 0, FALSE) THEN open END")
_factor("m_max", lambda p: p["x"].max(50), "CASE WHEN x IS NOT NULL THEN greatest(x, 50) END")
_factor("m_min", lambda p: p["x"].min(50), "CASE WHEN x IS NOT NULL THEN least(x, 50) END")
_factor("m_max_factor", lambda p: p["x"].max(p["open"]), "CASE WHEN x IS NOT NULL AND open IS NOT NULL THEN greatest(x, open) END")
_factor("m_min_factor", lambda p: p["open"].min(p["x"]), "CASE WHEN x IS NOT NULL AND open IS NOT NULL THEN least(x, open) END")
_factor("m_reverse", lambda p: p["x"].reverse(), "-x")

# Functions of a symbol's last rows

N = 5
_W = "(PARTITION BY symbol ORDER BY end_time, start_time ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
W = _W.format(N - 1)
_S = "(PARTITION BY symbol ORDER BY end_time, start_time)"


def _full(value: str, *needs: str) -> str:
    guard = " AND ".join(f"count({x}) OVER {W} = {N}" for x in needs or ("x",))
    return f"CASE WHEN {guard} THEN {value} END"


for _name, _function in {"sum": "sum(x)", "mean": "avg(x)", "std": "stddev_samp(x)", "min": "min(x)", "max": "max(x)", "median": "quantile_cont(x, 0.5)"}.items():
    _factor(f"ts_{_name}", lambda p, n=f"ts_{_name}": getattr(p["x"], n)(N), _full(f"{_function} OVER {W}"))
_factor("ts_product", lambda p: (p["x"] / 100).ts_product(N), _full(f"product(x / 100) OVER {W}"))
_RANK = f"len(list_filter(list(tie) OVER {W}, lambda e: e <= tie)) / {N}.0"
_RANKED = _full(f"CASE WHEN min(tie) OVER {W} <> max(tie) OVER {W} THEN {_RANK} END", "tie")
_factor("ts_rank", lambda p: p["tie"].ts_rank(N), _RANKED)
_RN = f", numbered AS (SELECT *, row_number() OVER {_S} AS rn FROM panel)"
_factor("ts_argmin", lambda p: p["tie"].ts_argmin(N), _full(f"rn - arg_min(rn, row(tie, rn)) OVER {W}", "tie"), _RN, "numbered")
_factor("ts_argmax", lambda p: p["tie"].ts_argmax(N), _full(f"rn - arg_max(rn, row(tie, -rn)) OVER {W}", "tie"), _RN, "numbered")
_factor("ts_scale", lambda p: p["x"].ts_scale(N, 1), _full(f"CASE WHEN max(x) OVER {W} - min(x) OVER {W} > 1e-10 THEN (x - min(x) OVER {W}) / (max(x) OVER {W} - min(x) OVER {W}) + 1 END"))
_factor("ts_zscore", lambda p: p["tie"].ts_zscore(N), _full(f"CASE WHEN stddev_samp(tie) OVER {W} > 1e-10 THEN (tie - avg(tie) OVER {W}) / stddev_samp(tie) OVER {W} END", "tie"))
_CLIPPED = f", ranked AS (SELECT *, least(greatest({_RANKED}, 1e-6), 1 - 1e-6) AS p0, {_RANKED} AS raw FROM panel), clipped AS (SELECT *, CASE WHEN raw IS NOT NULL THEN p0 END AS p, p0 - 0.5 AS q FROM ranked)"


def _normal_sql() -> str:
    def ratio(pair, r: str) -> str:
        poly = [" + ".join(f"{c!r} * pow({r}, {k})" for k, c in enumerate(part)) for part in pair]
        return f"(({poly[0]}) / ({poly[1]}))"

    tail = "sqrt(-ln(least(p, 1 - p)))"
    far = f"CASE WHEN {tail} <= 5 THEN {ratio(normal.MIDDLE, f'({tail} - 1.6)')} ELSE {ratio(normal.TAIL, f'({tail} - 5)')} END"
    return f"CASE WHEN p IS NULL THEN NULL WHEN abs(q) <= 0.425 THEN q * {ratio(normal.CENTRE, '(0.180625 - q * q)')} ELSE sign(q) * {far} END"


_factor("ts_quantile_uniform", lambda p: p["tie"].ts_quantile(N, "uniform"), "p", _CLIPPED, "clipped")
_factor("ts_quantile_cauchy", lambda p: p["tie"].ts_quantile(N, "cauchy").min(1e3), "least(tan(pi() * (p - 0.5)), 1e3)", _CLIPPED, "clipped")
ORACLE["ts_quantile_cauchy"] = ORACLE["ts_quantile_cauchy"].replace("least(tan(pi() * (p - 0.5)), 1e3)", "CASE WHEN p IS NOT NULL THEN least(tan(pi() * (p - 0.5)), 1e3) END")
_factor("ts_quantile", lambda p: p["tie"].ts_quantile(N), _normal_sql(), _CLIPPED, "clipped")
_factor("ts_kurtosis", lambda p: p["x"].ts_kurtosis(N), _full(f"CASE WHEN stddev_pop(x) OVER {W} >= 1e-10 THEN kurtosis_pop(x) OVER {W} END"))
_DEV = f", dev AS (SELECT *, {_full(f'x - avg(x) OVER {W}')} AS d FROM panel)"
_SQUARES = f"(pow(sum(d * d) OVER {W}, 1.5) * {(N - 1) * (N - 2)})"
_factor("ts_skewness", lambda p: p["x"].ts_skewness(N), _full(f"CASE WHEN {_SQUARES} > 1e-10 THEN {N} * sum(d * d * d) OVER {W} / {_SQUARES} END", "d"), _DEV, "dev")
_factor("ts_step", lambda p: p["x"].ts_step(3), f"row_number() OVER {_S} + 2")
_factor("ts_shift", lambda p: p["x"].ts_shift(3), f"lag(x, 3) OVER {_S}")
_factor("ts_shift_lead", lambda p: p["x"].ts_shift(-2), f"lead(x, 2) OVER {_S}")
_factor("ts_delta", lambda p: p["x"].ts_delta(3), f"x - lag(x, 3) OVER {_S}")

_factor("ts_cov", lambda p: p["x"].ts_cov(p["volume"], N), _full(f"covar_samp(x, volume) OVER {W}", "x", "volume"))
_CORR = "CASE WHEN min({x}) OVER {w} <> max({x}) OVER {w} AND min({y}) OVER {w} <> max({y}) OVER {w} THEN covar_samp({x}, {y}) OVER {w} / (stddev_samp({x}) OVER {w} * stddev_samp({y}) OVER {w}) END"
_factor("ts_corr", lambda p: p["x"].ts_corr(p["tie"], N), _full(_CORR.format(x="x", y="tie", w=W), "x", "tie"))
_LAG = f", lagged AS (SELECT *, lag(x, 1) OVER {_S} AS x1, x - lag(x, 1) OVER {_S} AS d1, x - lag(x, 2) OVER {_S} AS d2 FROM panel)"
_factor("ts_autocorr", lambda p: p["x"].ts_autocorr(N), _full(_CORR.format(x="x", y="x1", w=W), "x", "x1"), _LAG, "lagged")
_factor("ts_cv", lambda p: p["x"].ts_cv(N), _full(f"stddev_samp(x) OVER {W} / (abs(avg(x) OVER {W}) + 1e-10)"))
_factor("ts_jumpiness", lambda p: p["x"].ts_jumpiness(N), _full(f"CASE WHEN max(x) OVER {W} - min(x) OVER {W} + 1e-10 > 1e-10 THEN sum(abs(d1)) OVER {W} / (max(x) OVER {W} - min(x) OVER {W} + 1e-10) END", "x", "d1"), _LAG, "lagged")
_VR = f"(2 * pow(stddev_samp(d1) OVER {W}, 2) + 1e-10)"
_factor("ts_vr", lambda p: p["x"].ts_vr(N, 2), _full(f"CASE WHEN {_VR} > 1e-10 THEN pow(stddev_samp(d2) OVER {W}, 2) / {_VR} END", "d1", "d2"), _LAG, "lagged")
_WIN = f"""win AS (SELECT *, count(x) OVER {W} AS present, list(row(x)) OVER {W} AS xs FROM panel),
  steps AS (SELECT *, list_filter(list_transform(range(2, len(xs) + 1), lambda i: xs[i][1] - xs[i - 1][1]), lambda d: d IS NOT NULL) AS ds FROM win)"""
_factor(
    "ts_reversal_count",
    lambda p: p["x"].ts_reversal_count(N),
    "CASE WHEN present >= 3 AND len(ds) >= 2 THEN len(list_filter(range(2, len(ds) + 1), lambda i: ds[i] * ds[i - 1] < 0)) / (len(ds) - 1) END",
    f", {_WIN}",
    "steps",
)

# Functions of a cross-section

_C = "(PARTITION BY end_time)"
_CS = "CASE WHEN count({x}) OVER " + _C + " = count(*) OVER " + _C + " THEN {value} END"
_factor("cs_rank", lambda p: p["tie"].rank(), _CS.format(x="tie", value=f"CASE WHEN min(tie) OVER {_C} <> max(tie) OVER {_C} THEN rank() OVER (PARTITION BY end_time ORDER BY tie) / (count(*) OVER {_C})::DOUBLE END"))
_factor("cs_mean", lambda p: p["close"].mean(), _CS.format(x="close", value=f"avg(close) OVER {_C}"))
_factor("cs_median", lambda p: p["close"].median(), _CS.format(x="close", value=f"quantile_cont(close, 0.5) OVER {_C}"))
_factor("cs_missing_voids", lambda p: p["close"].where(p["z"] > 0).mean(), _CS.format(x="v", value=f"avg(v) OVER {_C}"), ", voids AS (SELECT *, CASE WHEN z > 0 THEN close END AS v FROM panel)", "voids")


def _two_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    early, late = p.slice(symbols=["click", "view"]), p.slice(symbols=["view", "purchase"])
    return rounded((early["close"] - late["open"]).df())


_add("f_join_two_panels", _two_panels, f"WITH {PANEL_SQL} SELECT symbol, start_time, end_time, round(close - open, 6) + 0.0 AS factor FROM panel WHERE symbol = 'view'")



def _joined(name: str, make: Callable[[Panel, Panel], Factor], sql: str) -> None:
    """A factor of two panels that share one symbol."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = panel(spark, sf_dir)
        return rounded(make(p.slice(symbols=["click", "view"]), p.slice(symbols=["view", "purchase"])).df())

    _add(name, query, f"WITH {PANEL_SQL}, common AS (SELECT * FROM panel WHERE symbol = 'view') SELECT symbol, start_time, end_time, round(CAST({sql} AS DOUBLE), {DIGITS}) + 0.0 AS factor FROM common")


_joined("f_join_compare", lambda a, b: a["x"] < b["open"], "coalesce(x < open, FALSE)")
_joined("f_join_not_equal", lambda a, b: a["x"] != b["close"], "coalesce(x <> close, TRUE)")
_joined("f_join_max", lambda a, b: a["x"].max(b["open"]), "CASE WHEN x IS NOT NULL AND open IS NOT NULL THEN greatest(x, open) END")
_joined("f_join_pow", lambda a, b: (a["z"].abs() + 1).pow(b["tie"]), "pow(abs(z) + 1, tie)")
_joined("f_join_signed_pow", lambda a, b: a["z"].signed_pow(b["tie"]), "sign(z) * pow(abs(z), tie)")
_joined("f_join_where", lambda a, b: a["x"].where(b["z"] > 0, b["open"]), "CASE WHEN z > 0 THEN x ELSE open END")
_joined("f_join_corr", lambda a, b: a["x"].ts_corr(b["tie"], N), _full(_CORR.format(x="x", y="tie", w=W), "x", "tie"))
_joined("f_join_cov", lambda a, b: a["x"].ts_cov(b["volume"], N), _full(f"covar_samp(x, volume) OVER {W}", "x", "volume"))

# Expressions

_MOMENTUM = _DIV.format(x=f"(close - lag(close, 5) OVER {_S})", y=f"(lag(close, 5) OVER {_S})")


def _expression(name: str, text: str, sql: str, ctes: str = "", source: str = "panel") -> None:
    _factor(name, lambda p: Factor.from_expression(text, {c: p[c] for c in ("open", "close", "x", "z", "volume", "tie")}), sql, ctes, source)


_expression("expr_momentum", "ts_delta(close, 5) / ts_shift(close, 5)", _MOMENTUM)
_expression("expr_precedence", "open + close * 2 - volume / 4 / 2 - -1", "open + close * 2 - volume / 4 / 2 + 1")
_expression("expr_nested", "ts_mean(ts_delta(x, 1), 5) * (close -1)", _full(f"avg(d1) OVER {W}", "d1") + " * (close - 1)", _LAG, "lagged")
_expression("expr_scalar_left", "1e-3 + 2 - 1 / z + max(x, 50) * sub(1, close)", "1e-3 + 2 - CASE WHEN z <> 0 THEN 1 / z END + CASE WHEN x IS NOT NULL THEN greatest(x, 50) END * (1 - close)")
_expression("expr_string", "ts_quantile(tie, 5, 'uniform')", "p", _CLIPPED, "clipped")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to hour bars to cross-sectional rank of momentum."""
    close = Panel(hour_bars(spark, sf_dir))["close"]
    return rounded((close.ts_delta(5) / close.ts_shift(5)).rank().df())


_add(
    "flagship",
    flagship,
    f"""WITH {PANEL_SQL}, m AS (SELECT *, {_MOMENTUM} AS m FROM panel) SELECT symbol, start_time, end_time,
      round({_CS.format(x='m', value=f'CASE WHEN min(m) OVER {_C} <> max(m) OVER {_C} THEN rank() OVER (PARTITION BY end_time ORDER BY m) / (count(*) OVER {_C})::DOUBLE END')}, 6) + 0.0 AS factor FROM m""",
)

# Evaluation

PERIODS = (1, 5)


def _evaluator(spark: SparkSession, sf_dir: str) -> FactorEvaluator:
    p = panel(spark, sf_dir)
    return FactorEvaluator(p["tie"] + p["volume"], p["close"])


_GRID = f"""grid AS (SELECT t.end_time, s.symbol, p.close AS price FROM (SELECT DISTINCT end_time FROM panel) t CROSS JOIN (SELECT DISTINCT symbol FROM panel) s
    LEFT JOIN panel p ON p.end_time = t.end_time AND p.symbol = s.symbol),
  padded AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY end_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp FROM grid),
  ahead AS (SELECT *, {', '.join(f'CASE WHEN pp <> 0 THEN lead(pp, {k}) OVER (PARTITION BY symbol ORDER BY end_time) / pp - 1 END AS return_{k}' for k in PERIODS)} FROM padded)"""
_DATA = f"{_GRID}, data AS (SELECT p.end_time, p.symbol, tie + volume AS factor, {', '.join(f'return_{k}' for k in PERIODS)} FROM panel p LEFT JOIN ahead USING (end_time, symbol))"
_AVG_RANK = "rank() OVER (PARTITION BY end_time ORDER BY {x}) + (count(*) OVER (PARTITION BY end_time, {x}) - 1) / 2.0"
_GROUP_CORR = "CASE WHEN min(a) <> max(a) AND min(b) <> max(b) THEN covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) END"
_IC = ", ".join(
    f"""ranked_{k} AS (SELECT end_time, {_AVG_RANK.format(x='factor')} AS a, {_AVG_RANK.format(x=f'return_{k}')} AS b FROM data WHERE factor IS NOT NULL AND return_{k} IS NOT NULL),
  ic_{k} AS (SELECT end_time, {_GROUP_CORR} AS v FROM ranked_{k} GROUP BY end_time)"""
    for k in PERIODS
)
_ICS = f"{_IC}, ics AS (SELECT t.end_time, {', '.join(f'ic_{k}.v AS IC_{k}d' for k in PERIODS)} FROM (SELECT DISTINCT end_time FROM data) t {' '.join(f'LEFT JOIN ic_{k} ON ic_{k}.end_time = t.end_time' for k in PERIODS)})"
_add(
    "ev_forward_returns",
    lambda s, d: rounded(_evaluator(s, d).prepare(PERIODS)),
    f"WITH {PANEL_SQL}, {_DATA} SELECT end_time, symbol, {_round_sql(['factor', *(f'return_{k}' for k in PERIODS)])} FROM data",
)
_add(
    "ev_ic",
    lambda s, d: rounded((e := _evaluator(s, d)).calculate_ic(e.prepare(PERIODS), PERIODS)),
    f"WITH {PANEL_SQL}, {_DATA}, {_ICS} SELECT end_time, {_round_sql([f'IC_{k}d' for k in PERIODS])} FROM ics",
)
_TURN = f"""r AS (SELECT end_time, symbol, ({_AVG_RANK.format(x='factor')}) / (count(*) OVER (PARTITION BY end_time)) AS rank FROM data WHERE factor IS NOT NULL),
  dense AS (SELECT g.end_time, g.symbol, r.rank, lag(r.rank) OVER (PARTITION BY g.symbol ORDER BY g.end_time) AS before FROM grid g LEFT JOIN r ON r.end_time = g.end_time AND r.symbol = g.symbol),
  turn AS (SELECT end_time, {_GROUP_CORR.replace('(a)', '(rank)').replace('(b)', '(before)').replace('(a, b)', '(rank, before)')} AS turnover FROM dense WHERE rank IS NOT NULL AND before IS NOT NULL GROUP BY end_time),
  turns AS (SELECT t.end_time, turn.turnover FROM (SELECT DISTINCT end_time FROM data) t LEFT JOIN turn USING (end_time))"""
_add("ev_turnover", lambda s, d: rounded(_evaluator(s, d).calculate_turnover()), f"WITH {PANEL_SQL}, {_DATA}, {_TURN} SELECT end_time, {_round_sql(['turnover'])} FROM turns")
_LAYERS = f"""edges AS (SELECT list_distinct(quantile_cont(factor, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM data),
  layers AS (SELECT CAST(greatest(len(list_filter(e, lambda x: x < factor)) - 1, 0) AS BIGINT) AS quantile, {', '.join(f'avg(return_{k}) AS return_{k}' for k in PERIODS)} FROM data, edges WHERE factor IS NOT NULL AND len(e) > 1 GROUP BY 1)"""
_add(
    "ev_layers",
    lambda s, d: rounded((e := _evaluator(s, d)).run_layer_test(e.prepare(PERIODS), PERIODS, 5)),
    f"WITH {PANEL_SQL}, {_DATA}, {_LAYERS} SELECT quantile, {_round_sql([f'return_{k}' for k in PERIODS])} FROM layers",
)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    report = (p["tie"] + p["volume"]).eval(p["close"], PERIODS, 5)
    rows = [(f"ic_mean_{k}", report.ic_mean[f"IC_{k}d"]) for k in PERIODS] + [(f"ic_ir_{k}", report.ic_ir[f"IC_{k}d"]) for k in PERIODS]
    rows += [("turnover_mean", report.turnover_mean)] + [(f"spread_{k}", report.spread[f"return_{k}"]) for k in PERIODS]
    return rounded(spark.createDataFrame(rows, "name string, value double"))


_SUMMARY = " UNION ALL ".join(
    [f"SELECT 'ic_mean_{k}' AS name, avg(IC_{k}d) AS value FROM ics" for k in PERIODS]
    + [f"SELECT 'ic_ir_{k}', avg(IC_{k}d) / stddev_samp(IC_{k}d) FROM ics" for k in PERIODS]
    + ["SELECT 'turnover_mean', avg(turnover) FROM turns"]
    + [f"SELECT 'spread_{k}', arg_max(return_{k}, quantile) - arg_min(return_{k}, quantile) FROM layers" for k in PERIODS]
)
_add("ev_summary", _summary, f"WITH {PANEL_SQL}, {_DATA}, {_ICS}, {_TURN}, {_LAYERS}, named AS ({_SUMMARY}) SELECT name, {_round_sql(['value'])} FROM named")

_KERNEL = "exp(-0.5 * pow((x - v) / h, 2)) / (h * sqrt(2 * pi()))"
_LONG = " UNION ALL ".join(f"SELECT 'IC_{k}d' AS \"column\", IC_{k}d AS v FROM ics WHERE IC_{k}d IS NOT NULL" for k in PERIODS)
_add(
    "ev_report_density",
    lambda s, d: rounded(report_data((e := _evaluator(s, d)).run_full_report(PERIODS, 5))["density"]),
    f"""WITH {PANEL_SQL}, {_DATA}, {_ICS}, long AS ({_LONG}), ends AS (SELECT min(v) AS lo, max(v) AS hi, 0.1 * (max(v) - min(v)) AS room FROM long),
      points AS (SELECT k, lo - room + k * ((hi - lo + 2 * room) / 199) AS x FROM ends, range(200) t(k)), widths AS (SELECT "column", stddev_samp(v) * pow(count(*), -0.2) AS h FROM long GROUP BY ALL)
      SELECT "column", round(x, {DIGITS}) + 0.0 AS x, round(avg({_KERNEL}), {DIGITS}) + 0.0 AS density FROM long JOIN widths USING ("column") CROSS JOIN points GROUP BY "column", k, x""",
)

# Stores and files


def _place(spark: SparkSession) -> str:
    """A new folder below the session's shared folder, or a temporary one where none is set."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        return tempfile.mkdtemp(prefix="panelkit-")
    import uuid

    return f"{shared}/panelkit-{uuid.uuid4().hex}"


def _hive(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _place(spark)
    write_store(event_ticks(spark, sf_dir), base, "spot", "trades", "ts")
    start, end = date_range("2024-01-03", "2024-01-10")
    where = date_filter(start, end) & F.col("symbol").isin("click", "view") & (F.col("market") == "spot")
    return rounded(read_hive_parquet(spark, base, ["symbol", "event_id", "ts", "price"], where))


_add(
    "io_hive_scan",
    _hive,
    f"WITH {TICKS_SQL} SELECT symbol, event_id, ts, round(price, 6) + 0.0 AS price FROM ticks WHERE ts >= epoch_ms(TIMESTAMP '2024-01-03') AND ts < epoch_ms(TIMESTAMP '2024-01-10') AND symbol IN ('click', 'view')",
)


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _place(spark)
    panel(spark, sf_dir)[["close", "x"]].to_csv(f"{base}/csv")
    csv_to_parquet(spark, f"{base}/csv", f"{base}/parquet")
    return rounded(Panel.from_parquet(spark, f"{base}/parquet").to_df().select("symbol", "start_time", "end_time", "close", "x"))


_add("io_csv_roundtrip", _csv, f"WITH {PANEL_SQL} SELECT symbol, start_time, end_time, {_round_sql(['close', 'x'])} FROM panel")

# Plots


def _heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = FactorPlotter(panel(spark, sf_dir)["close"]).plot("heatmap", start_time="2024-01-03", end_time="2024-01-04")
    times = [c for c in wide.columns if c != "symbol"]
    long = wide.unpivot("symbol", times, "end_time", "factor")
    return rounded(long.where("factor IS NOT NULL").withColumn("end_time", F.col("end_time").cast("long")))


_add(
    "plot_heatmap_data",
    _heatmap,
    f"WITH {PANEL_SQL} SELECT symbol, end_time, round(close, 6) + 0.0 AS factor FROM panel WHERE end_time BETWEEN epoch_ms(TIMESTAMP '2024-01-03') AND epoch_ms(TIMESTAMP '2024-01-04')",
)
_HIST = "h AS (SELECT *, min(volume) OVER () AS lo, max(volume) OVER () AS hi FROM panel), binned AS (SELECT CAST(least(floor((volume - lo) * 50 / (hi - lo)), 49) AS BIGINT) AS bin, lo, (hi - lo) / 50 AS w FROM h)"
_add(
    "plot_hist_data",
    lambda s, d: rounded(FactorPlotter(panel(s, d)["volume"]).plot("distribution")),
    f'WITH {PANEL_SQL}, {_HIST} SELECT bin, round(lo + bin * w, 6) + 0.0 AS "left", round(lo + (bin + 1) * w, 6) + 0.0 AS "right", count(*) AS n FROM binned GROUP BY ALL',
)
_add(
    "plot_density_curve",
    lambda s, d: rounded(FactorPlotter(panel(s, d)["volume"]).plot("distribution", dist_type="kde")),
    f"""WITH {PANEL_SQL}, h AS (SELECT volume AS f, min(volume) OVER () AS lo, max(volume) OVER () AS hi, count(*) OVER () AS rows FROM panel),
      cells AS (SELECT least(floor((f - lo) * 4096 / (hi - lo)), 4095) AS cell, lo, hi, rows, count(*) AS n, avg(f) AS v FROM h GROUP BY ALL), width AS (SELECT stddev_samp(volume) * pow(count(*), -0.2) AS h FROM panel),
      points AS (SELECT n, rows, v, h, k, lo + (hi - lo) * (k * (2.0::DOUBLE / 999) - 0.5) AS x FROM cells, width, range(1000) t(k))
      SELECT round(x, {DIGITS}) + 0.0 AS x, round(sum(n / rows * {_KERNEL}), {DIGITS}) + 0.0 AS density FROM points GROUP BY k, x""",
)
_add(
    "plot_hist_by_symbol",
    lambda s, d: rounded(FactorPlotter(panel(s, d)["volume"]).plot("distribution", symbols=["click", "view"])),
    f"""WITH {PANEL_SQL}, h AS (SELECT symbol, volume, min(volume) OVER (PARTITION BY symbol) AS lo, max(volume) OVER (PARTITION BY symbol) AS hi FROM panel WHERE symbol IN ('click', 'view')),
      binned AS (SELECT symbol, CAST(least(floor((volume - lo) * 30 / (hi - lo)), 29) AS BIGINT) AS bin, lo, (hi - lo) / 30 AS w FROM h)
      SELECT symbol, bin, round(lo + bin * w, 6) + 0.0 AS "left", round(lo + (bin + 1) * w, 6) + 0.0 AS "right", count(*) AS n FROM binned GROUP BY ALL""",
)
_add(
    "plot_timeseries_data",
    lambda s, d: rounded(FactorPlotter(panel(s, d)["x"]).plot("TimeSeries", symbols=["click"], end_time="2024-01-05")),
    f"WITH {PANEL_SQL} SELECT symbol, end_time, round(x, 6) + 0.0 AS factor FROM panel WHERE symbol = 'click' AND end_time <= epoch_ms(TIMESTAMP '2024-01-05')",
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
