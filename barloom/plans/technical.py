"""Queries of the technical indicators (TI) with their SQL."""

from __future__ import annotations

from barloom.operators import indicators as ti
from barloom.plans.kit import Registry
from barloom.sources.bars import bars, benchmark, master

R = Registry()
KEY = "symbol_id, trade_date"
W = "OVER (PARTITION BY symbol_id ORDER BY trade_date)"


def frame(n: int, skip: int = 0) -> str:
    return f"OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def add(name, operator, columns, sql, names="bars"):
    R.add(name, lambda s, d: operator(bars(s, d)).select("symbol_id", "trade_date", *columns), names, sql)


add("ti1_rsi", ti.rsi, ["rsi_14"], f"""WITH a AS (SELECT *, close - lag(close) {W} AS d FROM bars), b AS (SELECT {KEY}, avg(greatest(d, 0)) {frame(14)} AS u, avg(greatest(-d, 0)) {frame(14)} AS v, count(d) {frame(14)} AS n FROM a)
SELECT {KEY}, {r("CASE WHEN n < 14 THEN NULL WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / nullif(v, 0)) END", "rsi_14")} FROM b""")
add("ti2_sma", lambda b: ti.sma(b, 20, 50, 200), ["sma_20", "sma_50", "sma_200"], f"SELECT {KEY}, " + ", ".join(r(f"avg(close) {frame(n)}", f"sma_{n}") for n in (20, 50, 200)) + " FROM bars")
add("ti3_one_step_ema", lambda b: ti.one_step_ema(b, 20, 50), ["ema1_20", "ema1_50"], f"WITH a AS (SELECT {KEY}, close, lag(close) {W} AS p FROM bars) SELECT {KEY}, " + ", ".join(r(f"coalesce(p + 2.0 / {n + 1} * (close - p), close)", f"ema1_{n}") for n in (20, 50)) + " FROM a")
add("ti4_recursive_ema", lambda b: ti.recursive_ema(b, 20, 50, 200), ["ema_20", "ema_50", "ema_200"], None)
add("ti5_macd", ti.macd, ["macd", "macd_signal", "macd_hist"], None)
TR = f"greatest(high, lag(close) {W}) - least(low, lag(close) {W}) AS tr"
add("ti6_atr", ti.atr, ["atr_14"], f"WITH a AS (SELECT {KEY}, {TR} FROM bars) SELECT {KEY}, {r(f'avg(tr) {frame(14)}', 'atr_14')} FROM a")
add("ti7_adx", ti.adx, ["plus_di", "minus_di", "adx"], f"""WITH a AS (SELECT {KEY}, {TR}, high - lag(high) {W} AS u, lag(low) {W} - low AS d FROM bars), b AS (SELECT {KEY}, tr, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS up, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS dn FROM a),
c AS (SELECT {KEY}, 100 * avg(up) {frame(14)} / nullif(avg(tr) {frame(14)}, 0) AS plus_di, 100 * avg(dn) {frame(14)} / nullif(avg(tr) {frame(14)}, 0) AS minus_di FROM b), e AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM c)
SELECT {KEY}, {r('plus_di', 'plus_di')}, {r('minus_di', 'minus_di')}, {r(f'avg(dx) {frame(14)}', 'adx')} FROM e""")
add("ti8_bollinger", ti.bollinger, ["bb_mid", "bb_up", "bb_low"], f"WITH a AS (SELECT {KEY}, avg(close) {frame(20)} AS m, stddev_samp(close) {frame(20)} AS s FROM bars) SELECT {KEY}, {r('m', 'bb_mid')}, {r('m + 2 * s', 'bb_up')}, {r('m - 2 * s', 'bb_low')} FROM a")
add("ti9_roc", lambda b: ti.roc(b, 5, 10, 20), ["roc_5", "roc_10", "roc_20"], f"SELECT {KEY}, " + ", ".join(r(f"100 * (close / nullif(lag(close, {n}) {W}, 0) - 1)", f"roc_{n}") for n in (5, 10, 20)) + " FROM bars")
add("ti10_batch_supertrend", ti.batch_supertrend, ["st_upper", "st_lower", "st_direction"], f"""WITH a AS (SELECT {KEY}, close, (high + low) / 2 + 3 * avg(high - low) {frame(10)} AS u, (high + low) / 2 - 3 * avg(high - low) {frame(10)} AS l FROM bars), b AS (SELECT *, lag(u) {W} AS pu, lag(l) {W} AS pl FROM a)
SELECT {KEY}, {r('u', 'st_upper')}, {r('l', 'st_lower')}, CAST(CASE WHEN close > pu THEN 1 WHEN close < pl THEN -1 ELSE 0 END AS INTEGER) AS st_direction FROM b""")
add("ti11_stateful_supertrend", ti.stateful_supertrend, ["supertrend", "trend"], None)
add("ti12_swing_low", ti.swing_low, ["swing_low_20"], f"SELECT {KEY}, {r(f'min(low) {frame(20)}', 'swing_low_20')} FROM bars")
RET = ", ".join(r(f"close / nullif(lag(close, {n}) {W}, 0) - 1", f"ret_{n}") for n in (5, 20, 60, 120, 252))
add("ti13_trailing_returns", ti.trailing_returns, [f"ret_{n}" for n in (5, 20, 60, 120, 252)], f"SELECT {KEY}, {RET} FROM bars")
VZ = ", ".join(r(f"CASE WHEN count(*) {frame(n, 1)} >= {n} THEN (volume - avg(volume) {frame(n, 1)}) / nullif(stddev_pop(volume) {frame(n, 1)}, 0) END", f"vol_z{n}") for n in (20, 50))
add("ti14_volume_zscore", ti.volume_zscore, ["vol_z20", "vol_z50"], f"SELECT {KEY}, {VZ} FROM bars")
add("ti15_custom", ti.custom, ["ret_1", "log_ret", "volatility", "volume_ratio", "volume_spike", "range_pct", "high_n", "low_n"], f"""WITH a AS (SELECT *, close / nullif(lag(close) {W}, 0) - 1 AS x FROM bars)
SELECT {KEY}, {r('x', 'ret_1')}, {r('ln(x + 1)', 'log_ret')}, {r(f'stddev_samp(x) {frame(20)}', 'volatility')}, {r(f'volume / nullif(avg(volume) {frame(20)}, 0)', 'volume_ratio')}, coalesce(volume / nullif(avg(volume) {frame(20)}, 0) > 2, false) AS volume_spike,
{r('100 * (high - low) / nullif(close, 0)', 'range_pct')}, {r(f'max(high) {frame(20)}', 'high_n')}, {r(f'min(low) {frame(20)}', 'low_n')} FROM a""")
add("ti16_volume_lines", ti.volume_lines, ["obv", "vwap"], f"""WITH a AS (SELECT *, coalesce(sign(close - lag(close) {W}), 0) * volume AS s, (high + low + close) / 3 * volume AS t FROM bars)
SELECT {KEY}, {r(f'sum(s) {W}', 'obv')}, {r(f'sum(t) {W} / nullif(sum(volume) {W}, 0)', 'vwap')} FROM a""")
add("ti17_trend_strength", ti.trend_strength, ["ema_spread_pct", "sma200_distance_pct"], None)
add("ti18_momentum", ti.momentum, ["mom_10", "mom_20", "roc_12", "roc_26"], f"SELECT {KEY}, {r(f'close - lag(close, 10) {W}', 'mom_10')}, {r(f'close - lag(close, 20) {W}', 'mom_20')}, {r(f'100 * (close / nullif(lag(close, 12) {W}, 0) - 1)', 'roc_12')}, {r(f'100 * (close / nullif(lag(close, 26) {W}, 0) - 1)', 'roc_26')} FROM bars")
MA = ", ".join(f"CASE WHEN count(*) {frame(n)} >= {n} THEN avg(close) {frame(n)} END AS s{n}" for n in (50, 150, 200))
CONDS = {"above_150": ("close > s150", 15), "above_200": ("close > s200", 15), "stacked": ("s150 > s200", 15), "rising_200": ("slope > 0", 15), "above_50": ("close > s50", 10), "off_low": ("close >= 1.25 * lo", 10), "near_high": ("close >= 0.75 * hi", 10), "golden": ("above", 10)}
SCORE = " + ".join(f"CASE WHEN coalesce({c}, false) THEN {p}.0 ELSE 0.0 END" for c, p in CONDS.values())
FAILS = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{k}' END" for k, (c, _) in CONDS.items()) + ")"
add("ti19_stage2", ti.stage2, ["stage2_score", "stage2_fails", "bars_since_cross", "stage2_label"], f"""WITH a AS (SELECT *, {MA}, max(high) {frame(252)} AS hi, min(low) {frame(252)} AS lo FROM bars), b AS (SELECT *, s200 - lag(s200, 20) {W} AS slope, s50 > s200 AS above FROM a), c AS (SELECT *, lag(above) {W} AS was FROM b),
e AS (SELECT *, CAST({SCORE} AS DOUBLE) AS score, {FAILS} AS stage2_fails, sum(CASE WHEN coalesce(above AND NOT was, false) THEN 1 ELSE 0 END) {W} AS x FROM c)
SELECT {KEY}, score AS stage2_score, stage2_fails, CASE WHEN x > 0 THEN CAST(row_number() OVER (PARTITION BY symbol_id, x ORDER BY trade_date) - 1 AS INTEGER) END AS bars_since_cross, CASE WHEN score >= 85 THEN 'strong' WHEN score >= 70 THEN 'stage2' WHEN score >= 50 THEN 'early' ELSE 'none' END AS stage2_label FROM e""")
add("ti20_preconditions", ti.preconditions, ["consolidation_range", "pullback_depth", "base_tightness", "volatility_contraction", "resistance_slope"], f"""WITH a AS (SELECT *, max(high) {frame(20)} AS hi, min(low) {frame(20)} AS lo, (high - low) / nullif(close, 0) AS x FROM bars), b AS (SELECT *, lag(hi, 5) {W} AS h5 FROM a)
SELECT {KEY}, {r('(hi - lo) / nullif(lo, 0)', 'consolidation_range')}, {r('1 - close / nullif(hi, 0)', 'pullback_depth')}, {r(f'stddev_samp(close) {frame(10)} / nullif(avg(close) {frame(10)}, 0)', 'base_tightness')}, {r(f'avg(x) {frame(5)} / nullif(avg(x) {frame(20)}, 0)', 'volatility_contraction')}, {r('(hi - h5) / nullif(h5, 0)', 'resistance_slope')} FROM b""")
PCT = "(rank() OVER ({part}ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {keys}{x}) - 1) / 2.0) / count({x}) OVER ({part})"


def pct(x: str, keys: str = "") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN " + PCT.format(x=x, part=f"PARTITION BY {keys} " if keys else "", keys=f"{keys}, " if keys else "") + " END"


R.add("ti21_risk_profile", lambda s, d: ti.risk_profile(bars(s, d), benchmark(bars(s, d))), "bars bench", f"""WITH a AS (SELECT b.*, bench_close, close / nullif(lag(close) {W}, 0) - 1 AS x, bench_close / nullif(lag(bench_close) {W}, 0) - 1 AS y, row_number() OVER (PARTITION BY symbol_id ORDER BY trade_date DESC) AS n FROM bars b LEFT JOIN bench USING (trade_date)),
t AS (SELECT *, max(CASE WHEN n <= 63 THEN close END) {W} AS t63, max(close) {W} AS t126 FROM a WHERE n <= 126),
g AS (SELECT symbol_id, stddev_samp(CASE WHEN n <= 20 THEN x END) AS vol_20, stddev_samp(CASE WHEN n <= 60 THEN x END) AS vol_60, covar_samp(CASE WHEN n <= 60 THEN x END, CASE WHEN n <= 60 THEN y END) / nullif(var_samp(CASE WHEN n <= 60 AND x IS NOT NULL THEN y END), 0) AS beta_60,
min(CASE WHEN n <= 63 THEN close / nullif(t63, 0) - 1 END) AS max_drawdown_63, min(close / nullif(t126, 0) - 1) AS max_drawdown_126, avg(CASE WHEN n <= 20 THEN close * volume END) AS avg_value_20 FROM t GROUP BY symbol_id)
SELECT symbol_id, {', '.join(r(c, c) for c in ('vol_20', 'vol_60', 'beta_60', 'max_drawdown_63', 'max_drawdown_126', 'avg_value_20'))}, {r(pct('avg_value_20'), 'liquidity_pct')} FROM g""")
R.add("ti22_delivery_trend", lambda s, d: ti.delivery_trend(bars(s, d)), "bars", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY trade_date DESC) AS n FROM bars WHERE delivery_pct IS NOT NULL), g AS (SELECT symbol_id, max(CASE WHEN n = 1 THEN delivery_pct END) AS latest, avg(CASE WHEN n <= 5 THEN delivery_pct END) AS mean_5, avg(delivery_pct) AS mean_20, max(CASE WHEN n = 6 THEN delivery_pct END) AS o FROM a WHERE n <= 20 GROUP BY symbol_id)
SELECT symbol_id, {r('latest', 'latest')}, {r('mean_5', 'mean_5')}, {r('mean_20', 'mean_20')}, {r('latest - o', 'change_5')}, {r('latest - mean_20', 'vs_mean_20')}, {r('greatest(0.0, least(100.0, 50 + (mean_5 - mean_20) * 2))', 'trend_score')} FROM g""")
add("ti23_delivery_features", ti.delivery_features, ["delivery_5", "delivery_20", "delivery_pctile"], f"SELECT {KEY}, {r(f'avg(delivery_pct) {frame(5)}', 'delivery_5')}, {r(f'avg(delivery_pct) {frame(20)}', 'delivery_20')}, {r(pct('delivery_pct', 'trade_date'), 'delivery_pctile')} FROM bars")
add("ti24_liquidity", ti.liquidity, ["traded_value", "liquidity_pct"], f"WITH a AS (SELECT {KEY}, close * volume AS v FROM bars) SELECT {KEY}, {r('v', 'traded_value')}, {r(pct('v', 'trade_date'), 'liquidity_pct')} FROM a")
R.add("ti25_cross_section", lambda s, d: ti.cross_section(bars(s, d), master(s, d), "close").select("symbol_id", "trade_date", "rank_all", "pctile", "rank_sector"), "bars master", f"""SELECT symbol_id, trade_date, CAST(dense_rank() OVER (PARTITION BY trade_date ORDER BY close DESC NULLS LAST) AS INTEGER) AS rank_all, {r(pct('close', 'trade_date'), 'pctile')}, CAST(dense_rank() OVER (PARTITION BY trade_date, sector ORDER BY close DESC NULLS LAST) AS INTEGER) AS rank_sector FROM bars LEFT JOIN master USING (symbol_id)""")
add("ti26_all_technicals", ti.all_technicals, ["sma_20", "atr_14", "bb_up", "ret_20", "vol_z20"], f"WITH a AS (SELECT *, {TR} FROM bars) SELECT {KEY}, {r(f'avg(close) {frame(20)}', 'sma_20')}, {r(f'avg(tr) {frame(14)}', 'atr_14')}, {r(f'avg(close) {frame(20)} + 2 * stddev_samp(close) {frame(20)}', 'bb_up')}, {r(f'close / nullif(lag(close, 20) {W}, 0) - 1', 'ret_20')}, {VZ.split(', round')[0]} FROM a")
add("ti28_one_step_macd", ti.one_step_macd, ["macd1", "macd1_signal", "macd1_hist"], f"""WITH a AS (SELECT {KEY}, close, lag(close) {W} AS p, row_number() {W} AS n FROM bars), b AS (SELECT {KEY}, CASE WHEN n >= 26 THEN coalesce(p + 2.0 / 13 * (close - p), close) - coalesce(p + 2.0 / 27 * (close - p), close) END AS m FROM a), c AS (SELECT *, lag(m) {W} AS q FROM b), e AS (SELECT *, coalesce(q + 2.0 / 10 * (m - q), m) AS g FROM c)
SELECT {KEY}, {r('m', 'macd1')}, {r('g', 'macd1_signal')}, {r('m - g', 'macd1_hist')} FROM e""")
