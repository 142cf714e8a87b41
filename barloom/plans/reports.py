"""Queries of the reports (OUT, ML), one-date ranks (RK28), movers (BO6, BO7), regimes (BR) and lists (EV10, TJ12) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.stats import along, pct_rank, ratio, trailing
from barloom.operators import market as mk
from barloom.operators import outcomes as out
from barloom.operators import ranking as rk
from barloom.operators import reports as rp
from barloom.plans import companies, markets  # noqa: F401  their SQL definitions are used here
from barloom.plans.kit import NEEDS, SQL, Registry
from barloom.plans.technical import W, frame, pct, r
from barloom.sources.bars import bars, benchmark, master

R = Registry()
KEY = ["symbol_id", "trade_date"]
FACTORS = ["rs", "prox", "vol"]
SQL["fac"] = f"""SELECT symbol_id, trade_date, open, high, low, close, volume, delivery_pct, 100 * (close / nullif(lag(close, 20) {W}, 0) - 1) AS rs, 100 * close / nullif(max(high) {frame(252)}, 0) AS prox, volume / nullif(avg(volume) {frame(20, 1)}, 0) AS vol,
{', '.join(f'100 * (lead(close, {h}) {W} / nullif(close, 0) - 1) AS fwd_{h}' for h in (5, 10, 20, 60))} FROM bars"""
SQL["facr"] = "SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY rs DESC, symbol_id) AS k FROM fac WHERE rs IS NOT NULL"
NEEDS |= {"fac": ["bars"], "facr": ["fac"]}


def fac(s, d):
    c = F.col("close")
    rows = bars(s, d).withColumns({"rs": 100 * (ratio(c, F.lag("close", 20).over(along())) - 1), "prox": ratio(100 * c, F.max("high").over(trailing(252))), "vol": ratio(F.col("volume"), F.avg("volume").over(trailing(20, skip=1)))})
    return rows.withColumns({f"fwd_{h}": 100 * (ratio(F.lead("close", h).over(along()), c) - 1) for h in (5, 10, 20, 60)})


def facr(s, d):
    return fac(s, d).filter("rs is not null").withColumn("k", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("rs"), "symbol_id")))


def since(rows: str, days: int) -> str:
    return f"(SELECT * FROM {rows} WHERE trade_date >= (SELECT max(trade_date) FROM {rows}) - {days})"


CORR = "CASE WHEN count(*) >= {n} AND NOT isnan(corr(a, b)) THEN corr(a, b) END"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT trade_date, '{f}' AS factor, {f} AS value, fwd_20 FROM fac" for f in FACTORS) + ")"


def ic(name: str, rows: str, value: str, outcome: str, keys: str, least: int = 3) -> str:
    """Definitions of the pooled rank correlation of each key as SQL."""
    by = f"{keys}, " if keys else ""
    ranked = f"SELECT {by}{pct(value, keys)} AS a, {pct(outcome, keys)} AS b FROM {rows} WHERE {value} IS NOT NULL AND {outcome} IS NOT NULL" if keys else f"SELECT {pct(value)} AS a, {pct(outcome)} AS b FROM {rows} WHERE {value} IS NOT NULL AND {outcome} IS NOT NULL"
    return f"{name} AS (SELECT {by}count(*) AS n, {CORR.format(n=least)} AS ic FROM ({ranked}) {'GROUP BY ' + keys if keys else ''})"


R.add("out7_overlap", lambda s, d: rp.factor_overlap(fac(s, d), "rs", "prox"), "fac", f"WITH {ic('x', since('fac', 180), 'rs', 'prox', '', 30)} SELECT n, {r('ic', 'ic')}, CASE WHEN ic IS NULL THEN 'insufficient_sample' WHEN abs(ic) >= 0.8 THEN 'high_overlap' WHEN abs(ic) >= 0.6 THEN 'moderate_overlap' ELSE 'low_overlap' END AS status FROM x")
R.add("out9_drift", lambda s, d: rp.drift(fac(s, d), FACTORS, "fwd_20", 365, 1825), "fac", f"""WITH {LONG}, {ic('p', since('long', 365), 'value', 'fwd_20', 'factor')}, {ic('q', since('long', 1825), 'value', 'fwd_20', 'factor')},
x AS (SELECT coalesce(p.factor, q.factor) AS factor, coalesce(p.n, 0) AS recent_n, p.ic AS ic_recent, coalesce(q.n, 0) AS baseline_n, q.ic AS ic_baseline FROM p FULL OUTER JOIN q ON p.factor = q.factor), y AS (SELECT *, CASE WHEN abs(ic_baseline) >= 1e-6 THEN ic_recent - ic_baseline END AS delta_ic FROM x), z AS (SELECT *, delta_ic / abs(ic_baseline) * 100 AS delta_pct FROM y),
t AS (SELECT *, CASE WHEN recent_n < 1500 THEN 'insufficient_sample' WHEN delta_ic IS NULL THEN 'no_baseline' WHEN recent_n < 3000 THEN CASE WHEN delta_pct < -30 THEN 'watch' ELSE 'ok' END WHEN delta_ic <= -0.03 AND ic_baseline >= 0.05 THEN 'critical' WHEN delta_pct < -30 THEN 'warning' ELSE 'ok' END AS status FROM z)
SELECT factor, recent_n, {r('ic_recent', 'ic_recent')}, baseline_n, {r('ic_baseline', 'ic_baseline')}, {r('delta_ic', 'delta_ic')}, {r('delta_pct', 'delta_pct')}, status, CASE WHEN status IN ('warning', 'critical') THEN upper(status) ELSE '' END AS alert FROM t""")
ACT = " UNION ALL ".join(f"SELECT trade_date, '{f}' AS factor, {h} AS horizon, {f} AS value, fwd_{h} AS fwd FROM fac" for f in FACTORS for h in (5, 10, 20))
R.add("out10_activation", lambda s, d: rp.activation(fac(s, d), FACTORS, days=365), "fac", f"""WITH a0 AS ({ACT}), {ic('x', since('a0', 365), 'value', 'fwd', 'factor, horizon')}, y AS (SELECT factor, {', '.join(f'coalesce(max(CASE WHEN horizon = {h} THEN n END), 0) AS n_{h}, max(CASE WHEN horizon = {h} THEN ic END) AS i{h}' for h in (5, 10, 20))} FROM x GROUP BY 1),
z AS (SELECT *, CAST({' + '.join(f'CASE WHEN i{h} > 0 THEN 1 ELSE 0 END' for h in (5, 10, 20))} AS INTEGER) AS g FROM y) SELECT factor, n_5, n_10, n_20, {', '.join(r(f'i{h}', f'ic_{h}') for h in (5, 10, 20))}, g AS positive_horizons, CASE WHEN least(n_5, n_10, n_20) >= 30 AND g >= 2 AND coalesce(i20 >= 0.02, false) THEN 'eligible_for_backtest' ELSE 'hold_zero_weight' END AS decision FROM z""")
COH = " UNION ALL ".join(f"SELECT '{n}' AS cohort, * FROM {since('facr', 365)} WHERE k BETWEEN {a} AND {b}" for n, a, b in rp.BANDS)
R.add("out11_concentration", lambda s, d: rp.concentration(facr(s, d), 365), "facr", f"""WITH x AS ({COH}), y AS (SELECT cohort, count(*) AS n, avg(fwd_5) AS a, avg(fwd_10) AS b, avg(fwd_20) AS c, 100 * avg(CASE WHEN fwd_20 > 0 THEN 1.0 WHEN fwd_20 IS NOT NULL THEN 0 END) AS h FROM x GROUP BY 1), z AS (SELECT *, (SELECT c FROM y WHERE cohort = 'top-200') AS t, (SELECT c FROM y WHERE cohort = '201+') AS p, (SELECT c FROM y WHERE cohort = 'top-10') - (SELECT c FROM y WHERE cohort = 'top-200') AS e FROM y)
SELECT cohort, n, {r('a', 'avg_5')}, {r('b', 'avg_10')}, {r('c', 'avg_20')}, {r('h', 'hit_rate_20')}, {r('c - t', 'delta_top_200')}, {r('c - p', 'delta_201_plus')}, CASE WHEN e IS NULL THEN 'unknown' WHEN e < 0.5 THEN 'weak' WHEN e >= 1.5 THEN 'strong' ELSE 'mixed' END AS signal FROM z""")
R.add("out15_cells", lambda s, d: rp.cell_statistics(fac(s, d).join(markets.br(s, d).select("trade_date", "label"), "trade_date"), "rs", "fwd_5", "label"), "fac brs", f"""WITH x AS (SELECT label, trade_date, symbol_id, rs, fwd_5 FROM fac JOIN (SELECT trade_date, label FROM brs) USING (trade_date)), {ic('i', 'x', 'rs', 'fwd_5', 'label')},
k AS (SELECT *, row_number() OVER (PARTITION BY trade_date, label ORDER BY rs DESC, symbol_id) AS k, count(*) OVER (PARTITION BY trade_date, label) AS c FROM x WHERE rs IS NOT NULL AND fwd_5 IS NOT NULL), g AS (SELECT label, trade_date, avg(CASE WHEN k - 1 <= (c - 1) / 10.0 THEN fwd_5 END) AS t, avg(CASE WHEN k - 1 > (c - 1) / 10.0 * 9 THEN fwd_5 END) AS b FROM k WHERE c >= 10 GROUP BY 1, 2),
e AS (SELECT *, t - b AS s, sum(t - b) OVER w AS u FROM g WINDOW w AS (PARTITION BY label ORDER BY trade_date)), f AS (SELECT *, greatest(0, max(u) OVER (PARTITION BY label ORDER BY trade_date)) - u AS dd FROM e), h AS (SELECT label, count(*) AS n, avg(t) AS t, avg(b) AS b, avg(s) AS s, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END) AS hit, 1.96 * stddev_samp(s) / sqrt(count(*)) AS er, greatest(0, max(dd)) AS dd FROM f GROUP BY 1)
SELECT h.label, h.n, {r('t', 'top')}, {r('b', 'bottom')}, {r('s', 'spread')}, {r('hit', 'hit_rate')}, {r('s - er', 'low')}, {r('s + er', 'high')}, {r('dd', 'max_drawdown')}, {r('ic', 'ic')} FROM h LEFT JOIN i ON h.label = i.label""")
R.add("out17_winner_capture", lambda s, d: rp.winner_capture(facr(s, d), bars(s, d)), "facr", f"""WITH y AS (SELECT year(trade_date) AS year, symbol_id, arg_min(close, trade_date) AS a, arg_max(close, trade_date) AS z FROM bars GROUP BY 1, 2 HAVING count(*) >= 2 AND arg_min(close, trade_date) > 0), g AS (SELECT *, 100 * (z / a - 1) AS g FROM y), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY year ORDER BY g DESC, symbol_id) <= 50),
h AS (SELECT b.year, b.symbol_id, min(CASE WHEN k <= 50 THEN f.trade_date END) AS captured_on, arg_min(f.close, CASE WHEN k <= 50 THEN f.trade_date END) AS c, min(k) AS best_rank FROM b JOIN facr f ON f.symbol_id = b.symbol_id AND year(f.trade_date) = b.year GROUP BY 1, 2)
SELECT CAST(b.year AS INTEGER) AS year, b.symbol_id, {r('g', 'year_return')}, captured_on, CAST(best_rank AS INTEGER) AS best_rank, {r('100 * (c / a - 1)', 'return_at_capture')}, {r('100 * (z / nullif(c, 0) - 1)', 'return_remaining')} FROM b LEFT JOIN h ON h.year = b.year AND h.symbol_id = b.symbol_id""")
winners = lambda s, d: fac(s, d).groupBy("symbol_id").agg(*[F.max_by(f, F.when(F.col("trade_date") < "1999-01-01", F.col("trade_date"))).alias(f) for f in FACTORS], (100 * (F.max("close") / F.min("close") - 1)).alias("rally"))
R.add("out19_winner_factors", lambda s, d: rp.factor_of_winners(winners(s, d), FACTORS), "fac", f"""WITH x AS (SELECT symbol_id, {', '.join(f"arg_max(CASE WHEN {f} IS NULL THEN 'NaN'::DOUBLE ELSE {f} END, CASE WHEN trade_date < DATE '1999-01-01' THEN trade_date END) AS {f}" for f in FACTORS)}, 100 * (max(close) / min(close) - 1) AS rally FROM fac GROUP BY 1), l AS ({' UNION ALL '.join(f"SELECT '{f}' AS factor, CASE WHEN NOT isnan({f}) THEN {f} END AS value, rally FROM x" for f in FACTORS)}),
p AS (SELECT *, 100 * CASE WHEN value IS NOT NULL THEN {pct('value', 'factor')} END AS p FROM l), {ic('i', 'l', 'value', 'rally', 'factor')}, g AS (SELECT factor, quantile_cont(value, 0.5) AS m, quantile_cont(p, 0.5) AS mp, 100 * avg(CASE WHEN p >= 75 THEN 1.0 ELSE 0 END) AS q FROM p GROUP BY 1) SELECT g.factor, {r('m', 'median')}, {r('mp', 'median_pct')}, {r('q', 'top_quarter')}, {r('ic', 'ic')} FROM g LEFT JOIN i ON i.factor = g.factor""")
R.add("out21_precision_at", lambda s, d: rp.precision_at(fac(s, d), "rs", "fwd_60", 500), "fac", f"WITH x AS (SELECT * FROM fac WHERE rs IS NOT NULL ORDER BY rs DESC, symbol_id, trade_date LIMIT 500) SELECT count(*) AS n, {r('avg(CASE WHEN fwd_60 >= 20 THEN 1.0 ELSE 0 END)', 'precision')} FROM x")
BUCKET = "CASE WHEN p >= 55 AND p < 65 THEN '55-64' WHEN p >= 65 AND p < 75 THEN '65-74' WHEN p >= 75 AND p < 85 THEN '75-84' WHEN p >= 85 THEN '85+' ELSE 'UNKNOWN' END"
SQL["coh"] = f"SELECT f.*, sector, {BUCKET} AS bucket FROM (SELECT *, 100 * CASE WHEN rs IS NOT NULL THEN {pct('rs', 'trade_date')} END AS p FROM fac WHERE rs IS NOT NULL) f LEFT JOIN (SELECT symbol_id, sector FROM master WHERE symbol_id % 5 <> 0) USING (symbol_id)"
NEEDS["coh"] = ["fac", "master"]


def coh(s, d):
    rows = fac(s, d).filter("rs is not null").withColumn("p", 100 * pct_rank("rs", "trade_date"))
    p = F.col("p")
    bucket = F.when((p >= 55) & (p < 65), "55-64").when((p >= 65) & (p < 75), "65-74").when((p >= 75) & (p < 85), "75-84").when(p >= 85, "85+").otherwise("UNKNOWN")
    return rows.withColumn("bucket", bucket).join(master(s, d).filter("symbol_id % 5 <> 0").select("symbol_id", "sector"), "symbol_id", "left")


G3 = " UNION ALL ".join(f"SELECT '{g}' AS group_type, {e} AS group_value, {h} AS horizon, fwd_{h} AS v FROM coh WHERE fwd_{h} IS NOT NULL" for g, e in (("sector", "coalesce(sector, 'UNKNOWN')"), ("score_bucket", "bucket"), ("sector_x_bucket", "coalesce(sector, 'UNKNOWN') || ' | ' || bucket")) for h in (5, 10, 20))
R.add("out22_cohort_performance", lambda s, d: rp.cohort_performance(coh(s, d), {"sector": ["sector"], "score_bucket": ["bucket"], "sector_x_bucket": ["sector", "bucket"]}, [5, 10, 20]), "coh", f"""WITH x AS ({G3}), base AS ({' UNION ALL '.join(f'SELECT {h} AS horizon, avg(fwd_{h}) AS base FROM coh' for h in (5, 10, 20))}), y AS (SELECT group_type, group_value, horizon, count(*) AS n, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS w, avg(v) AS m, quantile_cont(v, 0.5) AS md, avg(CASE WHEN v > 2 THEN 1.0 ELSE 0 END) AS a2, avg(CASE WHEN v > 5 THEN 1.0 ELSE 0 END) AS a5, avg(CASE WHEN v > 0 THEN v END) AS wi, avg(CASE WHEN v < 0 THEN v END) AS lo FROM x GROUP BY 1, 2, 3)
SELECT group_type, group_value, horizon, n, {r('100 * w', 'win_rate')}, {r('m', 'mean')}, {r('md', 'median')}, {r('100 * a2', 'above_2')}, {r('100 * a5', 'above_5')}, {r('wi', 'winner')}, {r('lo', 'loser')}, CASE WHEN n >= 50 THEN 'HIGH' WHEN n >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS sample, {r('wi / abs(nullif(lo, 0))', 'payoff')}, {r('w * wi + (1 - w) * lo', 'expectancy')}, {r('m - base', 'edge')}, row_number() OVER (PARTITION BY group_type, group_value ORDER BY m DESC, n DESC) = 1 AS best_horizon FROM y JOIN base USING (horizon)""")
stored = lambda s, d: fac(s, d).filter(F.dayofmonth("trade_date") == 15).select(*KEY, *[F.when(F.col("trade_date") < "1997-01-01", F.col(f"fwd_{h}")).alias(f"fwd_{h}") for h in (5, 10, 20)])
R.add("out23_mature", lambda s, d: rp.mature(stored(s, d), bars(s, d), [5, 10, 20]), "fac", f"SELECT symbol_id, trade_date, {', '.join(r(f'fwd_{h}', f'fwd_{h}') for h in (5, 10, 20))}, CASE WHEN fwd_20 IS NOT NULL AND fwd_10 IS NOT NULL AND fwd_5 IS NOT NULL THEN 'matured' WHEN coalesce(fwd_5, fwd_10, fwd_20) IS NOT NULL THEN 'partial' ELSE 'pending' END AS status FROM fac WHERE day(trade_date) = 15")
R.add("out26_windows", lambda s, d: rp.calendar_windows(facr(s, d).withColumns({"band": out.band(F.col("k")), "rel": F.col("fwd_20") - F.avg("fwd_20").over(Window.partitionBy("trade_date"))}), "band", "fwd_20", "rel"), "facr", f"""WITH x AS (SELECT *, {companies.BAND} AS band, fwd_20 - avg(fwd_20) OVER (PARTITION BY trade_date) AS rel FROM facr), y AS (SELECT *, (dense_rank() OVER (ORDER BY trade_date) - 1) // 10 AS window_index FROM x WHERE fwd_20 IS NOT NULL), z AS (SELECT band, CAST(window_index AS BIGINT) AS window_index, min(trade_date) AS window_start, max(trade_date) AS window_end, count(*) AS n, avg(fwd_20) AS m, round(avg(rel), 9) AS q FROM y GROUP BY 1, 2)
SELECT band, window_index, window_start, window_end, n, {r('m', 'mean')}, {r('q', 'relative')}, CASE WHEN n >= 120 THEN 'POLICY_ELIGIBLE' WHEN n >= 60 THEN 'MODERATE' WHEN n >= 30 THEN 'PROVISIONAL' ELSE 'EXPLORATORY' END AS sample FROM z""")
R.queries["out26_windows"] = (lambda q: lambda s, d: q(s, d).drop("stable"))(R.queries["out26_windows"])  # means of zero fall either side
R.add("out28_predictions", lambda s, d: rp.matured_predictions(facr(s, d).filter("k <= 10").select(*KEY, "k"), bars(s, d), 5), "facr", f"WITH x AS (SELECT symbol_id, trade_date, lead(trade_date, 5) {W} AS future_date, lead(close, 5) {W} / nullif(close, 0) - 1 AS v FROM bars) SELECT symbol_id, trade_date, CAST(k AS INTEGER) AS k, future_date, {r('v', 'realised')}, v > 0 AS hit FROM facr JOIN x USING (symbol_id, trade_date) WHERE k <= 10 AND v IS NOT NULL")


def plus(day: str, months: str) -> str:
    return f"CAST(date_trunc('month', {day}) + to_months(CAST({months} AS INTEGER)) AS DATE) + least(CAST(day({day}) AS INTEGER), 28) - 1"


R.add("out29_folds", lambda s, d: rp.folds(bars(s, d)), "bars", f"""WITH m AS (SELECT min(trade_date) AS s, max(trade_date) AS e FROM bars), a AS (SELECT s, e, i AS fold, CASE WHEN i = 0 THEN s ELSE {plus('s', 'i * 3')} END AS train_start FROM m, range(0, 200) AS t(i)), b AS (SELECT *, {plus('train_start', '12')} AS validation_start FROM a), c AS (SELECT *, validation_start - 1 AS train_end, {plus('validation_start', '3')} - 1 AS validation_end FROM b)
SELECT CAST(fold AS INTEGER) AS fold, train_start, train_end, validation_start, validation_end, count(*) FILTER (WHERE trade_date < validation_start) AS train_rows, count(*) FILTER (WHERE trade_date >= validation_start) AS validation_rows FROM c JOIN bars ON trade_date BETWEEN train_start AND validation_end WHERE validation_end <= e GROUP BY ALL""")
R.add("out30_buy_and_hold", lambda s, d: rp.buy_and_hold(benchmark(bars(s, d)), F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1998-06-30"))), "bench", f"SELECT min(trade_date) AS first_day, max(trade_date) AS last_day, {r('arg_max(bench_close, trade_date) / nullif(arg_min(bench_close, trade_date), 0) - 1', 'ret')} FROM bench WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'")
R.add("out31_drawdown", lambda s, d: rp.drawdown_of_sum(rp.tenth_spread(fac(s, d), "rs", "fwd_5"), "spread"), "fac", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY rs DESC, symbol_id) AS k, count(*) OVER (PARTITION BY trade_date) AS c FROM fac WHERE rs IS NOT NULL AND fwd_5 IS NOT NULL), g AS (SELECT trade_date, avg(CASE WHEN k - 1 <= (c - 1) / 10.0 THEN fwd_5 END) - avg(CASE WHEN k - 1 > (c - 1) / 10.0 * 9 THEN fwd_5 END) AS s FROM k WHERE c >= 10 GROUP BY 1),
e AS (SELECT *, sum(s) OVER (ORDER BY trade_date) AS u FROM g), f AS (SELECT greatest(0, max(u) OVER (ORDER BY trade_date)) - u AS dd FROM e) SELECT count(*) AS n, {r('greatest(0, max(dd))', 'max_drawdown')} FROM f""")
REASONS = ", ".join(f"CASE WHEN abs(fwd_{h}) >= {rp.EXTREME[h]} THEN 'extreme_fwd_{h}d_return' END, CASE WHEN abs(fwd_{h}) >= 80 THEN 'manual_review_extreme_return' END" for h in (5, 10, 20, 60))
R.add("out34_quality", lambda s, d: rp.return_quality(fac(s, d)).select(*KEY, "fwd_5_anomaly", "quality", "reason"), "fac", f"SELECT symbol_id, trade_date, coalesce(abs(fwd_5) >= 50, false) AS fwd_5_anomaly, CASE WHEN {' OR '.join(f'coalesce(abs(fwd_{h}) >= {rp.EXTREME[h]}, false)' for h in (5, 10, 20, 60))} THEN 'quarantined' ELSE 'trusted' END AS quality, concat_ws('|', {REASONS}) AS reason FROM fac")
R.add("out36_sector_periods", lambda s, d: out.summary(out.long_horizons(coh(s, d).withColumn("period", F.year("trade_date")), [5, 20], "sector", "period"), "ret", "sector", "horizon", "period"), "coh", f"WITH x AS (SELECT sector, year(trade_date) AS period, 5 AS horizon, fwd_5 AS ret FROM coh UNION ALL SELECT sector, year(trade_date), 20, fwd_20 FROM coh) SELECT sector, horizon, CAST(period AS INTEGER) AS period, {companies.SUMM('ret')} FROM x WHERE ret IS NOT NULL GROUP BY 1, 2, 3")

# --- model frames -------------------------------------------------------------------------------------------
M = lambda e, n, least, skip=0: f"CASE WHEN count(*) {frame(n, skip)} >= {least} THEN {e} {frame(n, skip)} END"
STRUCTURE = ["ret_5_back", "ret_20_back", "ret_60_back", "volume_ratio_20", "volatility_20", "volatility_60", "dist_sma_20", "dist_sma_50", "dist_sma_200", "dist_52w_high", "range_width_20", "breakout_20"]
SQL["ml0"] = f"""SELECT *, close / nullif(lag(close) {W}, 0) - 1 AS x, {M('avg(close)', 20, 5)} AS m20, {M('avg(close)', 50, 10)} AS m50, {M('avg(close)', 200, 30)} AS m200, {M('max(high)', 20, 5, 1)} AS h, {M('min(low)', 20, 5, 1)} AS l, {M('avg(volume)', 20, 5, 1)} AS v, {M('max(high)', 252, 20)} AS y FROM bars"""
SQL["ml"] = f"""SELECT symbol_id, trade_date, close, {', '.join(f'close / nullif(lag(close, {n}) {W}, 0) - 1 AS ret_{n}_back' for n in (5, 20, 60))}, volume / nullif(v, 0) AS volume_ratio_20, CASE WHEN count(x) {frame(20)} >= 10 THEN stddev_samp(x) {frame(20)} END AS volatility_20, CASE WHEN count(x) {frame(60)} >= 20 THEN stddev_samp(x) {frame(60)} END AS volatility_60,
(close - m20) / nullif(m20, 0) AS dist_sma_20, (close - m50) / nullif(m50, 0) AS dist_sma_50, (close - m200) / nullif(m200, 0) AS dist_sma_200, 1 - close / nullif(y, 0) AS dist_52w_high, (h - l) / nullif(l, 0) AS range_width_20, (close - h) / nullif(h, 0) AS breakout_20, CASE WHEN close > h THEN 1 ELSE 0 END AS is_breakout_20 FROM ml0"""
NEEDS |= {"ml0": ["bars"], "ml": ["ml0"]}
R.add("ml2_structure", lambda s, d: rp.structure(bars(s, d)).select(*KEY, *STRUCTURE, "is_breakout_20", "trend_alignment"), "ml", f"SELECT symbol_id, trade_date, {', '.join(r(c, c) for c in STRUCTURE)}, CAST(is_breakout_20 AS INTEGER) AS is_breakout_20, CAST({' + '.join(f'CASE WHEN dist_sma_{n} > 0 THEN 1 ELSE 0 END' for n in (20, 50, 200))} AS INTEGER) AS trend_alignment FROM ml")
BREADTHS = {"pct_above_50": "close > m50", "pct_above_200": "close > m200", "pct_up_20": f"close > lag(close, 20) {W}", "pct_up_50": f"close > lag(close, 50) {W}"}
R.add("ml3_breadth", lambda s, d: rp.with_breadth(bars(s, d)).select(*KEY, *BREADTHS, "breadth_score"), "ml0", f"WITH x AS (SELECT symbol_id, trade_date, {', '.join(f'CASE WHEN {c} THEN 1.0 ELSE 0 END AS {k}' for k, c in BREADTHS.items())} FROM ml0), y AS (SELECT symbol_id, trade_date, {', '.join(f'100 * avg({k}) OVER (PARTITION BY trade_date) AS {k}' for k in BREADTHS)} FROM x) SELECT symbol_id, trade_date, {', '.join(r(k, k) for k in BREADTHS)}, {r('(pct_above_50 + pct_above_200 + pct_up_20 + pct_up_50) / 4', 'breadth_score')} FROM y")


def with_sector(s, d):
    b, m = bars(s, d), master(s, d).filter("symbol_id % 7 <> 0")
    own = fac(s, d).join(m, "symbol_id").withColumn("stock_vs_sector", F.col("rs") - F.avg("rs").over(Window.partitionBy("trade_date", "sector")))
    day = mk.sector_returns(b, master(s, d)).withColumnRenamed("sector_pct", "sector_rs")
    return rp.with_sector(b.select(*KEY), m, day, own).select(*KEY, "sector", "sector_rs", "stock_vs_sector")


R.add("ml5_sector", with_sector, "fac secp", f"""WITH m AS (SELECT symbol_id, sector FROM master WHERE symbol_id % 7 <> 0), o AS (SELECT symbol_id, trade_date, rs - avg(rs) OVER (PARTITION BY trade_date, sector) AS v FROM fac JOIN m USING (symbol_id)) SELECT b.symbol_id, b.trade_date, coalesce(m.sector, 'Other') AS sector, {r('coalesce(s.sector_pct, 0.5)', 'sector_rs')}, {r('coalesce(o.v, 0)', 'stock_vs_sector')}
FROM bars b LEFT JOIN m ON m.symbol_id = b.symbol_id LEFT JOIN secp s ON s.trade_date = b.trade_date AND s.sector = coalesce(m.sector, 'Other') LEFT JOIN o ON o.symbol_id = b.symbol_id AND o.trade_date = b.trade_date""")
scores = lambda s, d: fac(s, d).filter("rs is not null and vol is not null").select(*KEY, F.col("prox").alias("technical_score"), F.round(1 / (1 + F.exp(-F.col("rs") / 50)), 9).alias("prob_5"), F.round(1 / (1 + F.exp(-F.col("vol"))), 9).alias("prob_20"))
OV = {"technical": "technical_score", "model_5": "prob_5", "model_20": "prob_20", "blended_5": "blend_5", "blended_20": "blend_20"}
R.add("ml9_overlay", lambda s, d: rp.overlay(scores(s, d)).select(*KEY, "blend_5", "blend_20", *[f"{k}_top" for k in OV]), "fac", f"""WITH x AS (SELECT symbol_id, trade_date, prox AS technical_score, round(1 / (1 + exp(-rs / 50)), 9) AS prob_5, round(1 / (1 + exp(-vol)), 9) AS prob_20 FROM fac WHERE rs IS NOT NULL AND vol IS NOT NULL), y AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS c, {', '.join(f'0.75 * technical_score + 0.25 * 100 * {pct(f"prob_{h}", "trade_date")} AS blend_{h}' for h in (5, 20))} FROM x)
SELECT symbol_id, trade_date, {r('blend_5', 'blend_5')}, {r('blend_20', 'blend_20')}, {', '.join(f'rank() OVER (PARTITION BY trade_date ORDER BY round({v}, 9) DESC) <= greatest(1, ceil(c * 0.1)) AS {k}_top' for k, v in OV.items())} FROM y""")
EV = f"WITH x AS (SELECT rs, fwd_5, CASE WHEN fwd_5 > 0 THEN 1 ELSE 0 END AS y, {pct('rs')} AS p, count(*) OVER () AS c FROM fac WHERE rs IS NOT NULL AND fwd_5 IS NOT NULL) SELECT count(*) AS n, {r('CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(y * p * c) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END', 'auc')}, {r('avg(CASE WHEN p > 0.9 THEN y END)', 'precision_10')}, {r('avg(CASE WHEN p > 0.9 THEN fwd_5 END)', 'mean_top_10')}, {r('avg(y)', 'base_rate')} FROM x"
R.add("ml11_evaluate", lambda s, d: rp.evaluate(fac(s, d).filter("rs is not null and fwd_5 is not null").withColumn("y", (F.col("fwd_5") > 0).cast("int")), "rs", "y", "fwd_5"), "fac", EV)

# --- ranks, movers, regimes ---------------------------------------------------------------------------------
DAY = "1997-06-16"


def factor_day(s, d):
    day = fac(s, d).withColumn("t", F.col("close") / F.avg("close").over(trailing(50))).filter(F.col("trade_date") == DAY).join(master(s, d).select("symbol_id", "sector"), "symbol_id")
    mean = F.round(F.avg("rs").over(Window.partitionBy("sector")), 9)
    return day.select(*KEY, F.col("rs").alias("rel_strength"), F.col("vol").alias("vol_intensity"), F.col("t").alias("trend_score"), F.col("prox").alias("prox_high"), "delivery_pct", mean.alias("sector_rs"), F.round(F.col("rs") - mean, 9).alias("stock_vs_sector"))


PCTS = ["rel_strength", "vol_intensity", "trend_score", "prox_high", "delivery_pct", "sector_rs", "stock_vs_sector"]
R.add("rk28_rank_day", lambda s, d: rp.rank_day(factor_day(s, d)).select(*KEY, "composite_score", *[f"{c}_pct" for c in PCTS]), "fac master", f"""WITH a AS (SELECT *, close / avg(close) {frame(50)} AS t FROM fac), b AS (SELECT a.*, sector, round(avg(rs) OVER (PARTITION BY sector), 9) AS m FROM a JOIN master USING (symbol_id) WHERE trade_date = DATE '{DAY}'), c AS (SELECT symbol_id, trade_date, rs AS rel_strength, vol AS vol_intensity, t AS trend_score, prox AS prox_high, delivery_pct, m AS sector_rs, round(rs - m, 9) AS stock_vs_sector FROM b),
e AS (SELECT symbol_id, trade_date, {', '.join(f'100 * CASE WHEN {c} IS NOT NULL THEN {pct(c, "trade_date")} END AS {c}_pct' for c in PCTS)} FROM c) SELECT symbol_id, trade_date, {r('0.25 * rel_strength_pct + 0.18 * vol_intensity_pct + 0.15 * trend_score_pct + 0.17 * prox_high_pct + 0.10 * delivery_pct_pct + 0.15 * (0.6 * sector_rs_pct + 0.4 * stock_vs_sector_pct)', 'composite_score')}, {', '.join(r(f'{c}_pct', f'{c}_pct') for c in PCTS)} FROM e""")
until = lambda s, d, day: rk.latest(fac(s, d).filter((F.col("trade_date") <= day) & F.col("rs").isNotNull())).select("symbol_id", F.to_date(F.lit(day)).alias("trade_date"), F.round("rs", 6).alias("composite_score"))
UNTIL = lambda day, k: f"SELECT symbol_id, score, rank() OVER (ORDER BY score DESC) AS {k} FROM (SELECT symbol_id, round(rs, 6) AS score FROM fac WHERE trade_date <= DATE '{day}' AND rs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY trade_date DESC) = 1)"
R.add("bo6_rank_movers", lambda s, d: rp.rank_movers(until(s, d, "1998-06-30"), until(s, d, "1998-06-20")), "fac", f"""WITH a AS ({UNTIL('1998-06-30', 'k')}), b AS ({UNTIL('1998-06-20', 'pk')}), x AS (SELECT symbol_id, CAST(k AS INTEGER) AS rank, round(a.score, 6) AS score, CAST(pk AS INTEGER) AS previous_rank, b.score AS previous_score, CAST(pk - k AS INTEGER) AS rank_change, a.score - b.score AS c FROM a JOIN b USING (symbol_id)), y AS (SELECT symbol_id, rank, score, previous_rank, previous_score, rank_change, {r('c', 'score_change')} FROM x)
SELECT * FROM (SELECT *, 'improver' AS side FROM y WHERE rank_change > 0 ORDER BY rank_change DESC, score_change DESC, symbol_id LIMIT 15) UNION ALL SELECT * FROM (SELECT *, 'decliner' AS side FROM y WHERE rank_change < 0 ORDER BY rank_change, score_change, symbol_id LIMIT 15)""")
sectors_at = lambda s, d, day: rk.latest(mk.sector_returns(bars(s, d), master(s, d)).filter((F.col("trade_date") <= day) & F.col("sector_return").isNotNull()), "sector").select("sector", F.round("sector_return", 6).alias("rs")).withColumn("rs_rank", F.rank().over(Window.orderBy(F.desc("rs"))))  # noqa: E731  one row a sector
SECTORS_AT = lambda day: f"SELECT sector, rs, CAST(rank() OVER (ORDER BY rs DESC) AS INTEGER) AS rs_rank FROM (SELECT sector, round(sector_return, 6) AS rs FROM sect WHERE trade_date <= DATE '{day}' AND sector_return IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sector ORDER BY trade_date DESC) = 1)"
R.add("bo7_sector_movers", lambda s, d: rp.sector_movers(sectors_at(s, d, "1998-06-30"), sectors_at(s, d, "1998-06-20")), "sect", f"WITH a AS ({SECTORS_AT('1998-06-30')}), b AS ({SECTORS_AT('1998-06-20')}) SELECT sector, a.rs, a.rs_rank, b.rs AS previous_rs, b.rs_rank AS previous_rank, b.rs_rank - a.rs_rank AS rank_change, {r('a.rs - b.rs', 'rs_change')} FROM a LEFT JOIN b USING (sector) ORDER BY b.rs_rank - a.rs_rank DESC NULLS LAST, sector LIMIT 10")
EDGE = lambda i: "CASE label " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in rp.REGIME_BANDS.items()) + " END"
R.add("br4_confidence", lambda s, d: rp.regime_confidence(markets.br(s, d)).select("trade_date", "label", "confidence"), "brs", f"WITH x AS (SELECT trade_date, label, coalesce(pct200, 0) AS p, {EDGE(0)} AS lo, {EDGE(1)} AS hi FROM brs) SELECT trade_date, label, {r('greatest(0, least(1, least(p - lo, hi - p) / ((hi - lo) / 2)))', 'confidence')} FROM x")
D1 = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
R.add("br11_breadth_history", lambda s, d: rp.breadth_history(bars(s, d), 52), "bars", f"""WITH x AS (SELECT trade_date, close, lag(close) {W} AS p, count(*) {frame(252)} >= 252 AS y, max(close) {frame(252)} AS h, min(close) {frame(252)} AS l FROM bars), g AS (SELECT trade_date, sum({D1('close > p')}) AS up, sum({D1('close < p')}) AS down, sum({D1('y')}) AS y, sum({D1('y AND close >= h')}) AS h, sum({D1('y AND close <= l')}) AS l FROM x GROUP BY 1), a AS (SELECT *, coalesce((up - down) / nullif(up + down, 0), 0) AS ad FROM g),
b AS (SELECT *, avg(ad) OVER w10 AS ad_10, avg(ad) OVER w20 AS ad_20, sum(ad) OVER w63 AS s63, avg(ad) OVER w252 AS m, CASE WHEN count(*) OVER w252 >= 2 THEN stddev_pop(ad) OVER w252 END AS s, avg(h / greatest(l, 1)) OVER w10 AS hl FROM a WINDOW {', '.join(f'w{n} AS (ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in (10, 20, 63, 252))})
SELECT trade_date, CAST(up AS BIGINT) AS advancers, CAST(down AS BIGINT) AS decliners, CAST(up - down AS BIGINT) AS ad_net, {r('ad', 'ad_pct')}, {r('ad_10', 'ad_10')}, {r('ad_20', 'ad_20')}, {r('s63', 'ad_sum_63')}, {r('CASE WHEN s > 1e-9 THEN (ad - m) / s ELSE 0 END', 'ad_z')}, CAST(h - l AS BIGINT) AS net_highs, {r('coalesce((h - l) / nullif(y, 0), 0)', 'net_highs_pct')}, {r('hl', 'high_low_10')} FROM b WHERE trade_date >= (SELECT max(trade_date) FROM b) - 364""")
SPEED = "CASE WHEN v > 10 THEN 'very_positive' WHEN v > 2 THEN 'positive' WHEN v > -2 THEN 'neutral' WHEN v > -10 THEN 'negative' WHEN v IS NOT NULL THEN 'very_negative' END"


def phases(s, d):
    v = F.round(F.col("score") - F.lag("score", 5).over(Window.orderBy("trade_date")), 6)  # one row a date
    speed = F.when(v > 10, "very_positive").when(v > 2, "positive").when(v > -2, "neutral").when(v > -10, "negative").when(v.isNotNull(), "very_negative")
    stage = F.when(F.col("pct50") >= 0.6, "S2").when(F.col("pct50") < 0.25, "S4").otherwise("MIXED")
    return rp.regime_phase(markets.br(s, d).withColumns({"velocity_bucket": speed, "market_stage": stage, "s2_pct": F.round("pct50", 6), "pct200": F.round("pct200", 6)})).select("trade_date", "phase", "level_zone")


R.add("br12_phase", phases, "brs", f"""WITH x AS (SELECT trade_date, label AS g, round(score - lag(score, 5) OVER (ORDER BY trade_date), 6) AS v, CASE WHEN pct50 >= 0.6 THEN 'S2' WHEN pct50 < 0.25 THEN 'S4' ELSE 'MIXED' END AS st, coalesce(round(pct50, 6), 0) AS s2, round(pct200, 6) AS p FROM brs), y AS (SELECT *, coalesce({SPEED}, '') IN ('positive', 'very_positive') AS up FROM x)
SELECT trade_date, CASE WHEN st = 'S4' OR g = 'risk_off' OR coalesce(p < 0.2, false) THEN 'bear_stage4' WHEN g IN ('bull', 'strong_bull') AND st = 'S2' AND (p IS NULL OR p > 0.55) THEN 'confirmed_stage2_bull' WHEN ((p IS NULL AND g = 'neutral') OR (p >= 0.2 AND p < 0.5)) AND up AND s2 < 0.3 THEN 'base_forming_stage1' WHEN ((p IS NULL AND g IN ('neutral', 'cautious_bull')) OR p >= 0.3) AND up AND s2 >= 0.3 THEN 'transition_stage1_to_stage2' ELSE 'mixed_wait' END AS phase,
CASE WHEN p < 0.2 THEN 'capitulation' WHEN p < 0.3 THEN 'bear_bottom_zone' WHEN p < 0.5 THEN 'base_recovery_zone' WHEN p < 0.75 THEN 'risk_on_zone' WHEN p < 0.9 THEN 'broad_bull_zone' WHEN p IS NOT NULL THEN 'overheated_breadth' END AS level_zone FROM y""")
PARTS = {"ma_slope": "greatest(0.0, least(100.0, 50 + rs))", "price_position": "prox", "relative_strength": "greatest(0.0, least(100.0, 50 + 2 * rs))", "base_breakout": "CASE WHEN vol > 1.5 THEN 100.0 ELSE 0.0 END", "volume": "least(100.0, 50 * vol)", "persistence": "delivery_pct"}
R.add("wk11_confidence", lambda s, d: rp.stage_confidence(fac(s, d).filter("rs is not null and vol is not null").select(*KEY, *[F.expr(e).cast("double").alias(k) for k, e in PARTS.items()], F.expr("CASE WHEN rs < -10 THEN 10.0 ELSE 0.0 END").cast("double").alias("penalty"))).select(*KEY, "confidence", "band"), "fac", f"WITH x AS (SELECT symbol_id, trade_date, greatest(0.0, least(100.0, {' + '.join(f'{w} * {PARTS[k]}' for k, w in rp.CONFIDENCE.items())} - CASE WHEN rs < -10 THEN 10.0 ELSE 0.0 END)) AS c FROM fac WHERE rs IS NOT NULL AND vol IS NOT NULL) SELECT symbol_id, trade_date, {r('c', 'confidence')}, CASE WHEN c < 50 THEN 'LOW' WHEN c < 65 THEN 'MEDIUM' WHEN c < 80 THEN 'HIGH' ELSE 'VERY_HIGH' END AS band FROM x")
last_ = lambda s, d: rk.latest(fac(s, d))
LASTF = "l AS (SELECT * FROM fac QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY trade_date DESC) = 1)"
R.add("ev10_universe", lambda s, d: rp.catalyst_universe(last_(s, d).filter("rs is not null").orderBy(F.desc("rs"), "symbol_id").limit(5), master(s, d).filter("market_cap > 8000"), last_(s, d).filter("vol >= 1.5"), last_(s, d).filter("fwd_5 is null and rs > 0")), "fac master", f"WITH {LASTF}, u AS (SELECT symbol_id, 1 AS p FROM (SELECT symbol_id FROM l WHERE rs IS NOT NULL ORDER BY rs DESC, symbol_id LIMIT 5) UNION ALL SELECT symbol_id, 2 FROM master WHERE market_cap > 8000 UNION ALL SELECT symbol_id, 3 FROM l WHERE vol >= 1.5 UNION ALL SELECT symbol_id, 4 FROM l WHERE rs > 0) SELECT symbol_id, CAST(min(p) AS INTEGER) AS priority FROM u GROUP BY 1")
R.add("tj12_prioritise", lambda s, d: rp.prioritise(last_(s, d).select("symbol_id", F.col("rs").alias("composite_score"), F.col("prox").alias("rank_confidence"), F.col("vol").alias("decay_score"))), "fac", f"WITH {LASTF} SELECT symbol_id, {r('rs', 'composite_score')}, {r('prox', 'rank_confidence')}, {r('vol', 'decay_score')} FROM l ORDER BY rs DESC NULLS LAST, prox DESC NULLS LAST, vol DESC NULLS LAST, symbol_id")
