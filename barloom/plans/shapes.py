"""Queries of patterns (PT) and further small operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.stats import along, pct_rank
from barloom.operators import indicators as ti
from barloom.operators import market as mk
from barloom.operators import patterns as pt
from barloom.operators import ranking as rk
from barloom.plans import companies, markets  # noqa: F401  their SQL definitions are used here
from barloom.plans.formations import NEAR, structure_sql
from barloom.plans.kit import NEEDS, SQL, Registry
from barloom.plans.ranks import LATEST, TOP
from barloom.plans.technical import VZ, W, frame, pct, r
from barloom.sources.bars import bars, events, master

R = Registry()
KEY = ["symbol_id", "trade_date"]
close = r("close", "close")
R.add("pt1_smooth", lambda s, d: pt.smooth(bars(s, d)).select(*KEY, "smooth"), "bars", "SELECT symbol_id, trade_date, round(avg(close) OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM bars")
R.add("pt2_turning_points", lambda s, d: pt.turning_points(bars(s, d)), "bars", f"WITH x AS (SELECT *, lag(close) {W} AS b, lead(close) {W} AS a FROM bars), y AS (SELECT symbol_id, trade_date, {close}, CASE WHEN close > b AND close > a THEN 'peak' WHEN close < b AND close < a THEN 'trough' END AS kind FROM x) SELECT * FROM y WHERE kind IS NOT NULL")
R.add("pt9_flat_base", lambda s, d: pt.flat_base(bars(s, d), 10, 0.9), "bars", f"WITH x AS (SELECT *, CASE WHEN count(*) {frame(10, 1)} >= 10 THEN max(high) {frame(10, 1)} END AS h, min(low) {frame(10, 1)} AS l FROM bars) SELECT symbol_id, trade_date, {close} FROM x WHERE 1 - l / h <= 0.9 AND close > h")
R.add("pt12_pocket_pivot", lambda s, d: pt.pocket_pivot(bars(s, d)), "bars", f"WITH x AS (SELECT *, lag(close) {W} AS p FROM bars), y AS (SELECT *, CASE WHEN close < p THEN volume END AS dv FROM x), z AS (SELECT *, max(dv) {frame(10, 1)} AS m FROM y) SELECT symbol_id, trade_date, {close} FROM z WHERE close > p AND volume > m")
R.add("pt16_tight_weeks", lambda s, d: pt.tight_weeks(mk.weekly(bars(s, d)), 20.0), "wk", f"WITH x AS (SELECT *, lag(close, 1) OVER w AS a, lag(close, 2) OVER w AS b FROM wk WINDOW w AS (PARTITION BY symbol_id ORDER BY week_end)) SELECT symbol_id, week_end, {close} FROM x WHERE abs(close / nullif(a, 0) - 1) <= 0.2 AND abs(a / nullif(b, 0) - 1) <= 0.2")
R.add("pt18_inside_bars", lambda s, d: pt.inside_bar_breaks(bars(s, d)), "bars", f"WITH x AS (SELECT *, lag(high, 1) {W} AS h1, lag(high, 2) {W} AS h2, lag(low, 1) {W} AS l1, lag(low, 2) {W} AS l2 FROM bars) SELECT symbol_id, trade_date, {close} FROM x WHERE h1 <= h2 AND l1 >= l2 AND close > h2")
RUNS = f"""WITH a AS (SELECT *, volume / nullif(avg(volume) {frame(20, 1)}, 0) AS v, {VZ}, row_number() {W} AS n, CASE WHEN high <= lag(high) {W} AND low >= lag(low) {W} THEN 0 ELSE 1 END AS out FROM bars),
b AS (SELECT *, max(CASE WHEN out = 1 THEN n END) OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_out FROM a), c AS (SELECT *, least(n - 1 - last_out, 3) AS inside_bars FROM b)
SELECT c.symbol_id, c.trade_date, {r("c.close", "close")}, CAST(inside_bars AS INTEGER) AS inside_bars, m.trade_date AS mother_date, {r("m.high", "mother_high")}, {r("m.low", "mother_low")}
FROM c JOIN a m ON m.symbol_id = c.symbol_id AND m.n = c.n - 1 - inside_bars WHERE inside_bars > 0 AND c.n >= 5 AND c.close > m.high AND c.v >= 1.5 AND (c.vol_z20 >= 2 OR c.vol_z50 >= 2)"""
R.add("pt18_inside_runs", lambda s, d: pt.inside_run_breaks(bars(s, d)), "bars", RUNS)
R.add("pt25_changed", lambda s, d: pt.changed_symbols(bars(s, d)), "bars", f"WITH x AS (SELECT symbol_id, trade_date, abs(close / nullif(lag(close) {W}, 0) - 1) AS m, volume / nullif(avg(volume) {frame(20, 1)}, 0) AS v FROM bars {LATEST}) SELECT symbol_id, trade_date FROM x WHERE m >= 0.01 OR v >= 1.3")
SQL["sig"] = f"SELECT symbol_id, trade_date, setup_family AS family, conviction, round(lead(close, 20) {W} / nullif(close, 0) - 1, 6) AS fwd_20 FROM bo"
NEEDS["sig"] = ["bo"]


def signals(s, d):
    rows = mk.forward(mk.breakouts(bars(s, d)), 20).withColumn("fwd_20", F.round("fwd_20", 6))
    return rows.filter("setup_family is not null").select(*KEY, F.col("setup_family").alias("family"), "conviction", "fwd_20")


R.add("pt28_best_per_symbol", lambda s, d: pt.best_per_symbol(signals(s, d), "conviction").select(*KEY, "family"), "sig", "SELECT symbol_id, trade_date, family FROM sig WHERE family IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY conviction DESC, trade_date DESC) = 1")
R.add("pt29_outcomes", lambda s, d: signals(s, d).select(*KEY, "family", "fwd_20", (F.col("fwd_20") > 0).alias("hit")), "sig", "SELECT symbol_id, trade_date, family, fwd_20, fwd_20 > 0 AS hit FROM sig WHERE family IS NOT NULL")
HIT = r("avg(CASE WHEN fwd_20 > 0 THEN 1.0 WHEN fwd_20 IS NOT NULL THEN 0 END)", "hit_rate")
R.add("pt30_families", lambda s, d: pt.family_statistics(signals(s, d)), "sig", f"SELECT family, count(*) AS signals, {HIT}, {r('avg(fwd_20)', 'mean')}, {r('quantile_cont(fwd_20, 0.5)', 'median')} FROM sig WHERE family IS NOT NULL GROUP BY ROLLUP (family)")
R.add("pt31_by_year", lambda s, d: pt.by_year(signals(s, d)), "sig", f"SELECT CAST(year(trade_date) AS INTEGER) AS year, family, count(*) AS signals, {r('avg(fwd_20)', 'mean')} FROM sig WHERE family IS NOT NULL GROUP BY 1, 2")
def staged(s, d):
    """Weekly stages with their age and the stage before."""
    rows = mk.stage_age(mk.classify(mk.weekly(bars(s, d))))
    return rows.select("symbol_id", "week_end", "stage", F.col("bars_in_stage").alias("weeks_in_stage"), F.when(F.contains("transition", F.lit("->")), F.split("transition", "->")[0]).alias("previous_stage"))


R.add("rk25_freshness", lambda s, d: rk.freshness(staged(s, d)).select("symbol_id", "week_end", "bonus"), "age", "SELECT symbol_id, week_end, CAST(CASE WHEN stage <> 'S2' THEN 0.0 WHEN bars_in_stage <= 8 THEN 4.0 WHEN bars_in_stage <= 15 THEN 2.0 ELSE 0.0 END + CASE WHEN transition = 'S1->S2' AND bars_in_stage <= 8 THEN 5.0 ELSE 0.0 END AS DOUBLE) AS bonus FROM age")
#: Score of the structure of each symbol's last bar, and its last weekly stage.
EXTRA = f"sx AS (SELECT *, {NEAR}, 0 AS rs FROM bars), {structure_sql('sx')}, two AS (SELECT symbol_id, stage2_score FROM st {LATEST}), weekly AS (SELECT symbol_id, stage, bars_in_stage, transition FROM age QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY week_end DESC) = 1)"
R.add("rk26_rank_latest", lambda s, d: rk.rank_latest(bars(s, d), master(s, d), stages=rk.latest(staged(s, d), order="week_end")).select("symbol_id", "sector", "composite", "penalty", "stage2_score", "adjusted", "rank"), "bars master age", TOP.replace("WITH ", f"WITH {EXTRA}, ", 1))
R.add("rk27_rank_all_days", lambda s, d: rk.rank_all_days(bars(s, d), master(s, d), staged(s, d)).select("symbol_id", "trade_date", "composite", "rank", "adjusted", "eligible"))
R.add("bo14_trend_flips", lambda s, d: ti.batch_supertrend(ti.adx(bars(s, d))).withColumn("_p", F.lag("st_direction").over(along())).filter("st_direction = 1 and _p < 1 and adx >= 10").select(*KEY))
R.add("bo15_extremes", lambda s, d: ti.rsi(ti.adx(bars(s, d))).filter("(rsi_14 < 30 or rsi_14 > 70) and adx < 25").select(*KEY))
R.add("br8_phase1", lambda s, d: mk.breadth(bars(s, d)).select("trade_date", (70 * F.col("pct50") + 30 * F.col("pct200")).alias("score"), (F.col("advances") / F.nullif(F.col("declines"), F.lit(0))).alias("ad_ratio")), "br", f"SELECT trade_date, {r('70 * pct50 + 30 * pct200', 'score')}, {r('advances * 1.0 / nullif(declines, 0)', 'ad_ratio')} FROM br")
R.add("br9_latest", lambda s, d: rk.latest(rk.returns(rk.averages(bars(s, d)), 20)).agg(F.avg((F.col("close") > F.col("sma_50")).cast("double")).alias("above_50"), F.avg((F.col("close") > F.col("sma_200")).cast("double")).alias("above_200"), F.avg((F.col("ret_20") > 0).cast("double")).alias("up_20")), "bars", f"WITH x AS (SELECT close, avg(close) {frame(50)} AS a, avg(close) {frame(200)} AS b, close > lag(close, 20) {W} AS u FROM bars {LATEST}) SELECT {r('avg(CASE WHEN close > a THEN 1.0 ELSE 0 END)', 'above_50')}, {r('avg(CASE WHEN close > b THEN 1.0 ELSE 0 END)', 'above_200')}, {r('avg(CASE WHEN u THEN 1.0 WHEN u IS NOT NULL THEN 0 END)', 'up_20')} FROM x")
R.add("br10_trend_regime", lambda s, d: rk.latest(ti.adx(bars(s, d))).select("symbol_id", F.when(F.col("adx") >= 25, "TREND").otherwise("MEAN_REV").alias("regime")))
R.add("sr14_quadrants", lambda s, d: mk.rotation(mk.sector_returns(bars(s, d), master(s, d))).groupBy("quadrant").agg(F.count("*").alias("n")))
R.add("ml4_percentiles", lambda s, d: rk.returns(bars(s, d), 5, 20).select(*KEY, *[pct_rank(F.round(c, 6), "trade_date").alias(f"{c}_pct") for c in ("ret_5", "ret_20")]), "bars", f"WITH x AS (SELECT symbol_id, trade_date, round(100 * (close / nullif(lag(close, 5) {W}, 0) - 1), 6) AS a, round(100 * (close / nullif(lag(close, 20) {W}, 0) - 1), 6) AS b FROM bars) SELECT symbol_id, trade_date, {r(pct('a', 'trade_date'), 'ret_5_pct')}, {r(pct('b', 'trade_date'), 'ret_20_pct')} FROM x")
R.add("ev8_union", lambda s, d: events(s, d).filter("importance > 50").select("symbol_id", "category").unionByName(events(s, d).filter("source = 1").select("symbol_id", "category")).distinct(), "ev", "SELECT symbol_id, category FROM ev WHERE importance > 50 UNION SELECT symbol_id, category FROM ev WHERE source = 1")
