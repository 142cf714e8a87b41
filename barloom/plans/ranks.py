"""Queries of the ranking operators (RK) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as ti
from barloom.operators import ranking as rk
from barloom.plans.kit import Registry
from barloom.plans.technical import W, frame, pct, r
from barloom.sources.bars import bars, benchmark, master

R = Registry()
LATEST = "QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY trade_date DESC) = 1"


def last(name, operator, columns, sql, names="bars"):
    R.add(name, lambda s, d: rk.latest(operator(bars(s, d))).select("symbol_id", *columns), names, sql)


RETS = {n: f"100 * (close / nullif(lag(close, {n}) {W}, 0) - 1)" for n in (5, 10, 20, 60, 120)}
last("rk1_returns", rk.returns, [f"ret_{n}" for n in RETS], "SELECT symbol_id, " + ", ".join(r(x, f"ret_{n}") for n, x in RETS.items()) + f" FROM bars {LATEST}")
last("rk2_volume", rk.volume_stats, ["vol_mean", "vol_max", "vol_z"], f"SELECT symbol_id, {r(f'avg(volume) {frame(21)}', 'vol_mean')}, {r(f'max(volume) {frame(21)}', 'vol_max')}, {r(f'(volume - avg(volume) {frame(20, 1)}) / nullif(stddev_samp(volume) {frame(20, 1)}, 0)', 'vol_z')} FROM bars {LATEST}")
last("rk3_averages", rk.averages, ["sma_20", "sma_50", "sma_200", "bar_count"], "SELECT symbol_id, " + ", ".join(r(f"avg(close) {frame(n)}", f"sma_{n}") for n in (20, 50, 200)) + f", count(*) {W} AS bar_count FROM bars {LATEST}")
last("rk4_year_high", rk.year_high, ["high_52w", "lookback"], f"SELECT symbol_id, {r(f'max(high) {frame(252)}', 'high_52w')}, count(*) {frame(252)} AS lookback FROM bars {LATEST}")

#: One row per symbol at its last bar, as SQL.
BASE = f"""base AS (SELECT symbol_id, trade_date, close, volume, high, {", ".join(f"{x} AS ret_{n}" for n, x in RETS.items())}, avg(close) {frame(20)} AS sma_20, avg(close) {frame(50)} AS sma_50, avg(close) {frame(200)} AS sma_200, count(*) {W} AS bar_count,
avg(volume) {frame(21)} AS vol_mean, (volume - avg(volume) {frame(20, 1)}) / nullif(stddev_samp(volume) {frame(20, 1)}, 0) AS vol_z, CASE WHEN count(*) {frame(20, 1)} >= 20 THEN (volume - avg(volume) {frame(20, 1)}) / nullif(stddev_pop(volume) {frame(20, 1)}, 0) END AS vol_z20, max(high) {frame(252)} AS high_52w, count(*) {frame(252)} AS lookback FROM bars {LATEST}),
snap AS (SELECT b.*, coalesce(sector, 'Other') AS sector, market_cap FROM base b LEFT JOIN master USING (symbol_id))"""


def snapshot(s, d):
    rows = rk.latest(rk.year_high(rk.averages(rk.volume_stats(rk.returns(bars(s, d))))))
    return rows.join(master(s, d), "symbol_id", "left").withColumn("sector", F.coalesce("sector", F.lit("Other"))).withColumn("trade_date", F.lit("2001-12-31").cast("date"))


def snap(name, operator, columns, select, more=""):
    R.add(name, lambda s, d: operator(snapshot(s, d)).select("symbol_id", *columns), "bars master", f"WITH {BASE}{more} SELECT symbol_id, {select}")


def p(x, keys=""):
    return f"coalesce({pct(x, keys)}, 0.5)"


RS = f"0.2 * 100 * {p('ret_20')} + 0.5 * 100 * {p('ret_60')} + 0.3 * 100 * {p('ret_120')}"
snap("rk5_relative_strength", rk.relative_strength, ["rel_strength"], f"{r(RS, 'rel_strength')} FROM snap")
snap("rk7_acceleration", rk.acceleration, ["acceleration"], f"{r('0.6 * (ret_5 - ret_20) + 0.4 * (ret_10 - ret_20)', 'acceleration')} FROM snap")
snap("rk8_volume_intensity", rk.volume_intensity, ["volume_intensity"], f"{r('0.6 * greatest(0.0, least(5.0, volume / nullif(vol_mean, 0))) + 0.4 * CASE WHEN vol_z IS NOT NULL THEN greatest(-3.0, least(5.0, vol_z)) END', 'volume_intensity')} FROM snap")
snap("rk10_above_long_average", rk.above_long_average, ["above_sma200_pct"], f"{r('CASE WHEN bar_count >= 200 THEN 100 * (close / nullif(sma_200, 0) - 1) ELSE 0 END', 'above_sma200_pct')} FROM snap")
snap("rk11_proximity", rk.proximity, ["proximity", "short_history"], f"{r('greatest(0.0, least(100.0, 100 * close / nullif(high_52w, 0)))', 'proximity')}, lookback < 252 AS short_history FROM snap")
DP = f"avg(delivery_pct) {frame(5)}"


def delivery_rows(s, d):
    rows = rk.latest(bars(s, d).withColumn("dp", F.when(F.col("delivery_pct") > 30, F.col("delivery_pct"))))
    return rows.join(master(s, d), "symbol_id").withColumn("trade_date", F.lit("2001-12-31").cast("date"))


R.add("rk12_fill_by_sector", lambda s, d: rk.fill_by_sector(delivery_rows(s, d), "dp").select("symbol_id", "dp", "dp_imputed"), "bars master", f"""WITH a AS (SELECT symbol_id, sector, CASE WHEN delivery_pct > 30 THEN delivery_pct END AS dp FROM bars JOIN master USING (symbol_id) {LATEST})
SELECT symbol_id, {r('coalesce(dp, quantile_cont(dp, 0.5) OVER (PARTITION BY sector), quantile_cont(dp, 0.5) OVER (), 20.0)', 'dp')}, dp IS NULL AS dp_imputed FROM a""")
WINS = "greatest(lo, least(hi, {x}))"
R.add("rk14_winsorise", lambda s, d: rk.winsorise(snapshot(s, d), "ret_20").select("symbol_id", "ret_20"), "bars master", f"WITH {BASE}, e AS (SELECT quantile_cont(ret_20, 0.05) AS lo, quantile_cont(ret_20, 0.95) AS hi FROM snap) SELECT symbol_id, {r('CASE WHEN ret_20 IS NOT NULL THEN greatest(lo, least(hi, ret_20)) END', 'ret_20')} FROM snap, e")
R.add("rk15_demean", lambda s, d: rk.demean(snapshot(s, d), "ret_20").select("symbol_id", "ret_20"), "bars master", f"WITH {BASE} SELECT symbol_id, {r('ret_20 - quantile_cont(ret_20, 0.5) OVER (PARTITION BY sector)', 'ret_20')} FROM snap")

TREND_SQL = f"""tr AS (SELECT symbol_id, trade_date, close, greatest(high, lag(close) {W}) - least(low, lag(close) {W}) AS tr, high - lag(high) {W} AS u, lag(low) {W} - low AS d FROM bars),
di AS (SELECT *, 100 * avg(CASE WHEN u > d AND u > 0 THEN u ELSE 0 END) {frame(14)} / nullif(avg(tr) {frame(14)}, 0) AS pdi, 100 * avg(CASE WHEN d > u AND d > 0 THEN d ELSE 0 END) {frame(14)} / nullif(avg(tr) {frame(14)}, 0) AS mdi FROM tr),
dx AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di), adx AS (SELECT symbol_id, avg(dx) {frame(14)} AS adx, avg(tr) {frame(14)} AS atr_14 FROM dx {LATEST})"""
TREND = "0.7 * least(coalesce(adx, 0) / 50 * 100, 100.0) + 0.3 * (CASE WHEN close > sma_20 THEN 40 ELSE 0 END + CASE WHEN close > sma_50 THEN 60 ELSE 0 END)"


def trended(s, d):
    rows = rk.latest(rk.year_high(rk.averages(rk.volume_stats(rk.returns(ti.atr(ti.adx(ti.volume_zscore(bars(s, d), 20))))))))
    rows = rows.join(master(s, d), "symbol_id", "left").withColumn("sector", F.coalesce("sector", F.lit("Other"))).withColumn("trade_date", F.lit("2001-12-31").cast("date"))
    from barloom.functions.stats import pct_rank

    rows = rows.withColumn("liquidity_pct", pct_rank(F.col("close") * F.col("volume"), "trade_date"))
    return rk.proximity(rk.trend_score(rk.relative_strength(rows)))


R.add("rk9_trend_score", lambda s, d: trended(s, d).select("symbol_id", "trend"), "bars master", f"WITH {BASE}, {TREND_SQL} SELECT symbol_id, {r(TREND, 'trend')} FROM snap JOIN adx USING (symbol_id)")


def sectored(s, d):
    rows = trended(s, d)
    return rk.attach_sector(rows, rows.groupBy("sector", "trade_date").agg(F.avg("rel_strength").alias("sector_rs")))


FACTORS = f"""fa AS (SELECT snap.*, adx, atr_14, {RS} AS rel_strength, {TREND} AS trend, greatest(0.0, least(100.0, 100 * close / nullif(high_52w, 0))) AS proximity, close * volume AS tv FROM snap JOIN adx USING (symbol_id)),
fb AS (SELECT *, {pct('tv')} AS liquidity_pct, round(avg(rel_strength) OVER (PARTITION BY sector), 9) AS sector_rs, round(rel_strength - round(avg(rel_strength) OVER (PARTITION BY sector), 9), 9) AS vs_sector FROM fa),
fc AS (SELECT *, 60 * {p('sector_rs')} + 40 * {p('vs_sector')} AS sector_strength FROM fb)"""
R.add("rk13_attach_sector", lambda s, d: sectored(s, d).select("symbol_id", "sector_rs"), "bars master", f"WITH {BASE}, {TREND_SQL}, {FACTORS} SELECT symbol_id, {r('sector_rs', 'sector_rs')} FROM fc")
#: Factors are rounded on both sides before they are ranked, so that ties are the same.
R.add("rk16_composite", lambda s, d: rk.composite(sectored(s, d), {"rel_strength": 0.38, "trend": 0.22, "proximity": 0.4}).select("symbol_id", "composite", "rank", "sector_rank", "sector_size"), "bars master", f"""WITH {BASE}, {TREND_SQL}, {FACTORS}, q AS (SELECT symbol_id, sector, round(rel_strength, 6) AS a, round(trend, 6) AS b, round(proximity, 6) AS c FROM fc),
e AS (SELECT quantile_cont(a, 0.05) AS la, quantile_cont(a, 0.95) AS ha, quantile_cont(b, 0.05) AS lb, quantile_cont(b, 0.95) AS hb, quantile_cont(c, 0.05) AS lc, quantile_cont(c, 0.95) AS hc FROM q),
w AS (SELECT symbol_id, sector, greatest(la, least(ha, a)) AS a, greatest(lb, least(hb, b)) AS b, greatest(lc, least(hc, c)) AS c FROM q, e),
m AS (SELECT symbol_id, sector, round(a - quantile_cont(a, 0.5) OVER (PARTITION BY sector), 9) AS a, round(b - quantile_cont(b, 0.5) OVER (PARTITION BY sector), 9) AS b, c FROM w),
t AS (SELECT symbol_id, sector, 38 * {p('a')} + 22 * {p('b')} + 40 * {p('c')} AS composite FROM m)
SELECT symbol_id, {r('composite', 'composite')}, CAST(row_number() OVER (ORDER BY round(composite, 6) DESC, symbol_id) AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY sector ORDER BY round(composite, 6) DESC, symbol_id) AS INTEGER) AS sector_rank, count(*) OVER (PARTITION BY sector) AS sector_size FROM t""")


RANKED = f"ranked AS (SELECT symbol_id, {RS} AS composite FROM snap)"


def by_strength(s, d):
    return rk.relative_strength(snapshot(s, d)).withColumn("composite", F.col("rel_strength"))


R.add("rk17_top", lambda s, d: rk.top(by_strength(s, d), 25, 40.0).select("symbol_id", "composite"), "bars master", f"WITH {BASE}, {RANKED} SELECT symbol_id, {r('composite', 'composite')} FROM ranked WHERE composite >= 40 ORDER BY round(composite, 6) DESC, symbol_id LIMIT 25")
ELIG = "CASE WHEN close < 20 THEN 'price' END, CASE WHEN bar_count < 60 THEN 'history' END, CASE WHEN coalesce(liquidity_pct, 0) < 0.2 THEN 'liquidity' END"
STRETCH = "close / nullif(sma_20, 0) - 1"
SIGNS = f"(CASE WHEN vol_z20 > 3 THEN 1 ELSE 0 END + CASE WHEN {STRETCH} > 0.12 THEN 1 ELSE 0 END)"
PEN = f"CASE WHEN bar_count >= 200 AND close < sma_200 THEN 10.0 ELSE 0.0 END + CASE WHEN liquidity_pct < 0.2 THEN 10.0 ELSE 0.0 END + CASE WHEN atr_14 / nullif(close, 0) > 0.08 THEN 5.0 ELSE 0.0 END + CASE WHEN vol_z20 > 4 OR {STRETCH} > 0.20 OR {SIGNS} >= 2 THEN 8.0 WHEN {SIGNS} >= 1 THEN 3.0 ELSE 0.0 END"
GATED = f"WITH {BASE}, {TREND_SQL}, {FACTORS}, g AS (SELECT *, concat_ws(',', {ELIG}) AS rejection, {PEN} AS penalty FROM fc)"
R.add("rk18_confidence", lambda s, d: rk.confidence(rk.penalties(rk.eligibility(trended(s, d)))).select("symbol_id", "confidence"), "bars master", f"{GATED} SELECT symbol_id, {r('''least(bar_count / 252.0, 1.0) * CASE WHEN rejection = '' THEN 1.0 ELSE 0.5 END * (1 - penalty / 100)''', 'confidence')} FROM g")
R.add("rk22_eligibility", lambda s, d: rk.eligibility(trended(s, d)).select("symbol_id", "rejection", "eligible"), "bars master", f"{GATED} SELECT symbol_id, rejection, rejection = '' AS eligible FROM g")
R.add("rk23_penalties", lambda s, d: rk.penalties(trended(s, d)).select("symbol_id", "penalty"), "bars master", f"{GATED} SELECT symbol_id, {r('penalty', 'penalty')} FROM g")


def day_ranks(s, d, skip):
    """Ranks by 20-bar return at each symbol's last bar, or some bars before."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date")))
    rows = rk.returns(bars(s, d), 20).withColumn("_n", back).filter(F.col("_n") == 1 + skip).withColumn("composite", F.round("ret_20", 6)).filter("composite is not null")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "symbol_id"))).select("symbol_id", "composite", "rank")


DAYS = f"""a AS (SELECT symbol_id, round(100 * (close / nullif(lag(close, 20) {W}, 0) - 1), 6) AS composite, row_number() OVER (PARTITION BY symbol_id ORDER BY trade_date DESC) AS n FROM bars),
now_ AS (SELECT symbol_id, composite, row_number() OVER (ORDER BY composite DESC, symbol_id) AS rank FROM a WHERE n = 1 AND composite IS NOT NULL), old AS (SELECT symbol_id, composite AS c, row_number() OVER (ORDER BY composite DESC, symbol_id) AS previous_rank FROM a WHERE n = 6 AND composite IS NOT NULL)"""
R.add("rk19_rank_change", lambda s, d: rk.rank_change(day_ranks(s, d, 0), day_ranks(s, d, 5)), "bars", f"WITH {DAYS} SELECT symbol_id, composite, CAST(rank AS INTEGER) AS rank, CAST(previous_rank AS INTEGER) AS previous_rank, CAST(previous_rank - rank AS INTEGER) AS rank_delta, {r('composite - c', 'score_delta')} FROM now_ LEFT JOIN old USING (symbol_id)")
R.add("rk20_churn", lambda s, d: rk.churn(day_ranks(s, d, 0), day_ranks(s, d, 5)), "bars", f"WITH {DAYS} SELECT {r('avg(CASE WHEN rank <> previous_rank THEN 1.0 ELSE 0.0 END)', 'churn')}, count(*) AS compared FROM now_ JOIN old USING (symbol_id)")
R.add("rk21_factor_correlation", lambda s, d: rk.factor_correlation(snapshot(s, d), ["ret_5", "ret_20", "ret_60"]), "bars master", f"""WITH {BASE}, c AS (SELECT corr(ret_5, ret_20) AS a, corr(ret_5, ret_60) AS b, corr(ret_20, ret_60) AS c FROM snap)
SELECT 'ret_5' AS "left", 'ret_20' AS "right", {r('a', 'correlation')}, abs(a) > 0.7 AS violation FROM c UNION ALL SELECT 'ret_5', 'ret_60', round(b, 6), abs(b) > 0.7 FROM c UNION ALL SELECT 'ret_20', 'ret_60', round(c, 6), abs(c) > 0.7 FROM c""")
R.add("rk24_decay", lambda s, d: rk.decay(rk.latest(bars(s, d)), F.to_date(F.lit("2001-11-15"))).select("symbol_id", "age_days", "decay"), "bars", f"SELECT symbol_id, CAST(DATE '2001-11-15' - trade_date AS INTEGER) AS age_days, {r('''greatest(0.0, 1 - (DATE '2001-11-15' - trade_date) / 30.0)''', 'decay')} FROM bars {LATEST}")
PANEL = f"panel AS (SELECT symbol_id, trade_date, round(close / nullif(lag(close, 20) {W}, 0) - 1, 6) AS s, round(lead(close, 5) {W} / nullif(close, 0) - 1, 6) AS o FROM bars)"


def panel(s, d):
    from barloom.functions.stats import along

    b = bars(s, d)
    return b.select("symbol_id", "trade_date", F.round(F.col("close") / F.nullif(F.lag("close", 20).over(along()), F.lit(0.0)) - 1, 6).alias("s"), F.round(F.lead("close", 5).over(along()) / F.nullif(F.col("close"), F.lit(0.0)) - 1, 6).alias("o"))


R.add("rk30_information", lambda s, d: rk.information(panel(s, d), "s", "o", 5), "bars", f"""WITH {PANEL}, k AS (SELECT * FROM panel WHERE s IS NOT NULL AND o IS NOT NULL), x AS (SELECT trade_date, o, {pct('s', 'trade_date')} AS ps, {pct('o', 'trade_date')} AS po, row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol_id) AS a, row_number() OVER (PARTITION BY trade_date ORDER BY o DESC, symbol_id) AS b, ntile(10) OVER (PARTITION BY trade_date ORDER BY s DESC, symbol_id) AS t FROM k)
SELECT trade_date, count(*) AS n, {r('CASE WHEN isnan(corr(ps, po)) THEN NULL ELSE corr(ps, po) END', 'ic')}, {r('avg(CASE WHEN a <= 5 THEN CASE WHEN b <= 5 THEN 1.0 ELSE 0.0 END END)', 'hit_rate')}, {r('avg(CASE WHEN t = 1 THEN o END) - avg(o)', 'lift')} FROM x GROUP BY trade_date""")
FOUR = ("rel_strength", "trend", "proximity", "sector_strength")
TOP = f"""WITH {BASE}, {TREND_SQL}, {FACTORS}, q AS (SELECT *, {", ".join(f"round({c}, 6) AS f{k}" for k, c in enumerate(FOUR))} FROM fc),
e AS (SELECT {", ".join(f"quantile_cont(f{k}, 0.05) AS l{k}, quantile_cont(f{k}, 0.95) AS h{k}" for k in range(4))} FROM q),
w AS (SELECT q.* REPLACE ({", ".join(f"CASE WHEN f{k} IS NOT NULL THEN greatest(l{k}, least(h{k}, f{k})) END AS f{k}" for k in range(4))}) FROM q, e),
m AS (SELECT * REPLACE ({", ".join(f"round(f{k} - quantile_cont(f{k}, 0.5) OVER (PARTITION BY sector), 9) AS f{k}" for k in range(2))}) FROM w),
t AS (SELECT *, 38 * {p('f0')} + 22 * {p('f1')} + 18 * {p('f2')} + 22 * {p('f3')} AS composite, concat_ws(',', {ELIG}) AS rejection, {PEN} AS penalty FROM m),
u AS (SELECT *, CAST(row_number() OVER (ORDER BY round(composite, 6) DESC, symbol_id) AS INTEGER) AS rank FROM t),
v AS (SELECT u.*, least(100, two.stage2_score + CASE WHEN rel_strength >= 70 THEN 10 ELSE 0 END + CASE WHEN rel_strength >= 85 THEN 10 ELSE 0 END) AS stage2_score, CASE WHEN stage = 'S2' THEN CASE WHEN bars_in_stage <= 8 THEN 4 WHEN bars_in_stage <= 15 THEN 2 ELSE 0 END ELSE 0 END + CASE WHEN transition = 'S1->S2' AND bars_in_stage <= 8 THEN 5 ELSE 0 END AS bonus FROM u LEFT JOIN two USING (symbol_id) LEFT JOIN weekly USING (symbol_id))
SELECT symbol_id, sector, {r('composite', 'composite')}, {r('penalty', 'penalty')}, CAST(stage2_score AS DOUBLE) AS stage2_score, {r('greatest(0.0, least(100.0, composite + 5 * coalesce(stage2_score, 0) / 100 + bonus - penalty))', 'adjusted')}, rank FROM v WHERE rejection = '' ORDER BY round(composite, 6) DESC, symbol_id LIMIT 25"""
R.add("rk6_excess_strength", lambda s, d: rk.excess_strength(rk.relative_strength(rk.returns(bars(s, d))), rk.returns(benchmark(bars(s, d)).withColumnRenamed("bench_close", "close").withColumn("symbol_id", F.lit(0)), 20, 60)).select("symbol_id", "trade_date", "excess"), "bars bench", f"""WITH b AS (SELECT trade_date, 100 * (bench_close / nullif(lag(bench_close, 20) OVER (ORDER BY trade_date), 0) - 1) AS b20, 100 * (bench_close / nullif(lag(bench_close, 60) OVER (ORDER BY trade_date), 0) - 1) AS b60 FROM bench),
a AS (SELECT symbol_id, trade_date, {RETS[20]} AS r20, {RETS[60]} AS r60 FROM bars), x AS (SELECT symbol_id, trade_date, r20 - b20 AS p, r60 - b60 AS q FROM a LEFT JOIN b USING (trade_date))
SELECT symbol_id, trade_date, {r('(coalesce(p, 0) + coalesce(q, 0)) / nullif(CASE WHEN p IS NULL THEN 0 ELSE 1 END + CASE WHEN q IS NULL THEN 0 ELSE 1 END, 0)', 'excess')} FROM x""")
R.add("rk33_history_upsert", lambda s, d: rk.history_upsert(rk.averages(bars(s, d)).select("symbol_id", "trade_date", "sma_20"), rk.averages(bars(s, d)).filter("trade_date >= '2000-01-01'").select("symbol_id", "trade_date", (-F.col("sma_20")).alias("sma_20")), "symbol_id", "trade_date"), "bars", f"SELECT symbol_id, trade_date, {r(f'''CASE WHEN trade_date >= DATE '2000-01-01' THEN -1 ELSE 1 END * avg(close) {frame(20)}''', 'sma_20')} FROM bars")
