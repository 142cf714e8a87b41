"""Queries of the investigation operators (WL13-WL27), sector lists (SR1, SR7, SR9) and confirmations (PT20) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.stats import along, pct_rank
from barloom.operators import investigate as iv
from barloom.operators import market as mk
from barloom.operators import patterns as pt
from barloom.operators import ranking as rk
from barloom.plans.kit import NEEDS, SQL, Registry
from barloom.plans.ranks import LATEST
from barloom.plans.technical import VZ, W, frame, pct, r
from barloom.sources.bars import bars, events, master

R = Registry()

SQL["inv"] = f"""SELECT symbol_id, trade_date, open, high, low, close, volume, delivery_pct, 100 * (close / nullif(lag(close) {W}, 0) - 1) AS daily_return_pct, volume / nullif(avg(volume) {frame(20, 1)}, 0) AS volume_ratio_20,
avg(volume) {frame(5)} / nullif(avg(volume) {frame(20, 1)}, 0) AS volume_ratio_5d, 100 * (avg(volume) {frame(5)} / nullif(avg(volume) {frame(5, 5)}, 0) - 1) AS volume_trend_10d,
100 * (max(high) {frame(10, 1)} - min(low) {frame(10, 1)}) / nullif(close, 0) AS base_tightness_pct, close > max(high) {frame(20, 1)} AS is_breakout FROM bars {LATEST}"""
NEEDS["inv"] = ["bars"]


def points(*rules):
    return "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in rules) + ")"


def shown(s, d):
    return iv.evidence(bars(s, d))


BEST = "coalesce(greatest(volume_ratio_20, volume_ratio_5d), 0)"
VOLUME = f"greatest(0, least(20, {points((f'{BEST} > 2', 6), (f'{BEST} > 5', 4), ('delivery_pct > 50', 6), ('volume_trend_10d > 0', 4), ('delivery_pct < 20', -6))}))"
R.add("wl15_volume", lambda s, d: iv.volume_anatomy(shown(s, d)).select("symbol_id", "volume_delivery_score", "volume_unusual", "low_delivery_flag", "volume_ratio_declining"), "inv", f"SELECT symbol_id, CAST({VOLUME} AS DOUBLE) AS volume_delivery_score, {BEST} > 5 AS volume_unusual, coalesce(delivery_pct < 20, false) AS low_delivery_flag, coalesce(volume_trend_10d < 0, false) AS volume_ratio_declining FROM inv")
SHAPE = "shape AS (SELECT *, 100 * abs(close - open) / nullif(high - low, 0) AS body, 100 * (close - low) / nullif(high - low, 0) AS place, 100 * (high - close) / nullif(high - low, 0) AS wick FROM inv)"
PRICE = points(("body > 70", 4), ("place >= 75", 4), ("is_breakout", 4), ("base_tightness_pct <= 6", 3))
TRAP = "coalesce(wick >= 45 AND place < 50, false)"
R.add("wl17_price_structure", lambda s, d: iv.price_structure(shown(s, d)).select("symbol_id", "body_pct_of_range", "close_position_pct", "price_structure_score", "long_upper_wick_trap", "hard_trap_flag"), "inv", f"WITH {SHAPE} SELECT symbol_id, {r('body', 'body_pct_of_range')}, {r('place', 'close_position_pct')}, CAST({PRICE} AS INTEGER) AS price_structure_score, {TRAP} AS long_upper_wick_trap, {TRAP} OR coalesce(place < 35, false) AS hard_trap_flag FROM shape")


def sectors_now(s, d):
    """Strength, percentile, quadrant and number of gainers of each sector at the last session of it."""
    day = mk.rotation(mk.sector_returns(bars(s, d), master(s, d)))
    last = rk.latest(day, "sector")
    gain = shown(s, d).filter("daily_return_pct > 0").join(master(s, d), "symbol_id").groupBy("sector").agg(F.count("*").alias("peer_gainers"))
    return last.join(gain, "sector", "left").select("sector", F.col("sector_return").alias("sector_rs"), (100 * F.col("sector_pct")).alias("rs_rank_pct"), "quadrant", "peer_gainers")


SQL["sday"] = f"SELECT trade_date, sector, round(avg(x), 9) AS sector_rs FROM (SELECT symbol_id, trade_date, close / nullif(lag(close, 20) {W}, 0) - 1 AS x FROM bars) JOIN master USING (symbol_id) GROUP BY 1, 2"
NEEDS["sday"] = ["bars", "master"]
SQL["snow"] = f"""SELECT sector, sector_rs, 100 * p AS rs_rank_pct, CASE WHEN p >= 0.5 AND coalesce(m, 0) >= 0 THEN 'Leading' WHEN p >= 0.5 THEN 'Weakening' WHEN coalesce(m, 0) < 0 AND p < 0.5 THEN 'Lagging' WHEN p < 0.5 THEN 'Improving' END AS quadrant, peer_gainers
FROM (SELECT *, p - lag(p, 20) OVER (PARTITION BY sector ORDER BY trade_date) AS m FROM (SELECT *, {pct('sector_rs', 'trade_date')} AS p FROM sday) QUALIFY row_number() OVER (PARTITION BY sector ORDER BY trade_date DESC) = 1)
LEFT JOIN (SELECT sector, count(*) AS peer_gainers FROM inv JOIN master USING (symbol_id) WHERE daily_return_pct > 0 GROUP BY 1) USING (sector)"""
NEEDS["snow"] = ["sday", "inv"]
SUPPORT = f"""sup AS (SELECT i.*, m.sector, coalesce(peer_gainers >= 5, false) OR coalesce(lower(quadrant) = 'leading', false) AS sector_rotation,
coalesce(n.sector_rs > 0, false) OR coalesce(rs_rank_pct >= 60, false) OR coalesce(lower(quadrant) IN ('leading', 'improving'), false) AS positive, peer_gainers, i.daily_return_pct - avg(i.daily_return_pct) OVER (PARTITION BY m.sector) AS stock_vs_sector_rs
FROM inv i JOIN master m USING (symbol_id) LEFT JOIN snow n ON upper(n.sector) = upper(m.sector))"""
SECTOR = f"least(10, {points(('positive', 4), ('sector_rotation', 3), ('round(stock_vs_sector_rs, 9) > 0', 3))})"


def supported(s, d):
    own = F.col("daily_return_pct") - F.avg("daily_return_pct").over(Window.partitionBy("sector"))
    rows = shown(s, d).join(master(s, d).select("symbol_id", "sector"), "symbol_id").withColumn("stock_vs_sector_rs", F.round(own, 9))
    return iv.sector_support(rows, sectors_now(s, d))


R.add("wl18_sector_support", lambda s, d: supported(s, d).select("symbol_id", "sector_support_score", "sector_rotation", "sector_clustering"), "inv snow", f"WITH {SUPPORT} SELECT symbol_id, CAST({SECTOR} AS INTEGER) AS sector_support_score, sector_rotation, sector_rotation OR coalesce(peer_gainers >= 3, false) AS sector_clustering FROM sup")


def moved(s, d):
    said = events(s, d).filter("event_id % 3 = 0").groupBy("symbol_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("category"))).alias("event_text"))
    rows = iv.volume_anatomy(supported(s, d)).join(said, "symbol_id", "left")
    reason = F.when(F.col("daily_return_pct") >= 5, "DAILY_GAINER").when(F.col("volume_ratio_5d") > 1.2, "WEEKLY_GAINER").when(F.col("volume_ratio_20") > 1, "STEALTH_ACCUMULATION")
    return iv.classify_move(rows.withColumn("trigger_reason", reason))


SAID = "said AS (SELECT symbol_id, string_agg(category, ' ' ORDER BY category) AS event_text FROM (SELECT DISTINCT symbol_id, category FROM ev WHERE event_id % 3 = 0) GROUP BY 1)"
MOVED = f"""{SUPPORT}, {SAID}, mv AS (SELECT sup.*, lower(coalesce(event_text, '')) AS t, CASE WHEN daily_return_pct >= 5 THEN 'DAILY_GAINER' WHEN volume_ratio_5d > 1.2 THEN 'WEEKLY_GAINER' WHEN volume_ratio_20 > 1 THEN 'STEALTH_ACCUMULATION' END AS reason FROM sup LEFT JOIN said USING (symbol_id)),
tagged AS (SELECT *, CASE WHEN regexp_matches(t, 'bulk|block|insider|promoter') THEN 'SMART_MONEY_EVENT' WHEN sector_rotation THEN 'SECTOR_ROTATION' WHEN regexp_matches(t, 'order|contract|tender') THEN 'ORDER_WIN' WHEN regexp_matches(t, 'earn|result|profit|revenue') THEN 'EARNINGS_RERATING'
WHEN reason = 'STEALTH_ACCUMULATION' THEN 'STEALTH_ACCUMULATION' WHEN reason = 'WEEKLY_GAINER' THEN 'WEEKLY_MOMENTUM' WHEN coalesce(delivery_pct < 20, false) THEN 'OPERATOR_SPIKE' ELSE 'RANDOM_NOISE' END AS move_tag FROM mv),
trig AS (SELECT *, CASE move_tag {" ".join(f"WHEN '{k}' THEN {v}" for k, v in iv.POINTS.items())} END AS trigger_points, move_tag NOT IN ('RANDOM_NOISE', 'OPERATOR_SPIKE') OR t <> '' AS credible_trigger FROM tagged)"""
R.add("wl16_move", lambda s, d: moved(s, d).select("symbol_id", "move_tag", "trigger_quality_score", "credible_trigger"), "inv snow ev", f"WITH {MOVED} SELECT symbol_id, move_tag, CAST(trigger_points AS DOUBLE) AS trigger_quality_score, credible_trigger FROM trig")


def bought(s, d):
    rows = moved(s, d).withColumns({"bulk_buyer": F.col("symbol_id") % 7 == 0, "oi_rising": F.col("symbol_id") % 3 == 0})
    return iv.buyer_fingerprint(rows)


BUYER = f"greatest(0, least(15, {points(('delivery_pct > 50 AND daily_return_pct > 0', 7), ('''symbol_id % 7 = 0 OR move_tag = 'SMART_MONEY_EVENT' ''', 4), ('symbol_id % 3 = 0 AND daily_return_pct > 0', 4), ('delivery_pct < 20 AND daily_return_pct > 0', -5))}))"
R.add("wl19_buyers", lambda s, d: bought(s, d).select("symbol_id", "buyer_fingerprint_score"), "inv snow ev", f"WITH {MOVED} SELECT symbol_id, CAST({BUYER} AS DOUBLE) AS buyer_fingerprint_score FROM trig")


def judged(s, d):
    strength = rk.relative_strength(rk.latest(rk.returns(bars(s, d), 20, 60, 120)).withColumn("trade_date", F.lit("2001-12-31").cast("date"))).select("symbol_id", F.round("rel_strength", 6).alias("composite"))
    return iv.verdict(iv.price_structure(bought(s, d)).join(strength, "symbol_id", "left"))


STRENGTH = f"str AS (SELECT symbol_id, round(0.2 * 100 * coalesce({pct('r20')}, 0.5) + 0.5 * 100 * coalesce({pct('r60')}, 0.5) + 0.3 * 100 * coalesce({pct('r120')}, 0.5), 6) AS composite FROM (SELECT symbol_id, {', '.join(f'100 * (close / nullif(lag(close, {n}) {W}, 0) - 1) AS r{n}' for n in (20, 60, 120))} FROM bars {LATEST}))"
FINAL = f"""{MOVED}, {STRENGTH}, ps AS (SELECT *, 100 * abs(close - open) / nullif(high - low, 0) AS body, 100 * (close - low) / nullif(high - low, 0) AS place, 100 * (high - close) / nullif(high - low, 0) AS wick FROM trig LEFT JOIN str USING (symbol_id)),
fs AS (SELECT *, {TRAP} OR coalesce(place < 35, false) AS hard_trap_flag, CAST(greatest(0, least(100, {PRICE} + {VOLUME} + trigger_points + {SECTOR} + {BUYER} + CASE WHEN composite >= 75 THEN 15 WHEN composite >= 60 THEN 8 WHEN composite >= 45 THEN 3 WHEN composite < 35 THEN -10 ELSE 0 END)) AS DOUBLE) AS final_score FROM ps),
pl AS (SELECT *, CASE WHEN final_score >= 80 THEN 'HIGH_CONVICTION' WHEN final_score >= 55 THEN 'MEDIUM_CONVICTION' WHEN final_score >= 35 THEN 'WATCH_ONLY' ELSE 'NOISE_TRAP' END AS plain FROM fs),
vd AS (SELECT *, CASE WHEN hard_trap_flag THEN 'NOISE_TRAP' WHEN composite < 35 AND NOT credible_trigger THEN 'NOISE_TRAP' WHEN composite < 45 AND plain <> 'NOISE_TRAP' THEN 'WATCH_ONLY' ELSE plain END AS verdict FROM pl)"""
R.add("wl21_verdict", lambda s, d: judged(s, d).select("symbol_id", "final_score", "verdict"), "inv snow ev", f"WITH {FINAL} SELECT symbol_id, final_score, verdict FROM vd")
R.add("wl27_traps", lambda s, d: iv.trap_category(judged(s, d).filter("verdict = 'NOISE_TRAP'").withColumns({"reason": F.concat_ws(" ", "move_tag", "verdict"), "price_progression_pct": F.col("daily_return_pct"), "rank_change_20d": F.col("symbol_id") % 40})).select("symbol_id", "trap_category"), "inv snow ev", f"""WITH {FINAL} SELECT symbol_id, CASE WHEN coalesce(delivery_pct < 20, false) THEN 'Low delivery / liquidity' WHEN coalesce(volume_trend_10d < 0, false) THEN 'Volume not sustaining' WHEN symbol_id % 40 > 25 THEN 'Rank collapse' WHEN coalesce(daily_return_pct < 0, false) THEN 'Price fade' WHEN move_tag = 'OPERATOR_SPIKE' THEN 'One-day spike' ELSE 'Trap evidence' END AS trap_category FROM vd WHERE verdict = 'NOISE_TRAP'""")

CROSS = f"""WITH a AS (SELECT symbol_id, trade_date, {", ".join(f"avg(close) {frame(n)} AS s{n}" for n in (20, 50, 150, 200))}, row_number() {W} AS k FROM bars),
b AS (SELECT *, 100 * (s50 / nullif(s200, 0) - 1) AS gap, s50 > s200 AS up FROM a), c AS (SELECT *, CASE WHEN up AND NOT lag(up) {W} THEN k END AS crossed, gap - lag(gap, 20) {W} AS delta, 100 * (s50 / nullif(lag(s50, 20) {W}, 0) - 1) AS f, 100 * (s200 / nullif(lag(s200, 20) {W}, 0) - 1) AS g FROM b),
e AS (SELECT *, k - last_value(crossed IGNORE NULLS) {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM c {LATEST}),
x AS (SELECT *, coalesce(NOT up AND since <= 20, false) AS failed, coalesce(s50 > 0 AND s200 > 0, false) AS known FROM e)
SELECT symbol_id, {r('gap', 'gap_pct')}, CASE WHEN NOT known THEN 'UNKNOWN' WHEN failed THEN 'FAILED_CROSS' WHEN up AND delta < -0.5 AND f < g THEN 'DEATH_CROSS_RISK' WHEN up AND since <= 20 THEN 'CROSSED_RECENTLY' WHEN up THEN 'CROSSED_ESTABLISHED' WHEN gap >= -3 AND gap < 0 AND delta > 0 AND f > g THEN 'IMMINENT' WHEN gap >= -10 AND gap < -3 AND delta > 0 THEN 'APPROACHING' ELSE 'FAR_BELOW' END AS cross_status,
{r("CASE WHEN failed THEN 0.0 ELSE 0.45 * CASE WHEN delta IS NOT NULL THEN greatest(0.0, least(100.0, (delta + 2) / 5 * 100)) END + CASE WHEN up THEN 35.0 ELSE 0.0 END + CASE WHEN s20 > s50 THEN 20.0 ELSE 0.0 END END", "cross_quality")},
CASE WHEN NOT known THEN 'INSUFFICIENT_HISTORY' WHEN gap > 50 THEN 'EXTREME_POSITIVE_GAP' WHEN gap < -30 THEN 'EXTREME_NEGATIVE_GAP' ELSE 'NORMAL' END AS gap_flag, CASE WHEN up AND s150 > s200 THEN 'CONFIRMED' WHEN s150 > s200 THEN 'CONSTRUCTIVE' ELSE 'UNCONFIRMED' END AS alignment FROM x"""
R.add("wl13_golden_cross", lambda s, d: iv.golden_cross(iv.cross_inputs(bars(s, d))).select("symbol_id", "gap_pct", "cross_status", "cross_quality", "gap_flag", "alignment"), "bars", CROSS)

R.add("sr1_liquid_universe", lambda s, d: iv.liquid_universe(bars(s, d), 800, 20), "bars", f"""SELECT symbol_id, {r('quantile_cont(close * volume, 0.5)', 'median_turnover')}, {r('avg(close * volume)', 'avg_turnover')}, count(*) AS recent_days FROM bars WHERE trade_date >= (SELECT max(trade_date) FROM bars) - INTERVAL 365 DAY AND close IS NOT NULL AND volume > 0
GROUP BY symbol_id HAVING count(*) >= 20 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 800""")


def sector_days(s, d):
    return mk.sector_returns(bars(s, d), master(s, d)).select("sector", "trade_date", F.col("sector_return").alias("sector_rs"))


def numbered_days(s, d):
    """All sessions with their numbers: one row a session."""
    days = bars(s, d).select("trade_date").distinct()
    return days.withColumn("day_no", F.row_number().over(Window.orderBy("trade_date")))


R.add("sr7_momentum", lambda s, d: iv.momentum_over(sector_days(s, d), numbered_days(s, d), 20).select("sector", "trade_date", "momentum"), "sday", f"""WITH n AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day_no FROM (SELECT DISTINCT trade_date FROM bars))
SELECT sector, trade_date, {r('sector_rs - last_value(sector_rs IGNORE NULLS) OVER (PARTITION BY sector ORDER BY day_no RANGE BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING)', 'momentum')} FROM sday JOIN n USING (trade_date)""")


def stock_strength(s, d):
    rows = rk.returns(bars(s, d), 20).withColumn("rs", pct_rank(F.round("ret_20", 6), "trade_date"))
    rows = rows.withColumns({"rs_20": F.lag("rs", 20).over(along()), "rs_50": F.lag("rs", 50).over(along())}).withColumn("momentum", F.col("rs") - F.col("rs_20"))
    return rk.latest(rows).join(master(s, d).select("symbol_id", "sector"), "symbol_id")


def scanned(s, d):
    days = sector_days(s, d).withColumn("momentum", F.col("sector_rs") - F.lag("sector_rs", 5).over(along("sector")))
    return iv.scan(stock_strength(s, d), rk.latest(days, "sector"))


R.add("sr9_scan", lambda s, d: scanned(s, d).select("symbol_id", "sector", "rs", "rs_vs_sector", "acceleration", "category", "score"), "sday", f"""WITH a AS (SELECT symbol_id, trade_date, round(100 * (close / nullif(lag(close, 20) {W}, 0) - 1), 6) AS x FROM bars), b AS (SELECT symbol_id, trade_date, {pct('x', 'trade_date')} AS rs FROM a),
c AS (SELECT symbol_id, trade_date, rs, lag(rs, 20) {W} AS rs_20, lag(rs, 50) {W} AS rs_50 FROM b {LATEST}), q AS (SELECT sector, sector_rs, round(sector_rs - lag(sector_rs, 5) OVER (PARTITION BY sector ORDER BY trade_date), 9) AS m FROM sday QUALIFY row_number() OVER (PARTITION BY sector ORDER BY trade_date DESC) = 1),
p AS (SELECT *, rank() OVER (ORDER BY sector_rs DESC NULLS LAST) AS k FROM q), s AS (SELECT c.*, sector, round(rs - avg(rs) OVER (PARTITION BY sector), 9) AS v, round(rs_20 - rs_50, 9) AS acc FROM c JOIN master USING (symbol_id)), t AS (SELECT * FROM s WHERE rs IS NOT NULL AND sector IN (SELECT sector FROM p WHERE k <= 3 OR m < 0))
SELECT symbol_id, sector, {r('rs', 'rs')}, {r('v', 'rs_vs_sector')}, {r('acc', 'acceleration')}, CASE WHEN rs > 0.9 AND v > 0.2 AND round(rs - rs_20, 9) > 0 THEN 'BUY' WHEN acc > 0.2 AND v > 0 THEN 'EARLY' WHEN rs > 0.7 THEN 'WATCH' ELSE 'REJECT' END AS category, {r('0.5 * rs + 0.3 * rs_20 + 0.2 * (v + 0.5)', 'score')} FROM t""")


def peaks(s, d):
    return pt.turning_points(bars(s, d)).filter("kind = 'peak'").select("symbol_id", "trade_date", F.col("close").alias("resistance"))


R.add("pt20_confirmations", lambda s, d: iv.confirmations(bars(s, d), peaks(s, d)), "bars", f"""WITH a AS (SELECT symbol_id, trade_date, close, row_number() {W} AS n, volume / nullif(avg(volume) {frame(20, 1)}, 0) AS v, {VZ}, lag(close) {W} AS b, lead(close) {W} AS f FROM bars),
l AS (SELECT symbol_id, trade_date AS pattern_end, n, close AS resistance FROM a WHERE close > b AND close > f), m AS (SELECT l.symbol_id, pattern_end, resistance, a.trade_date, a.close, a.n FROM l JOIN a ON a.symbol_id = l.symbol_id AND a.n > l.n AND a.n <= l.n + 15 WHERE a.close > resistance AND (v >= 1.5 AND (vol_z20 >= 2 OR vol_z50 >= 2)))
SELECT symbol_id, pattern_end, {r('resistance', 'resistance')}, min(trade_date) AS confirmed_on, {r('arg_min(close, n)', 'confirmed_close')} FROM m GROUP BY symbol_id, pattern_end, resistance""")
