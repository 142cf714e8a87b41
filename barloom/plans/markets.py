"""Queries of weekly stages (WK), breakouts (BO), breadth (BR) and sectors (SR) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import market as mk
from barloom.operators import ranking as rk
from barloom.plans.kit import NEEDS, SQL, Registry
from barloom.plans.ranks import LATEST
from barloom.plans.technical import W, frame, pct, r
from barloom.sources.bars import bars, benchmark, master, table

R = Registry()
KEY = ["symbol_id", "trade_date"]
WW = "OVER (PARTITION BY symbol_id ORDER BY week_end)"
DD = "OVER (ORDER BY trade_date)"


def wf(n):
    return f"OVER (PARTITION BY symbol_id ORDER BY week_end ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SQL |= {
    "wk0": "SELECT symbol_id, CAST(trade_date + CAST((12 - isodow(trade_date)) % 7 AS INTEGER) AS DATE) AS week_end, arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2",
    "wk1": f"SELECT *, {', '.join(f'CASE WHEN count(close) {wf(n)} >= {n} THEN avg(close) {wf(n)} END AS ma{n}w' for n in (10, 30, 40))}, CASE WHEN count(volume) {wf(20)} >= 20 THEN avg(volume) {wf(20)} END AS v20, greatest(high, lag(close) {WW}) - least(low, lag(close) {WW}) AS tr FROM wk0",
    "wk": f"SELECT *, ma30w / nullif(lag(ma30w, 4) {WW}, 0) - 1 AS ma30w_slope_4w, CASE WHEN count(close) {wf(52)} >= 10 THEN max(close) {wf(52)} END AS high_52w, CASE WHEN count(close) {wf(52)} >= 10 THEN min(close) {wf(52)} END AS low_52w, CASE WHEN count(tr) {wf(10)} >= 10 THEN avg(tr) {wf(10)} END AS atr10, CASE WHEN count(tr) {wf(30)} >= 30 THEN avg(tr) {wf(30)} END AS atr30, volume / nullif(v20, 0) AS volume_ratio, row_number() {WW} AS weeks FROM wk1",
}
FROM_HIGH, FROM_LOW = "coalesce(100 * (high_52w - close) / nullif(high_52w, 0), 100)", "coalesce(100 * (close - low_52w) / nullif(low_52w, 0), 100)"
TWO = lambda least: ["close > ma30w", f"ma30w_slope_4w > {least}", "ma10w > ma30w", "close > ma40w", f"{FROM_HIGH} <= 15"]
CHK = {
    "S2": TWO(0.005),
    "S2on": TWO(0.002),
    "S4": ["close < ma30w", "ma30w_slope_4w < -0.005", "ma10w < ma30w", "close < ma40w", f"{FROM_LOW} <= 20"],
    "S3": [f"{FROM_HIGH} <= 20", "abs(ma30w_slope_4w) <= 0.005", "atr10 > 1.1 * atr30", "NOT coalesce(ma10w > 1.03 * ma30w AND ma30w_slope_4w > 0.005, false)"],
    "S1": ["abs(close / nullif(ma30w, 0) - 1) < 0.05", "abs(ma30w_slope_4w) < 0.005", f"{FROM_LOW} <= 30", "volume_ratio < 1", "abs(ma10w / nullif(ma30w, 0) - 1) < 0.03"],
}
SC = {k: "(" + " + ".join(f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END" for c in v) + f") / {len(v)}" for k, v in CHK.items()}
SQL["stg0"] = f"SELECT *, {', '.join(f'CAST({v} AS DOUBLE) AS x{k}' for k, v in SC.items())} FROM wk"


def named(two: str) -> str:
    top = f"greatest({two}, xS4, xS3, xS1)"
    return f"CASE WHEN weeks < 30 OR {top} < 0.4 THEN 'UNDEFINED' WHEN {two} = {top} THEN 'S2' WHEN xS4 = {top} THEN 'S4' WHEN xS3 = {top} THEN 'S3' ELSE 'S1' END"


# the weeks of a symbol in turn, each knowing whether the one before was stage 2
TURN = "lambda a, w: {'fresh': w.fresh, 'goes': w.goes, 'out': list_append(a.out, CASE WHEN len(a.out) > 0 AND a.out[-1] = 'S2' THEN w.goes ELSE w.fresh END)}"
SQL["stg1"] = f"SELECT *, {named('xS2')} AS fresh, {named('xS2on')} AS goes FROM stg0"
SQL["stg2"] = f"SELECT symbol_id, list_reduce(list({{'fresh': fresh, 'goes': goes, 'out': CAST([] AS VARCHAR[])}} ORDER BY week_end), {TURN}, {{'fresh': '', 'goes': '', 'out': CAST([] AS VARCHAR[])}}).out AS labels FROM stg1 GROUP BY 1"
SQL["stg"] = f"SELECT a.symbol_id, week_end, labels[weeks] AS stage, CASE WHEN weeks < 30 THEN 0.0 ELSE round(greatest(CASE WHEN weeks > 1 AND labels[weeks - 1] = 'S2' THEN xS2on ELSE xS2 END, xS4, xS3, xS1), 3) END AS confidence FROM stg1 a JOIN stg2 b ON b.symbol_id = a.symbol_id"
SQL["age0"] = f"SELECT *, lag(stage) {WW} AS prev, CASE WHEN lag(stage) {WW} IS NOT DISTINCT FROM stage THEN 0 ELSE 1 END AS ch FROM stg"
SQL["age1"] = f"SELECT *, sum(ch) {WW} AS run FROM age0"
SQL["age"] = "SELECT symbol_id, week_end, stage, confidence, row_number() OVER (PARTITION BY symbol_id, run ORDER BY week_end) AS bars_in_stage, first(week_end) OVER (PARTITION BY symbol_id, run ORDER BY week_end) AS entry_date, concat_ws('->', first(prev) OVER (PARTITION BY symbol_id, run ORDER BY week_end), stage) AS transition FROM age1"
NEEDS |= {"wk0": ["bars"], "wk1": ["wk0"], "wk": ["wk1"], "stg0": ["wk"], "stg1": ["stg0"], "stg2": ["stg1"], "stg": ["stg1", "stg2"], "age0": ["stg"], "age1": ["age0"], "age": ["age1"]}
LASTW = "QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY week_end DESC) = 1"
stage_rows = lambda s, d: mk.stage_age(mk.classify(mk.weekly(bars(s, d))))
last_stage = lambda s, d: rk.latest(stage_rows(s, d), order="week_end")
WCOLS = ["open", "high", "low", "close", "volume", "ma10w", "ma30w", "ma40w", "ma30w_slope_4w", "high_52w", "low_52w", "atr10", "atr30", "volume_ratio"]
R.add("wk1_weekly", lambda s, d: mk.weekly(bars(s, d)).select("symbol_id", "week_end", *WCOLS), "wk", f"SELECT symbol_id, week_end, {', '.join(r(c, c) for c in WCOLS)} FROM wk")
R.add("wk2_classify", lambda s, d: mk.classify(mk.weekly(bars(s, d))).select("symbol_id", "week_end", "stage", "confidence"), "stg", f"SELECT symbol_id, week_end, stage, {r('confidence', 'confidence')} FROM stg")
R.add("wk3_stage_age", lambda s, d: stage_rows(s, d).select("symbol_id", "week_end", "stage", "bars_in_stage", "entry_date", "transition"), "age", "SELECT symbol_id, week_end, stage, CAST(bars_in_stage AS INTEGER) AS bars_in_stage, entry_date, transition FROM age")
R.add("wk4_support", lambda s, d: mk.support_resistance(mk.weekly(bars(s, d))).select("symbol_id", "week_end", "support_level", "resistance_level"), "wk", "SELECT symbol_id, week_end, round(min(low) OVER w, 6) AS support_level, round(max(high) OVER w, 6) AS resistance_level FROM wk WINDOW w AS (PARTITION BY symbol_id ORDER BY week_end ROWS BETWEEN 11 PRECEDING AND 2 PRECEDING)")
SH = ", ".join(f"avg(CASE WHEN stage = '{k}' THEN 1.0 ELSE 0 END) AS {k.lower()}_share" for k in ("S1", "S2", "S3", "S4"))
MS = "CASE WHEN s4_share >= 0.4 THEN 'S4' WHEN s2_share >= 0.4 THEN 'S2' WHEN s3_share >= 0.3 THEN 'S3' ELSE 'MIXED' END AS market_stage"
MSQL = f"WITH l AS (SELECT * FROM age {LASTW}), x AS (SELECT {SH} FROM l)"
RS4 = ", ".join(r(f"{k}_share", f"{k}_share") for k in ("s1", "s2", "s3", "s4"))
R.add("wk5_market_stage", lambda s, d: mk.market_stage(last_stage(s, d)), "age", f"{MSQL} SELECT {RS4}, {MS} FROM x")
R.add("wk6_sector_health", lambda s, d: mk.sector_health(last_stage(s, d).join(master(s, d), "symbol_id")), "age master", f"WITH l AS (SELECT * FROM age JOIN master USING (symbol_id) {LASTW}), x AS (SELECT sector, count(*) AS n, count(*) FILTER (WHERE stage = 'S2') AS s2, count(*) FILTER (WHERE stage = 'S4') AS s4, count(*) FILTER (WHERE transition = 'S1->S2') AS turned FROM l GROUP BY sector) SELECT *, CASE WHEN s2 >= 0.5 * n THEN 'healthy' WHEN s4 >= 0.5 * n THEN 'weak' WHEN turned > 0 THEN 'turning' ELSE 'mixed' END AS verdict FROM x")
R.add("wk10_route", lambda s, d: mk.route(mk.market_stage(last_stage(s, d))).select("market_stage", "exposure", "positions"), "age", f"{MSQL}, y AS (SELECT {MS} FROM x) SELECT market_stage, exposure, positions FROM y LEFT JOIN (VALUES ('S1', 0.3::DOUBLE, 5), ('S2', 1.0, 10), ('S3', 0.5, 5), ('S4', 0.0, 0), ('MIXED', 0.4, 5)) AS t(market_stage, exposure, positions) USING (market_stage)")
R.add("wk12_replay", lambda s, d: mk.classify(mk.weekly(bars(s, d))).groupBy("week_end", "stage").agg(F.count("*").alias("n")), "stg", "SELECT week_end, stage, count(*) AS n FROM stg GROUP BY ALL")
R.add("wk13_observation_age", lambda s, d: mk.observation_age(mk.classify(mk.weekly(bars(s, d))).filter("week_end <= '2001-06-01'"), bars(s, d)), "stg", f"WITH c AS (SELECT trade_date, row_number() {DD} AS n FROM (SELECT DISTINCT trade_date FROM bars)), l AS (SELECT symbol_id, stage, week_end FROM stg WHERE week_end <= DATE '2001-06-01' {LASTW}) SELECT symbol_id, stage, week_end, CAST((SELECT max(n) FROM c) - max(n) AS INTEGER) AS age FROM l JOIN c ON trade_date <= week_end GROUP BY symbol_id, stage, week_end")

P = lambda n: frame(n, 1)
SQL["bo0"] = f"SELECT *, greatest(high, lag(close) {W}) - least(low, lag(close) {W}) AS tr, (high - low) / nullif(close, 0) AS rg FROM bars"
BRK = lambda n: f"coalesce(CASE WHEN count(*) {P(n)} >= {n} THEN close > max(high) {P(n)} END, false)"
SQL["bo1"] = f"""SELECT symbol_id, trade_date, close, high, low, volume, delivery_pct, {BRK(20)} AS range_breakout, {BRK(60)} AS base_breakout, {BRK(252)} AS high_52w_breakout, avg(rg) {P(5)} / nullif(avg(rg) {P(20)}, 0) AS contraction, volume / nullif(avg(volume) {P(20)}, 0) AS volume_ratio,
CASE WHEN count(*) {P(20)} >= 20 THEN (volume - avg(volume) {P(20)}) / nullif(stddev_pop(volume) {P(20)}, 0) END AS vol_z20, avg(tr) {P(14)} AS atr, avg(delivery_pct) {P(20)} AS d20 FROM bo0"""
SQL["bo"] = """SELECT *, CASE WHEN range_breakout THEN 35.0 ELSE 0 END + CASE WHEN volume_ratio >= 1.5 THEN 25.0 ELSE 0 END + CASE WHEN delivery_pct > d20 THEN 20.0 ELSE 0 END + CASE WHEN high - low >= 1.5 * atr THEN 10.0 ELSE 0 END + CASE WHEN close >= low + 0.75 * (high - low) THEN 10.0 ELSE 0 END AS conviction,
CASE WHEN high_52w_breakout THEN 'high_52w' WHEN base_breakout THEN 'base' WHEN range_breakout THEN 'range' END AS setup_family FROM bo1"""
NEEDS |= {"bo0": ["bars"], "bo1": ["bo0"], "bo": ["bo1"]}
bo = lambda s, d: mk.breakouts(bars(s, d))
R.add("bo1_breakouts", lambda s, d: bo(s, d).select(*KEY, "range_breakout", "base_breakout", "high_52w_breakout", "contraction", "volume_ratio", "vol_z20", "conviction", "setup_family"), "bo", f"SELECT symbol_id, trade_date, range_breakout, base_breakout, high_52w_breakout, {r('contraction', 'contraction')}, {r('volume_ratio', 'volume_ratio')}, {r('vol_z20', 'vol_z20')}, CAST(conviction AS DOUBLE) AS conviction, setup_family FROM bo")
R.add("bo2_tiers", lambda s, d: mk.tiers(bo(s, d)).select(*KEY, "tier", "why"), "bo", "SELECT symbol_id, trade_date, CASE WHEN conviction >= 80 AND contraction <= 1 THEN 'A' WHEN conviction >= 70 THEN 'B' WHEN conviction >= 55 THEN 'C' ELSE 'D' END AS tier, concat_ws(',', CASE WHEN coalesce(volume_ratio, 0) < 1.5 THEN 'volume' END, CASE WHEN coalesce(contraction, 9) > 1 THEN 'no_contraction' END, CASE WHEN conviction < 60 THEN 'conviction' END) AS why FROM bo WHERE setup_family IS NOT NULL")
R.add("bo3_confirmations", lambda s, d: mk.volume_confirmations(bo(s, d)).select(*KEY, "ratio_ok", "z20_ok"), "bo", "SELECT symbol_id, trade_date, coalesce(volume_ratio >= 1.5, false) AS ratio_ok, coalesce(vol_z20 >= 2, false) AS z20_ok FROM bo")
R.add("bo4_volume_shocks", lambda s, d: mk.volume_shocks(bo(s, d), master(s, d).filter("market_cap > 1000")).select(*KEY, "intensity"), "bo master", "SELECT symbol_id, trade_date, CASE WHEN vol_z20 >= 6 THEN 'extreme' ELSE 'high' END AS intensity FROM bo WHERE vol_z20 >= 3 AND close * volume >= 1e5 AND symbol_id IN (SELECT symbol_id FROM master WHERE market_cap > 1000)")
R.add("bo5_failed", lambda s, d: mk.failed_breakouts(bo(s, d), rk.latest(bars(s, d))), "bo", f"WITH f AS (SELECT symbol_id, min(trade_date) AS first_day, arg_min(close, trade_date) AS t FROM bo WHERE setup_family IS NOT NULL GROUP BY 1), l AS (SELECT symbol_id, close AS c FROM bars {LATEST}) SELECT symbol_id, first_day, {r('t', 'trigger')}, {r('c', 'last_close')} FROM f JOIN l USING (symbol_id) WHERE c < t")
R.add("bo8_daily_gainers", lambda s, d: mk.daily_gainers(bars(s, d), 5.0), "bars", f"WITH x AS (SELECT symbol_id, trade_date, close, 100 * (close / nullif(lag(close) {W}, 0) - 1) AS g FROM bars {LATEST}) SELECT symbol_id, trade_date, {r('close', 'close')}, {r('g', 'gain')} FROM x WHERE g > 5")
R.add("bo9_top_gainers", lambda s, d: mk.top_gainers(bars(s, d), 5, 10), "bars", f"WITH x AS (SELECT symbol_id, {r(f'100 * (close / nullif(lag(close, 5) {W}, 0) - 1)', 'gain')} FROM bars {LATEST}) SELECT * FROM x WHERE gain IS NOT NULL ORDER BY gain DESC, symbol_id LIMIT 10")
R.add("bo10_unusual_activity", lambda s, d: mk.unusual_activity(bo(s, d), 50), "bo", f"WITH x AS (SELECT *, {r(f'100 * (close / nullif(lag(close, 5) {W}, 0) - 1)', 'gain')} FROM bo) SELECT symbol_id, trade_date, gain FROM x WHERE gain >= 5 AND delivery_pct >= 40 AND (vol_z20 >= 1 OR volume_ratio >= 1.25) ORDER BY gain DESC, symbol_id, trade_date LIMIT 50")
FW = lambda n: f"lead(close, {n}) {W} / nullif(close, 0) - 1"
R.add("bo11_history", lambda s, d: mk.forward(bo(s, d), 5, 20).filter("setup_family is not null").select(*KEY, "setup_family", "fwd_5", "fwd_20"), "bo", f"WITH x AS (SELECT symbol_id, trade_date, setup_family, {r(FW(5), 'fwd_5')}, {r(FW(20), 'fwd_20')} FROM bo) SELECT * FROM x WHERE setup_family IS NOT NULL")
R.add("bo12_statistics", lambda s, d: mk.setup_statistics(mk.forward(bo(s, d), 5, 20)), "bo", f"WITH x AS (SELECT *, {FW(5)} AS a, {FW(20)} AS b FROM bo) SELECT setup_family, CAST(date_trunc('month', trade_date) AS DATE) AS month, count(*) AS signals, {r('avg(CASE WHEN a > 0 THEN 1.0 WHEN a IS NOT NULL THEN 0 END)', 'hit_rate')}, {r('avg(a)', 'mean_5')}, {r('quantile_cont(b, 0.5)', 'median_20')} FROM x WHERE setup_family IS NOT NULL GROUP BY 1, 2")
R.add("bo13_high_volume_breaks", lambda s, d: mk.high_volume_breaks(bars(s, d)), "bars", f"WITH x AS (SELECT *, max(high) {P(20)} AS h, avg(volume) {P(20)} AS v, count(*) {P(20)} AS n FROM bars) SELECT symbol_id, trade_date, {r('close', 'close')} FROM x WHERE n >= 20 AND close > h AND volume > 1.5 * v")
R.add("bo16_crosses", lambda s, d: mk.cross_events(bars(s, d)), "bars", f"WITH x AS (SELECT symbol_id, trade_date, close, CASE WHEN row_number() {W} >= 50 THEN avg(close) {frame(20)} > avg(close) {frame(50)} END AS a FROM bars), y AS (SELECT *, lag(a) {W} AS b FROM x) SELECT symbol_id, trade_date, {r('close', 'close')}, CASE WHEN a THEN 'up' ELSE 'down' END AS direction FROM y WHERE a <> b")
R.add("bo17_average_touches", lambda s, d: mk.average_touches(bars(s, d)), "bars", f"WITH x AS (SELECT *, CASE WHEN count(*) {frame(50)} >= 50 THEN avg(close) {frame(50)} END AS m, avg(volume) {frame(20)} AS v FROM bars), y AS (SELECT *, lag(m, 5) {W} AS p FROM x) SELECT symbol_id, trade_date, {r('close', 'close')} FROM y WHERE abs(close / nullif(m, 0) - 1) <= 0.02 AND m > p AND volume > v")

AV = lambda c: f"avg(CASE WHEN {c} THEN 1.0 WHEN ({c}) IS NOT NULL THEN 0 END)"
SQL["br0"] = f"SELECT *, CASE WHEN count(*) {frame(50)} >= 50 THEN avg(close) {frame(50)} END AS s50, CASE WHEN count(*) {frame(200)} >= 200 THEN avg(close) {frame(200)} END AS s200, max(high) {frame(252)} AS hi, min(low) {frame(252)} AS lo, lag(close) {W} AS p FROM bars"
SQL["br"] = f"SELECT trade_date, count(*) AS n, {AV('close > s50')} AS pct50, {AV('close > s200')} AS pct200, {AV('close >= 0.95 * hi')} AS pct_high, count(*) FILTER (WHERE high >= hi) AS new_highs, count(*) FILTER (WHERE low <= lo) AS new_lows, count(*) FILTER (WHERE close > p) AS advances, count(*) FILTER (WHERE close < p) AS declines FROM br0 GROUP BY trade_date"
SQL["brs"] = "SELECT *, 100 * (0.5 * coalesce(pct200, 0) + 0.3 * coalesce(pct_high, 0) + 0.2 * coalesce(pct50, 0)) AS score, CASE WHEN coalesce(pct200, 0) < 0.3 AND coalesce(pct_high, 0) < 0.05 THEN 'risk_off' WHEN coalesce(pct200, 0) < 0.55 THEN 'neutral' WHEN coalesce(pct200, 0) >= 0.75 AND coalesce(pct50, 0) >= 0.6 AND coalesce(pct_high, 0) >= 0.15 THEN 'strong_bull' WHEN coalesce(pct50, 0) >= 0.55 AND coalesce(pct_high, 0) >= 0.12 THEN 'bull' ELSE 'cautious_bull' END AS label FROM br"
NEEDS |= {"br0": ["bars"], "br": ["br0"], "brs": ["br"]}
br = lambda s, d: mk.regime(mk.breadth_score(mk.breadth(bars(s, d))))
R.add("br1_breadth", lambda s, d: mk.breadth(bars(s, d)), "br", f"SELECT trade_date, n, {r('pct50', 'pct50')}, {r('pct200', 'pct200')}, {r('pct_high', 'pct_high')}, new_highs, new_lows, advances, declines FROM br")
R.add("br2_hysteresis", lambda s, d: mk.regime_with_hysteresis(br(s, d)))
R.add("br3_score", lambda s, d: br(s, d).select("trade_date", "score", "label"), "brs", f"SELECT trade_date, {r('score', 'score')}, label FROM brs")
RANKL = "CASE label WHEN 'strong_bull' THEN 4 WHEN 'bull' THEN 3 WHEN 'cautious_bull' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END"
CONF = lambda k: f"sum(CASE WHEN r >= {k} THEN 1 ELSE 0 END) OVER w >= 2"
R.add("br5_confirmed", lambda s, d: mk.confirmed(br(s, d)).select("trade_date", "confirmed"), "brs", f"WITH x AS (SELECT trade_date, label, {RANKL} AS r FROM brs) SELECT trade_date, CASE WHEN {CONF(4)} THEN 'strong_bull' WHEN {CONF(3)} THEN 'bull' WHEN {CONF(2)} THEN 'cautious_bull' WHEN sum(CASE WHEN label = 'risk_off' THEN 1 ELSE 0 END) OVER w >= 2 THEN 'risk_off' ELSE 'neutral' END AS confirmed FROM x WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
R.add("br6_age", lambda s, d: mk.regime_age(br(s, d)).select("trade_date", "label", "days_in_label"), "brs", f"WITH x AS (SELECT trade_date, label, CASE WHEN lag(label) {DD} IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS c FROM brs), y AS (SELECT *, sum(c) {DD} AS g FROM x) SELECT trade_date, label, CAST(row_number() OVER (PARTITION BY g ORDER BY trade_date) AS INTEGER) AS days_in_label FROM y")
VEL = f"WITH x AS (SELECT trade_date, label, score - lag(score, 5) {DD} AS v FROM brs), y AS (SELECT *, {', '.join(f'quantile_cont(v, {q / 5}) OVER w AS q{q}' for q in (1, 2, 3, 4))} FROM x WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), z AS (SELECT *, CASE WHEN v IS NOT NULL THEN 1 + {' + '.join(f'CASE WHEN round(v, 6) > round(q{q}, 6) THEN 1 ELSE 0 END' for q in (1, 2, 3, 4))} END AS bucket FROM y)"
R.add("br7_velocity", lambda s, d: mk.velocity(br(s, d)).select("trade_date", "velocity", "bucket"), "brs", f"{VEL} SELECT trade_date, {r('v', 'velocity')}, CAST(bucket AS INTEGER) AS bucket FROM z")
R.add("br13_exposure", lambda s, d: mk.exposure(mk.velocity(br(s, d))).select("trade_date", "label", "bucket", "exposure"), "brs", f"{VEL} SELECT trade_date, label, CAST(bucket AS INTEGER) AS bucket, round(CASE WHEN bucket IS NOT NULL THEN 0.1 + 0.2 * {RANKL} + 0.025 * (bucket - 3) END, 3) AS exposure FROM z")
R.add("br14_members", lambda s, d: mk.members(bars(s, d)), "bars", "WITH m AS (SELECT min(trade_date) AS rebalance FROM bars GROUP BY date_trunc('month', trade_date)), v AS (SELECT rebalance, symbol_id, quantile_cont(close * volume, 0.5) AS mv FROM bars JOIN m ON trade_date < rebalance AND rebalance - trade_date <= 180 GROUP BY 1, 2) SELECT rebalance, symbol_id, round(mv, 6) AS median_value, CAST(row_number() OVER (PARTITION BY rebalance ORDER BY round(mv, 6) DESC, symbol_id) AS INTEGER) AS rank FROM v QUALIFY row_number() OVER (PARTITION BY rebalance ORDER BY round(mv, 6) DESC, symbol_id) <= 20")
R.add("br15_index", lambda s, d: mk.equal_weight_index(bars(s, d)), "bars", f"WITH x AS (SELECT trade_date, close / nullif(lag(close) {W}, 0) - 1 AS x FROM bars), y AS (SELECT trade_date, avg(CASE WHEN x IS NOT NULL THEN greatest(-0.5, least(0.5, x)) END) AS ret, count(x) AS n FROM x GROUP BY 1) SELECT trade_date, {r('ret', 'ret')}, n, {r(f'100 * exp(sum(ln(1 + coalesce(ret, 0))) {DD})', 'level')} FROM y")

R.add("sr2_against_benchmark", lambda s, d: mk.against_benchmark(bars(s, d), benchmark(bars(s, d))).select(*KEY, "rs"), "bars bench", f"SELECT symbol_id, trade_date, {r('close / nullif(bench_close, 0) - 1', 'rs')} FROM bars LEFT JOIN bench USING (trade_date)")
SQL["sect"] = f"SELECT trade_date, sector, round(avg(x), 9) AS sector_return FROM (SELECT trade_date, sector, close / nullif(lag(close, 20) {W}, 0) - 1 AS x FROM bars JOIN master USING (symbol_id)) GROUP BY 1, 2"
SQL["secp"] = f"SELECT *, {pct('sector_return', 'trade_date')} AS sector_pct FROM sect"
NEEDS |= {"sect": ["bars", "master"], "secp": ["sect"]}
sec = lambda s, d: mk.sector_returns(bars(s, d), master(s, d))
R.add("sr4_sector_returns", sec, "secp", f"SELECT trade_date, sector, {r('sector_return', 'sector_return')}, {r('sector_pct', 'sector_pct')} FROM secp")
R.add("sr5_sector_breadth", lambda s, d: mk.sector_breadth(bars(s, d), master(s, d)), "bars master", f"WITH x AS (SELECT trade_date, sector, CASE WHEN count(*) {frame(50)} >= 30 THEN close > avg(close) {frame(50)} END AS a, CASE WHEN count(*) {frame(200)} >= 120 THEN close > avg(close) {frame(200)} END AS b FROM bars JOIN master USING (symbol_id)) SELECT trade_date, sector, {r(f'0.6 * {AV('a')} + 0.4 * {AV('b')}', 'breadth')}, count(*) AS n FROM x GROUP BY 1, 2")
SW = "OVER (PARTITION BY sector ORDER BY trade_date)"
QUAD = lambda a, m, x, y: f"CASE WHEN {a} >= {x} AND {m} >= {y} THEN 'Leading' WHEN {a} >= {x} AND {m} < {y} THEN 'Weakening' WHEN {a} < {x} AND {m} < {y} THEN 'Lagging' WHEN {a} < {x} AND {m} >= {y} THEN 'Improving' END"
R.add("sr6_rotation", lambda s, d: mk.rotation(sec(s, d)).select("trade_date", "sector", "rs_before", "momentum", "rs_rank", "quadrant"), "secp", f"WITH x AS (SELECT *, lag(sector_pct, 20) {SW} AS b FROM secp), y AS (SELECT *, sector_pct - b AS m FROM x) SELECT trade_date, sector, {r('b', 'rs_before')}, {r('m', 'momentum')}, CAST(rank() OVER (PARTITION BY trade_date ORDER BY sector_pct DESC NULLS LAST) AS INTEGER) AS rs_rank, {QUAD('sector_pct', 'coalesce(m, 0)', 0.5, 0)} AS quadrant FROM y")
R.add("sr8_top_per_sector", lambda s, d: mk.top_per_sector(rk.latest(rk.returns(bars(s, d), 20)).join(master(s, d), "symbol_id"), "ret_20", 3).select("sector", "symbol_id", "place"), "bars master", f"WITH x AS (SELECT symbol_id, sector, round(100 * (close / nullif(lag(close, 20) {W}, 0) - 1), 6) AS q FROM bars JOIN master USING (symbol_id) {LATEST}) SELECT sector, symbol_id, CAST(row_number() OVER (PARTITION BY sector ORDER BY q DESC NULLS LAST, symbol_id) AS INTEGER) AS place FROM x QUALIFY row_number() OVER (PARTITION BY sector ORDER BY q DESC NULLS LAST, symbol_id) <= 3")
SQL["grp0"] = "SELECT sector, trade_date, sum(close * market_cap) / nullif(sum(market_cap), 0) AS v FROM bars JOIN master USING (symbol_id) GROUP BY 1, 2"
SQL["grp"] = f"SELECT sector, trade_date, 100 * v / nullif(first(v) {SW}, 0) AS line FROM grp0"
NEEDS |= {"grp0": ["bars", "master"], "grp": ["grp0"]}
R.add("sr10_group_index", lambda s, d: mk.group_index(bars(s, d), master(s, d)), "grp", f"SELECT sector, trade_date, {r('line', 'line')} FROM grp")


def sf(n):
    return f"OVER (PARTITION BY sector ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


R.add("sr12_rrg", lambda s, d: mk.rrg(mk.group_index(bars(s, d), master(s, d))).select("sector", "trade_date", "rs_ratio", "rs_momentum", "quadrant"), "grp", f"WITH x AS (SELECT *, CASE WHEN count(*) {sf(63)} >= 20 THEN 100 * line / nullif(avg(line) {sf(63)}, 0) END AS q FROM grp), y AS (SELECT *, CASE WHEN count(q) {sf(20)} >= 5 THEN 100 * q / nullif(avg(q) {sf(20)}, 0) END AS m FROM x) SELECT sector, trade_date, {r('q', 'rs_ratio')}, {r('m', 'rs_momentum')}, {QUAD('round(q, 6)', 'round(m, 6)', 100, 100)} AS quadrant FROM y")
R.add("sr15_alpha_buckets", lambda s, d: rk.returns(bars(s, d), 20).select(*KEY, F.round("ret_20", 6).alias("alpha")).withColumn("bucket", mk.alpha_bucket(F.col("alpha"))), "bars", f"WITH x AS (SELECT symbol_id, trade_date, {r(f'100 * (close / nullif(lag(close, 20) {W}, 0) - 1)', 'alpha')} FROM bars) SELECT *, CASE WHEN alpha < -20 THEN 'deep_negative' WHEN alpha < -10 THEN 'negative' WHEN alpha < -2 THEN 'slightly_negative' WHEN alpha < 2 THEN 'flat' WHEN alpha < 10 THEN 'slightly_positive' WHEN alpha < 20 THEN 'positive' WHEN alpha IS NOT NULL THEN 'deep_positive' END AS bucket FROM x")
ZS = lambda c: f"round(({c} - avg({c}) {frame(20)}) / nullif(stddev_samp({c}) {frame(20)}, 0), 6)"
R.add("sr16_accumulation", lambda s, d: mk.accumulation(bars(s, d)).select(*KEY, "delivery_z", "volume_z", "score", "label"), "bars", f"WITH x AS (SELECT symbol_id, trade_date, {ZS('delivery_pct')} AS delivery_z, {ZS('volume')} AS volume_z, close >= lag(close) {W} AS up FROM bars), y AS (SELECT *, 60 * coalesce({pct('delivery_z', 'trade_date')}, 0.5) + 40 * coalesce({pct('volume_z', 'trade_date')}, 0.5) AS score FROM x) SELECT symbol_id, trade_date, delivery_z, volume_z, {r('score', 'score')}, CASE WHEN score >= 70 AND up THEN 'ACCUMULATION' WHEN score >= 70 AND NOT up THEN 'DISTRIBUTION' ELSE 'NEUTRAL' END AS label FROM y")
