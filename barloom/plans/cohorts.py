"""Queries of confirmed patterns (PT) and of cohorts of signals and stages (PT, OUT) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.stats import along
from barloom.operators import market as mk
from barloom.operators import signals as sg
from barloom.plans import valuations
from barloom.plans.kit import NEEDS, SQL, Registry
from barloom.plans.markets import stage_rows
from barloom.plans.technical import VZ, W, frame, r
from barloom.sources.bars import bars

R = Registry()
KEY = ["symbol_id", "trade_date"]
SQL |= {
    "ah0": f"SELECT *, volume / nullif(avg(volume) {frame(20, 1)}, 0) AS volume_ratio, {VZ}, row_number() {W} AS n, count(*) OVER (PARTITION BY symbol_id) AS total, last(close) OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_close FROM bars",
    "ah": "SELECT *, coalesce(volume_ratio >= 1.5 AND (coalesce(vol_z20 >= 2, false) OR coalesce(vol_z50 >= 2, false)), false) AS loud FROM ah0",
}
NEEDS |= {"ah0": ["bars"], "ah": ["ah0"]}


def met(found: str, ceiling: str, rest: str) -> str:
    """SQL that resolves candidates: the first loud close above the pivot in 15 bars, else near it on the last bars."""
    return f"""m AS (SELECT c.*, (SELECT min(a.trade_date) FROM ah a WHERE a.symbol_id = c.symbol_id AND a.n > c.n AND a.n <= c.n + 15 AND a.loud AND a.close > c.{ceiling}) AS signal_date FROM {found} c),
s AS (SELECT *, CASE WHEN signal_date IS NOT NULL THEN 'confirmed' WHEN total - n <= 5 AND last_close BETWEEN 0.97 * {ceiling} AND {ceiling} THEN 'watchlist' END AS state FROM m) SELECT {rest} FROM s WHERE state IS NOT NULL"""


SEG = lambda i: f"OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN {40 - 13 * i} PRECEDING AND {40 - 13 * i - 12} PRECEDING)"
CON = ", ".join(f"CASE WHEN count(*) {SEG(i)} >= 13 THEN (max(close) {SEG(i)} - min(close) {SEG(i)}) / nullif(min(close) {SEG(i)}, 0) END AS r{i}, CASE WHEN count(volume_ratio) {SEG(i)} >= 13 THEN avg(volume_ratio) {SEG(i)} END AS v{i}" for i in range(3))
Q = lambda e: r(f"CASE WHEN state = 'watchlist' THEN {e} - 10 ELSE {e} END", "quality")
R.add("pt8_contractions", lambda s, d: sg.contractions(bars(s, d)), "ah", f"""WITH a AS (SELECT *, {CON}, max(high) {frame(41)} AS ceiling, min(low) {frame(41)} AS invalidation FROM ah), b AS (SELECT *, greatest(0.0, least(100.0, 55 + least(80 * (r0 - r1), 15) + least(60 * (1 - v0 / nullif(v1, 0)), 10))) AS q FROM a WHERE r0 >= 0.08 AND r1 < 0.85 * r0 AND r2 < 0.85 * r1 AND v1 < 0.9 * v0 AND v2 < 0.9 * v1),
{met('b', 'ceiling', f"symbol_id, trade_date, {r('ceiling', 'ceiling')}, {r('invalidation', 'invalidation')}, {Q('q')}, state, signal_date")}""")
R.add("pt10_reclaims", lambda s, d: sg.reclaims(bars(s, d)), "ah", f"""WITH a AS (SELECT *, CASE WHEN count(*) {frame(150)} >= 150 THEN avg(close) {frame(150)} END AS level FROM ah), b AS (SELECT *, 100 * (level / nullif(lag(level, 20) {W}, 0) - 1) AS slope, lag(close) {W} AS pc, lag(level) {W} AS pl, close / nullif(level, 0) - 1 AS x FROM a)
SELECT symbol_id, trade_date, {r('close', 'close')}, {r('level', 'level')}, {r('slope', 'slope')}, {r('0.97 * level', 'invalidation')}, {r('greatest(0.0, least(100.0, 52 + least(12, 2 * greatest(0, slope)) + least(12, 8 * greatest(0, volume_ratio - 1.5)) + greatest(0, 12 - 100 * x)))', 'quality')} FROM b WHERE pc <= pl AND close > level AND slope >= 0 AND x BETWEEN 0 AND 0.08 AND loud""")
R.add("pt15_inside_weeks", lambda s, d: sg.inside_weeks(bars(s, d)), "ah", f"""WITH w AS (SELECT symbol_id, CAST(trade_date + CAST((12 - isodow(trade_date)) % 7 AS INTEGER) AS DATE) AS week_end, max(high) AS ceiling, min(low) AS low, max(n) AS n, max(total) AS total, max(last_close) AS last_close FROM ah GROUP BY 1, 2), b AS (SELECT *, lag(ceiling) OVER k AS h, lag(low) OVER k AS l FROM w WINDOW k AS (PARTITION BY symbol_id ORDER BY week_end)), c AS (SELECT * FROM b WHERE ceiling < h AND low > l),
{met('c', 'ceiling', f"symbol_id, week_end, {r('ceiling', 'ceiling')}, {r('low', 'invalidation')}, {r('greatest(0.0, least(100.0, 55 + least(15, 300 * (h - ceiling) / nullif(h, 0))))', 'quality')}, signal_date")} AND state = 'confirmed'""")
OWN, EARLIER = "OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)", "OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN 35 PRECEDING AND 16 PRECEDING)"
R.add("pt16_tight_closes", lambda s, d: sg.tight_closes(bars(s, d)), "ah", f"""WITH a AS (SELECT *, lag(close, 5) {W} AS c1, lag(close, 10) {W} AS c2, lag(close, 15) {W} AS b0, coalesce(lag(close, 35) {W}, first(close) {W}) AS p0, max(high) {OWN} AS ceiling, coalesce(avg(volume_ratio) {OWN} < avg(volume_ratio) {EARLIER}, false) AS dry FROM ah),
b AS (SELECT *, (greatest(close, c1, c2) - least(close, c1, c2)) / nullif(greatest(close, c1, c2), 0) AS t, (b0 - p0) / nullif(p0, 0) AS adv, 0.97 * c2 AS invalidation FROM a WHERE n > 15 AND total >= 35), c AS (SELECT *, greatest(0.0, least(100.0, 52 + least(2000 * (0.015 - t), 15) + least(50 * (adv - 0.2), 10) + CASE WHEN dry THEN 8.0 ELSE 0.0 END)) AS q FROM b WHERE t <= 0.015 AND adv >= 0.2),
{met('c', 'ceiling', f"symbol_id, trade_date, {r('ceiling', 'ceiling')}, {r('invalidation', 'invalidation')}, dry, {Q('q')}, state, signal_date")}""")

# --- cohorts ------------------------------------------------------------------------------------------------
SQL["sigs"] = f"SELECT symbol_id, trade_date, setup_family AS family, final_score AS quality, lead(close, 20) {W} / nullif(close, 0) - 1 AS fwd_20, lead(close, 60) {W} / nullif(close, 0) - 1 AS fwd_60 FROM cand"
NEEDS["sigs"] = ["cand"]
sigs = lambda s, d: valuations.cand(s, d).withColumns({f"fwd_{n}": F.lead("close", n).over(along()) / F.nullif(F.col("close"), F.lit(0.0)) - 1 for n in (20, 60)}).withColumnsRenamed({"setup_family": "family", "final_score": "quality"})
HZ = ", ".join(f"count(fwd_{h}) AS n_{h}, {r(f'avg((fwd_{h} > 0)::INT)', f'hit_rate_{h}')}, {r(f'avg(fwd_{h})', f'mean_{h}')}, {r(f'quantile_cont(fwd_{h}, 0.5)', f'median_{h}')}" for h in (20, 60))
R.add("pt32_quality_calibration", lambda s, d: sg.quality_calibration(sigs(s, d).filter("family is not null"), 20, 60), "sigs", f"SELECT family, CASE WHEN quality < 50 THEN '0-50' WHEN quality < 65 THEN '50-65' WHEN quality < 80 THEN '65-80' WHEN quality < 90 THEN '80-90' ELSE '90-100' END AS quality_bin, count(*) AS signals, {r('avg(quality)', 'avg_quality')}, {HZ} FROM sigs WHERE family IS NOT NULL GROUP BY 1, 2")
AHEAD = "OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)"
SQL["outs0"] = f"SELECT symbol_id, trade_date, setup_family AS family, verdict AS lane, symbol_id % 3 AS band, close, high AS entry, low AS inv, lead(close, 20) {W} AS e, max(high) {AHEAD} AS hi, min(low) {AHEAD} AS lo, {', '.join(f'lead(high, {k}) {W} AS h{k}' for k in range(1, 21))} FROM cand"
SQL["outs"] = f"SELECT *, e IS NOT NULL AS complete, e / nullif(close, 0) - 1 AS fwd, e / nullif(close, 0) - 1 - 0.01 * (symbol_id % 4) AS relative, hi / nullif(close, 0) - 1 AS mfe, lo / nullif(close, 0) - 1 AS mae, coalesce(hi > entry, false) AS confirmed, coalesce(e <= inv, false) AS failed, CASE {' '.join(f'WHEN h{k} > entry THEN {k}' for k in range(1, 21))} END AS days_to_breakout FROM outs0 WHERE family IS NOT NULL"
NEEDS |= {"outs0": ["cand"], "outs": ["outs0"]}


def outcomes(s, d):
    w, spec = along(), along().rowsBetween(1, 20)
    rows = valuations.cand(s, d).withColumns({"e": F.lead("close", 20).over(w), "hi": F.max("high").over(spec), "lo": F.min("low").over(spec), "_h": F.collect_list("high").over(spec)}).filter("setup_family is not null")
    days = F.nullif(F.array_position(F.transform("_h", lambda x: x > F.col("high")), F.lit(True)), F.lit(0))
    over = lambda c: F.col(c) / F.nullif(F.col("close"), F.lit(0.0)) - 1
    return rows.select(*KEY, F.col("setup_family").alias("family"), F.col("verdict").alias("lane"), (F.col("symbol_id") % 3).alias("band"), F.col("e").isNotNull().alias("complete"), over("e").alias("fwd"), (over("e") - 0.01 * (F.col("symbol_id") % 4)).alias("relative"), over("hi").alias("mfe"), over("lo").alias("mae"), F.coalesce(F.col("hi") > F.col("high"), F.lit(False)).alias("confirmed"), F.coalesce(F.col("e") <= F.col("low"), F.lit(False)).alias("failed"), days.alias("days_to_breakout"))


MED = ", ".join(r(f"quantile_cont({c}, 0.5)", f"median_{c}") for c in ("fwd", "mfe", "mae", "days_to_breakout"))
ZV = 1.959963984540054


def interval(k: str, name: str) -> str:
    p = f"({k} / n)"
    margin = f"{ZV} * sqrt(({p} * (1 - {p}) + {ZV * ZV} / (4 * n)) / n)"
    return f"{r(p, name + '_share')}, {r(f'greatest(0, ({p} + {ZV * ZV} / (2 * n) - {margin}) / (1 + {ZV * ZV} / n))', name + '_low')}, {r(f'least(1, ({p} + {ZV * ZV} / (2 * n) + {margin}) / (1 + {ZV * ZV} / n))', name + '_high')}"


R.add("pt35_calibration", lambda s, d: sg.calibration(outcomes(s, d), ["lane", "family", "band"]), "outs", f"""WITH g AS (SELECT lane, family, band, count(*) AS n, count(*) FILTER (WHERE confirmed) AS c, count(*) FILTER (WHERE failed) AS f, {r('avg(fwd)', 'mean_fwd')}, {r('avg(relative)', 'mean_relative')}, {MED} FROM outs WHERE complete GROUP BY ALL)
SELECT * EXCLUDE (c, f), {interval('c', 'confirmed')}, {interval('f', 'failed')}, n >= 30 AS enough FROM g""")
SQL["clas"] = "SELECT symbol_id, trade_date, symbol_id % 3 AS band, setup_family, round(close * volume, 2) AS liquidity FROM cand"
NEEDS["clas"] = ["cand"]
clas = lambda s, d: valuations.cand(s, d).select(*KEY, (F.col("symbol_id") % 3).alias("band"), "setup_family", F.round(F.col("close") * F.col("volume"), 2).alias("liquidity"))


def controls(s, d):
    rows = clas(s, d)
    flagged = rows.filter("setup_family is not null").select(F.concat_ws(":", "symbol_id", "trade_date").alias("signal_id"), *KEY, "band")
    return sg.matched_controls(flagged, rows.drop("setup_family"), "trade_date", "band")


CTRL = """ctl AS (SELECT g.symbol_id || ':' || g.trade_date AS signal_id, g.symbol_id, g.trade_date, g.band, g.liquidity, c.symbol_id AS control_symbol, c.liquidity AS control_liquidity FROM clas g JOIN clas c ON c.trade_date = g.trade_date AND c.band = g.band AND c.setup_family IS NULL WHERE g.setup_family IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY g.symbol_id, g.trade_date ORDER BY round(abs(c.liquidity - g.liquidity), 12), c.symbol_id) = 1)"""
R.add("pt36_controls", controls, "clas", f"WITH {CTRL} SELECT signal_id, symbol_id, trade_date, band, {r('liquidity', 'liquidity')}, control_symbol, {r('control_liquidity', 'control_liquidity')} FROM ctl")


def paired(s, d):
    fwd = sigs(s, d).select(*KEY, F.col("fwd_20").alias("fwd"), F.col("fwd_20").isNotNull().alias("complete"))
    pairs = controls(s, d).select("signal_id", "trade_date", "symbol_id", "control_symbol")
    own = pairs.join(fwd, KEY).select("signal_id", *KEY, "fwd", "complete")
    other = pairs.drop("symbol_id").withColumnRenamed("control_symbol", "symbol_id").join(fwd, KEY).select("signal_id", "trade_date", "fwd", "complete")
    return sg.signal_minus_control(own, other, "signal_id", "trade_date").select("signal_id", *KEY, "fwd", "control_fwd", "difference")


R.add("pt37_signal_minus_control", paired, "clas sigs", f"WITH {CTRL} SELECT signal_id, ctl.symbol_id, ctl.trade_date, {r('a.fwd_20', 'fwd')}, {r('b.fwd_20', 'control_fwd')}, {r('a.fwd_20 - b.fwd_20', 'difference')} FROM ctl JOIN sigs a ON a.symbol_id = ctl.symbol_id AND a.trade_date = ctl.trade_date JOIN sigs b ON b.symbol_id = ctl.control_symbol AND b.trade_date = ctl.trade_date WHERE a.fwd_20 IS NOT NULL AND b.fwd_20 IS NOT NULL")

# --- stages -------------------------------------------------------------------------------------------------
SQL |= {
    "sess": "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT DISTINCT trade_date FROM bars)",
    "sret": "SELECT b.symbol_id, b.trade_date, b.close, 100 * (c.close / b.close - 1) AS ret_4w, 100 * (e.close / b.close - 1) AS ret_12w FROM bars b JOIN sess s USING (trade_date) LEFT JOIN sess t ON t.k = s.k + 20 LEFT JOIN bars c ON c.symbol_id = b.symbol_id AND c.trade_date = t.trade_date LEFT JOIN sess u ON u.k = s.k + 60 LEFT JOIN bars e ON e.symbol_id = b.symbol_id AND e.trade_date = u.trade_date",
    "ent0": "SELECT a.*, (SELECT min(trade_date) FROM sess WHERE trade_date >= a.week_end) AS trade_date FROM age a",
    "entry": "SELECT ent0.*, close, ret_4w, ret_12w, CASE WHEN transition = 'S1->S2' THEN 'S1_TO_S2' WHEN stage = 'S2' AND bars_in_stage <= 8 THEN 'fresh_s2' WHEN stage = 'S2' THEN 'mature_s2' ELSE 'non_s2' END AS bucket FROM ent0 JOIN sret USING (symbol_id, trade_date)",
}
NEEDS |= {"sess": ["bars"], "sret": ["bars", "sess"], "ent0": ["age", "sess"], "entry": ["ent0", "sret"]}


def entries(s, d):
    returns = sg.session_returns(bars(s, d), **{"4w": 20, "12w": 60}).select(*KEY, "close", "ret_4w", "ret_12w")
    return sg.stage_entries(stage_rows(s, d).select("symbol_id", "week_end", "stage", "transition", "bars_in_stage", "confidence"), returns).withColumn("bucket", sg.freshness_bucket())


FIGURES = lambda v: f"count(*) AS n, {r(f'avg({v})', 'mean')}, {r(f'quantile_cont({v}, 0.5)', 'median')}, {r(f'100 * avg(({v} > 0)::INT)', 'win_rate')}, {r(f'quantile_cont({v}, 0.25)', 'p25')}, {r(f'quantile_cont({v}, 0.75)', 'p75')}"
long = lambda rows, *keep: rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret")) for h in ("4w", "12w")])).alias("_x")).select(*keep, "_x.*")
R.add("out40_freshness", lambda s, d: sg.spread_of(long(entries(s, d), "bucket"), "ret", "bucket", "horizon"), "entry", f"WITH x AS (SELECT bucket, '4w' AS horizon, ret_4w AS v FROM entry UNION ALL SELECT bucket, '12w', ret_12w FROM entry) SELECT bucket, horizon, {FIGURES('v')} FROM x WHERE v IS NOT NULL GROUP BY 1, 2")
scored = lambda s, d: entries(s, d).withColumns({"score": F.round(100 * F.col("confidence") - F.col("symbol_id") % 10, 6), "gated": F.col("stage") == "S2"})
R.add("out39_gated_baskets", lambda s, d: sg.spread_of(long(sg.gate_baskets(scored(s, d), 10, "ret_4w", "ret_12w"), "mode"), "ret", "mode", "horizon"), "entry", f"""WITH s AS (SELECT *, round(100 * confidence - symbol_id % 10, 6) AS score FROM entry), p AS (SELECT 'baseline' AS mode, * FROM s QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol_id) <= 10 UNION ALL SELECT 'gated', * FROM s WHERE stage = 'S2' QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol_id) <= 10),
g AS (SELECT trade_date, mode, avg(ret_4w) AS a, avg(ret_12w) AS b FROM p GROUP BY ALL), x AS (SELECT mode, '4w' AS horizon, a AS v FROM g UNION ALL SELECT mode, '12w', b FROM g) SELECT mode, horizon, {FIGURES('v')} FROM x WHERE v IS NOT NULL GROUP BY 1, 2""")
