"""Queries of chart shapes between turning points (PT) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.shared import kept
from barloom.functions.stats import along, clip, full, ratio, trailing
from barloom.operators import scans as sc
from barloom.operators import shapes as sh
from barloom.plans.kit import NEEDS, SQL, Registry
from barloom.plans.technical import TR, VZ, W, frame, pct, r
from barloom.sources.bars import master, walks

R = Registry()
SQL["sm"] = f"""WITH a AS (SELECT *, {TR} FROM walks), b AS (SELECT *, {VZ} FROM a)
SELECT symbol_id, trade_date, high, low, close, volume / nullif(avg(volume) {frame(20, 1)}, 0) AS vr, coalesce(vol_z20 >= 2, false) OR coalesce(vol_z50 >= 2, false) AS spike, avg(tr) {frame(14)} AS atr,
avg(close) OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS v, row_number() {W} - 1 AS n, count(*) OVER (PARTITION BY symbol_id) AS total FROM b"""
SQL["pts"] = """WITH w AS (SELECT symbol_id, trade_date, n, s, s * v AS x FROM sm, (VALUES (1), (-1)) t(s)), c AS (SELECT *, lag(x) OVER k AS a, lead(x) OVER k AS b FROM w WINDOW k AS (PARTITION BY symbol_id, s ORDER BY n)), p AS (SELECT * FROM c WHERE x > a AND x > b),
g AS (SELECT p.symbol_id, p.s, p.n, p.trade_date, p.x, max(CASE WHEN o.n < p.n AND o.x > p.x THEN o.n END) AS l, min(CASE WHEN o.n > p.n AND o.x > p.x THEN o.n END) AS r FROM p JOIN w o ON o.symbol_id = p.symbol_id AND o.s = p.s GROUP BY ALL),
q AS (SELECT g.symbol_id, g.s, g.n, g.trade_date, g.x, g.l, g.r, min(CASE WHEN o.n <= g.n AND o.n > coalesce(g.l, -1) THEN o.x END) AS lm, min(CASE WHEN o.n >= g.n AND o.n < coalesce(g.r, o.n + 1) THEN o.x END) AS rm FROM g JOIN w o ON o.symbol_id = g.symbol_id AND o.s = g.s GROUP BY ALL),
z AS (SELECT symbol_id, max(v) - min(v) AS reach, abs(avg(v)) AS m, max(total) AS total FROM sm GROUP BY 1)
SELECT q.symbol_id, q.trade_date, q.n AS pos, q.s = 1 AS top, q.s * q.x AS v, z.total, row_number() OVER (PARTITION BY q.symbol_id ORDER BY q.n) AS k, row_number() OVER (PARTITION BY q.symbol_id, q.s ORDER BY q.n) AS own FROM q JOIN z ON z.symbol_id = q.symbol_id
WHERE z.reach > greatest(1e-9, z.m * 1e-9) AND q.x - greatest(q.lm, q.rm) >= greatest(0.02 * z.reach, 1e-6)"""
SQL["ptb"] = """WITH w AS (SELECT symbol_id, n, s, s * v AS x, total FROM sm, (VALUES (1), (-1)) t(s)), c AS (SELECT *, lag(x) OVER k AS a, lead(x) OVER k AS b FROM w WINDOW k AS (PARTITION BY symbol_id, s ORDER BY n)), z AS (SELECT symbol_id, max(v) - min(v) AS reach FROM sm GROUP BY 1)
SELECT c.symbol_id, c.n AS pos, c.s = 1 AS top, c.s * c.x AS v, c.total, row_number() OVER (PARTITION BY c.symbol_id, c.s ORDER BY c.n) AS own FROM c JOIN z ON z.symbol_id = c.symbol_id WHERE c.x > c.a AND c.x > c.b AND c.x - greatest(c.a, c.b) >= greatest(0.002 * z.reach, 1e-6)"""
NEEDS |= {"sm": ["walks"], "pts": ["sm"], "ptb": ["sm"]}

R.add("pt2_prominent", lambda s, d: sh.prominent_points(walks(s, d)), "pts", f'''SELECT symbol_id, trade_date, CAST(pos AS INTEGER) AS "at", CASE WHEN top THEN 'peak' ELSE 'trough' END AS kind, {r("v", "value")} FROM pts''')


def over(what: str, first: str, last: str) -> str:
    """An aggregate of the bars of a candidate's symbol between two places."""
    return f"(SELECT {what} FROM sm s WHERE s.symbol_id = c.symbol_id AND s.n BETWEEN {first} AND {last})"


def hit(after: str, level: str, ratio: float = 1.5) -> str:
    return f"(SELECT min(s.n) FROM sm s WHERE s.symbol_id = c.symbol_id AND s.n > {after} AND s.n <= {after} + 15 AND s.close > {level} AND s.vr >= {ratio} AND s.spike)"


def quiet(first: str, last: str) -> str:
    return f"coalesce({over('avg(s.vr)', first, last)} < 1, false)"


def risen(left: str, price: str) -> str:
    return f"{price} >= 1.15 * CASE WHEN {left} > 0 THEN {over('min(s.close)', f'{left} - 30', f'{left} - 1')} ELSE {over('min(s.close)', left, left)} END"


def recent(n: str) -> str:
    return f"{n} >= greatest(0, total - 6)"


def near(buffer: float = 0.03) -> str:
    return f"{over('min(s.close)', 'total - 1', 'total - 1')} BETWEEN {1 - buffer} * level AND level"


COLUMNS = ["symbol_id", "family", "state", "start_date", "end_date", "signal_date", "level", "invalidation", "quality", "width", "dry"]


def resolved(family: str, order: str, watch: str, extra: tuple[str, ...] = ()) -> str:
    """SQL from candidates c with start_n, end_n, hit, level, invalidation, quality, width, dry and total."""
    day = lambda n: f"(SELECT s.trade_date FROM sm s WHERE s.symbol_id = t.symbol_id AND s.n = t.{n})"
    more = "".join(f", {r(e, e)}" for e in extra)
    return f"""y AS (SELECT *, CASE WHEN hit IS NOT NULL THEN 'confirmed' WHEN {watch} THEN 'watchlist' END AS state FROM f c), t AS (SELECT *, CASE WHEN state = 'confirmed' THEN hit ELSE total - 1 END AS at_n FROM y WHERE state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id, state, CASE WHEN state = 'confirmed' THEN hit ELSE total - 1 END ORDER BY {order}) = 1)
SELECT symbol_id, '{family}' AS family, state, {day('start_n')} AS start_date, {day('end_n')} AS end_date, {day('at_n')} AS signal_date, {r('level', 'level')}, {r('invalidation', 'invalidation')}, {r("quality - CASE WHEN state = 'watchlist' THEN 10 ELSE 0 END", 'quality')}, CAST(width AS INTEGER) AS width, dry{more} FROM t"""


def add(name: str, families: tuple[str, ...], sql: str, extra: tuple[str, ...] = (), names: str = "pts", bars=walks) -> None:
    R.add(name, lambda s, d: sh.shapes(bars(s, d), *families).select(*COLUMNS, *extra), names, sql)


def points(*tops: bool) -> str:
    """Runs of neighbouring turning points as n0, n1 ... with their values v0, v1 ..."""
    first = "p0"
    joins = " ".join(f"JOIN pts p{i} ON p{i}.symbol_id = p0.symbol_id AND p{i}.k = p0.k + {i} AND p{i}.top = {str(t).lower()}" for i, t in enumerate(tops) if i)
    picked = ", ".join(f"p{i}.pos AS n{i}, p{i}.v AS v{i}" for i in range(len(tops)))
    return f"SELECT {first}.symbol_id, {first}.total, {picked} FROM pts p0 {joins} WHERE p0.top = {str(tops[0]).lower()} AND p0.total >= 120"


DWELL = f"{over('count(CASE WHEN s.v <= v1 * 1.03 THEN 1 END)', 'n0', 'n2')} >= 3"
CUP = f"""WITH a AS ({points(True, False, True, False)}), b AS (SELECT *, (v0 + v2) / 2 AS rim FROM a WHERE n2 - n0 BETWEEN 20 AND 130 AND n3 - n2 BETWEEN 3 AND 20), e AS (SELECT *, 1 - v1 / rim AS depth, 1 - v3 / v2 AS fall FROM b c WHERE abs(v0 - v2) <= 0.08 * greatest(v0, v2) AND {risen('n0', 'v0')} AND {DWELL}),
g AS (SELECT *, {over('max(s.high)', 'n0', 'n2')} AS level, {over('min(s.low)', 'n2', 'n3')} AS invalidation, {quiet('n1 - 2', 'n1 + 2')} AS dry FROM e c WHERE depth BETWEEN 0.15 AND 0.35 AND v3 >= (v1 + rim) / 2 AND fall > 0 AND fall <= 0.12),
f AS (SELECT *, {hit('n3', 'level')} AS hit, n0 AS start_n, n3 AS end_n, n2 - n0 AS width, 100 * depth AS depth_pct, 100 * fall AS handle_pct, (n1 - n0) / greatest(n2 - n1, 1) AS symmetry, 45 + greatest(0, 15 - 100 * abs(v0 - v2) / rim) + greatest(0, 18 - 100 * fall) + CASE WHEN dry THEN 8 ELSE 0 END AS quality FROM g c),
{resolved('cup_handle', 'n0', f"{recent('n3')} AND {near()} AND {over('min(s.low)', 'n3', 'total')} > invalidation", ("depth_pct", "handle_pct", "symmetry"))}"""
add("pt3_cup_handle", ("cup_handle",), CUP, ("depth_pct", "handle_pct", "symmetry"))
ROUND = f"""WITH a AS ({points(True, False)}), b AS (SELECT *, {over('min(CASE WHEN s.v >= v0 * 0.92 THEN s.n END)', 'n1 + 1', 'n1 + 160')} AS n2 FROM a c), e AS (SELECT *, {over('min(s.v)', 'n2', 'n2')} AS v2, (n1 - n0) / greatest(n2 - n1, 1) AS symmetry FROM b c WHERE n2 - n0 BETWEEN 20 AND 160),
g AS (SELECT *, 1 - v1 / ((v0 + v2) / 2) AS depth FROM e c WHERE symmetry BETWEEN 0.6 AND 1.4 AND {risen('n0', 'v0')} AND {DWELL}), h AS (SELECT *, {over('max(s.high)', 'n0', 'n2')} AS level, {quiet('n1 - 2', 'n1 + 2')} AS dry FROM g c WHERE depth BETWEEN 0.15 AND 0.35), i AS (SELECT *, {hit('n2', 'level')} AS hit FROM h c),
f AS (SELECT *, coalesce({over('min(s.low)', 'n2 + 1', 'coalesce(hit, total) - 1')}, level - 2 * {over('min(s.atr)', 'n2', 'n2')}) AS invalidation, n0 AS start_n, n2 AS end_n, n2 - n0 AS width, 100 * depth AS depth_pct, 48 + greatest(0, 14 - 20 * abs(1 - symmetry)) + CASE WHEN dry THEN 8 ELSE 0 END AS quality FROM i c),
{resolved('round_bottom', 'n0', f"{recent('n2')} AND coalesce({over('min(s.vr)', 'total - 1', 'total - 1')}, 0) >= 0.75 AND {near()} AND {over('min(s.low)', 'n2', 'total')} > invalidation", ("depth_pct", "symmetry"))}"""
add("pt4_round_bottom", ("round_bottom",), ROUND, ("depth_pct", "symmetry"))
DOUBLE = f"""WITH a AS ({points(False, True, False)}), b AS (SELECT *, (v0 + v2) / 2 AS bottom FROM a WHERE n2 - n0 BETWEEN 10 AND 60), e AS (SELECT *, abs(v0 - v2) / bottom AS spread FROM b c WHERE v1 / bottom - 1 >= 0.08 AND {risen('greatest(0, n0 - 1)', 'v1')}),
g AS (SELECT *, {over('max(s.high)', 'n0', 'n2')} AS level, {over('min(s.low)', 'n0', 'n2')} AS invalidation, {quiet('n2 - 2', 'n2 + 2')} AS dry FROM e c WHERE spread <= 0.04),
f AS (SELECT *, {hit('n2', 'level')} AS hit, n0 AS start_n, n2 AS end_n, n2 - n0 AS width, 100 * spread AS similarity_pct, 50 + greatest(0, 15 - 200 * spread) + CASE WHEN dry THEN 8 ELSE 0 END AS quality FROM g c),
{resolved('double_bottom', 'n0', f"{near()} AND {over('min(s.low)', 'n2', 'total')} > invalidation", ("similarity_pct",))}"""
add("pt5_double_bottom", ("double_bottom",), DOUBLE, ("similarity_pct",))
LOCAL = {"share": 0.002, "beside": True}
BETWEEN = """SELECT p.symbol_id, p.total, p.pos AS n0, q.pos AS n1, p.v AS v0, q.v AS v1, (SELECT list(t.v ORDER BY t.pos) FROM ptb t WHERE t.symbol_id = p.symbol_id AND NOT t.top AND t.pos > p.pos AND t.pos < q.pos) AS lows FROM ptb p JOIN ptb q ON q.symbol_id = p.symbol_id AND p.top AND q.top AND q.own = p.own + 1 WHERE p.total >= 120 AND q.pos - p.pos > 15"""
TAIL = f"""g AS (SELECT *, {over('max(s.high)', 'n0', 'n1')} AS level, 0.98 * lows[-1] AS invalidation, n1 - n0 AS width, n0 AS start_n, n1 AS end_n, n0 > 0 AND coalesce({over('avg(s.vr)', 'n1', 'n1 + 4')} < {over('avg(s.vr)', 'n0 - 5', 'n0 - 1')}, false) AS dry FROM b c), h AS (SELECT *, {hit('n1', 'level')} AS hit FROM g c)"""
RISING = "len(lows) >= 2 AND lows[1] IS NOT NULL AND len(list_filter(range(1, len(lows)), lambda j: lows[j + 1] < 1.005 * lows[j])) = 0"
ASCENDING = f"""WITH a AS ({BETWEEN}), b AS (SELECT * FROM a WHERE n1 - n0 <= 90 AND greatest(abs(v0 - (v0 + v1) / 2), abs(v1 - (v0 + v1) / 2)) <= 0.015 * ((v0 + v1) / 2) AND {RISING}), {TAIL},
f AS (SELECT *, greatest(0, least(100, 45 - least(200 * abs(v1 - v0) / ((v0 + v1) / 2), 15) + least(100 * (lows[-1] / lows[1] - 1), 10) + CASE WHEN dry THEN 8 ELSE 0 END - 0.2 * greatest(width - 30, 0))) AS quality FROM h),
{resolved('ascending_triangle', 'n0', f"{recent('n1')} AND {near()}")}"""
R.add("pt7_ascending_triangle", lambda s, d: sh.shapes(walks(s, d), "ascending_triangle", **LOCAL).select(*COLUMNS), "ptb", ASCENDING)
SYMMETRICAL = f"""WITH a AS ({BETWEEN}), b AS (SELECT * FROM a WHERE n1 - n0 <= 80 AND len(lows) >= 2 AND v1 < v0 AND lows[-1] > lows[1] AND v1 > lows[-1]), {TAIL},
f AS (SELECT *, greatest(0, least(100, 45 + least(50 * ((1 - v1 / v0) + (lows[-1] / lows[1] - 1)), 15) + CASE WHEN dry THEN 8 ELSE 0 END - 0.2 * greatest(width - 40, 0))) AS quality FROM h),
{resolved('symmetrical_triangle', 'n0', f"{recent('n1')} AND {near()}")}"""
R.add("pt17_symmetrical_triangle", lambda s, d: sh.shapes(walks(s, d), "symmetrical_triangle", **LOCAL).select(*COLUMNS), "ptb", SYMMETRICAL)
BASE = f"""WITH a AS (SELECT p.symbol_id, p.total, p.pos AS n0, q.pos AS n1, t.pos AS n2, p.v AS v0, q.v AS v1, t.v AS v2 FROM pts p JOIN pts q ON q.symbol_id = p.symbol_id AND NOT p.top AND NOT q.top AND q.own = p.own + 1 JOIN pts t ON t.symbol_id = p.symbol_id AND NOT t.top AND t.own = p.own + 2 WHERE p.total >= 120 AND t.pos - p.pos BETWEEN 45 AND 80 AND q.v >= 1.02 * p.v AND t.v >= 1.02 * q.v),
b AS (SELECT *, {over('max(s.high)', 'n0', 'n2')} AS level, {over('min(s.low)', 'n0', 'n2')} AS bottom FROM a c), f AS (SELECT *, {hit('n2', 'level')} AS hit, n0 AS start_n, n2 AS end_n, n2 - n0 AS width, 0.98 * v2 AS invalidation, coalesce({over('avg(s.vr)', 'n1', 'n2')} < {over('avg(s.vr)', 'n0', 'n1 - 1')}, false) AS dry, least(100, 58 + least(18, 120 * (v2 / v0 - 1))) AS quality FROM b c WHERE 1 - bottom / level <= 0.20),
{resolved('ascending_base', 'n0', 'false')}"""
add("pt13_ascending_base", ("ascending_base",), BASE)


NEXT = lambda k: f"OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING)"


def flags(family: str, longest: int, rise: float, retraced: float, narrow: str, least: float, share: int) -> str:
    return f"""WITH p AS (SELECT b.symbol_id, b.total, a.n AS foot, b.n AS top, a.close AS c0, b.close AS c1, b.v AS v1 FROM sm b JOIN sm a ON a.symbol_id = b.symbol_id AND a.n BETWEEN b.n - {longest} AND b.n - 5 WHERE b.total >= 120 AND b.n <= b.total - 5 AND 100 * (b.close / a.close - 1) >= {rise}),
w0 AS (SELECT symbol_id, n AS top, total, unnest([{', '.join(f"{{'k': {k}, 'v2': lead(v, {k}) {W}, 'level': max(high) {NEXT(k)}, 'invalidation': min(low) {NEXT(k)}, 'vr': avg(vr) {NEXT(k)}}}" for k in range(3, 16))}]) AS u FROM sm), w AS (SELECT symbol_id, top, top + u.k AS tail, u.v2 AS v2, u.level AS level, u.invalidation AS invalidation, u.vr AS vr FROM w0 WHERE top + u.k < total),
e AS (SELECT p.*, w.tail, w.level, w.invalidation, coalesce(w.vr < 1, false) AS dry, 100 * (c1 / c0 - 1) AS pole_pct, 100 * (w.level / w.invalidation - 1) AS range_pct, 100 * (c1 - w.invalidation) / (c1 - c0) AS retraced_pct FROM p JOIN w ON w.symbol_id = p.symbol_id AND w.top = p.top WHERE (w.v2 - v1) / (w.tail - p.top) <= 0.2),
g AS (SELECT * FROM e WHERE retraced_pct <= {retraced} {narrow} QUALIFY row_number() OVER (PARTITION BY symbol_id, foot, top ORDER BY tail) = 1),
f AS (SELECT *, {hit('tail', 'level', least)} AS hit, foot AS start_n, tail AS end_n, tail - foot AS width, 50 + least(20, pole_pct / {share}) + greatest(0, 20 - retraced_pct) + CASE WHEN dry THEN 8 ELSE 0 END AS quality FROM g c),
{resolved(family, 'top - foot, top', near(0.02), ("pole_pct", "range_pct", "retraced_pct"))}"""


FLAG = ("pole_pct", "range_pct", "retraced_pct")
add("pt6_flags", ("flag", "high_tight_flag"), f"SELECT * FROM ({flags('flag', 20, 12, 38, '', 1.5, 2)}) UNION ALL SELECT * FROM ({flags('high_tight_flag', 40, 90, 25, 'AND range_pct <= 15', 2.0, 3)})", FLAG, "sm")
TOPS = f"""WITH a AS (SELECT p.symbol_id, p.total, p.pos AS n0, q.pos AS n1, t.pos AS n2, p.v AS v0, q.v AS v1, t.v AS v2 FROM pts p JOIN pts q ON q.symbol_id = p.symbol_id AND p.top AND q.top AND q.own = p.own + 1 JOIN pts t ON t.symbol_id = p.symbol_id AND t.top AND t.own = p.own + 2 WHERE q.v > 1.03 * greatest(p.v, t.v) AND abs(p.v - t.v) <= 0.05 * p.v),
b AS (SELECT *, (SELECT max(x.pos) FROM pts x WHERE x.symbol_id = a.symbol_id AND NOT x.top AND x.pos > n0 AND x.pos < n1) AS t1, (SELECT min(x.pos) FROM pts x WHERE x.symbol_id = a.symbol_id AND NOT x.top AND x.pos > n1 AND x.pos < n2) AS t2 FROM a), e AS (SELECT *, {over('min(s.v)', 't1', 't1')} AS w1, {over('min(s.v)', 't2', 't2')} AS w2 FROM b c),
f AS (SELECT * FROM e c WHERE {over('min(s.close)', 'total - 1', 'total - 1')} < 0.99 * (w1 + w2) / 2 QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY n0) = 1)
SELECT symbol_id, {over('max(s.trade_date)', 'total - 1', 'total - 1')} AS signal_date, CAST(n0 AS INTEGER) AS "left", CAST(n1 AS INTEGER) AS head, CAST(n2 AS INTEGER) AS "right", {r('(w1 + w2) / 2', 'neckline')}, {r('w2 + (w2 - w1) / (t2 - t1) * (total - 1 - t2)', 'sloped')}, {r(over('max(s.high)', 'total - 61', 'total - 1'), 'invalidation')} FROM f c"""
R.add("pt19_broken_tops", lambda s, d: sh.broken_tops(walks(s, d)).select("symbol_id", "signal_date", "left", "head", "right", "neckline", "sloped", "invalidation"), "pts", TOPS)
R.add("pt11_darvas_box", lambda s, d: sh.shapes(walks(s, d), "darvas_box").select(*COLUMNS, "depth_pct"))
R.add("pt14_ipo_base", lambda s, d: sh.shapes(young(s, d), "ipo_base").select(*COLUMNS, "depth_pct"))


def young(s, d):
    """The first 150 bars of each symbol: what its listing looked like then."""
    return walks(s, d).withColumn("_n", F.row_number().over(along())).filter("_n <= 150").drop("_n")


def lines(s, d):
    rows = walks(s, d)
    return sh.triangle_lines(sh.shapes(rows, "ascending_triangle", "symmetrical_triangle", **LOCAL), sh.prominent_points(rows, **LOCAL))


FIT = lambda kind: ", ".join([r(f"regr_slope({kind}, x)", f"{NAME[kind]}_slope"), r(f"regr_intercept({kind}, x)", f"{NAME[kind]}_start"), f"count({kind}) AS {NAME[kind]}_touches"])
NAME = {"yp": "upper", "yt": "lower"}
R.add("pt17_triangle_lines", lines, "ptb", f"""WITH s AS (SELECT DISTINCT symbol_id, family, start_date, end_date FROM (SELECT * FROM ({ASCENDING}) UNION ALL SELECT * FROM ({SYMMETRICAL}))), t AS (SELECT s.symbol_id, s.family, a.n AS start_at, b.n AS end_at FROM s JOIN sm a ON a.symbol_id = s.symbol_id AND a.trade_date = s.start_date JOIN sm b ON b.symbol_id = s.symbol_id AND b.trade_date = s.end_date),
m AS (SELECT t.*, p.pos - start_at AS x, CASE WHEN p.top THEN p.v END AS yp, CASE WHEN NOT p.top THEN p.v END AS yt FROM t JOIN ptb p ON p.symbol_id = t.symbol_id AND p.pos BETWEEN start_at AND end_at), l AS (SELECT symbol_id, family, CAST(start_at AS INTEGER) AS start_at, CAST(end_at AS INTEGER) AS end_at, {FIT('yp')}, {FIT('yt')},
start_at + (regr_intercept(yp, x) - regr_intercept(yt, x)) / nullif(regr_slope(yt, x) - regr_slope(yp, x), 0) AS apex, regr_slope(yt, x) - regr_slope(yp, x) AS closing FROM m GROUP BY symbol_id, family, start_at, end_at) SELECT * EXCLUDE (apex, closing), {r('CASE WHEN closing > 0 THEN apex END', 'apex_at')} FROM l""")

# --- scans --------------------------------------------------------------------------------------------------
FAMILIES = ("cup_handle", "round_bottom", "double_bottom", "ascending_base", "flag")
SIG = [*COLUMNS, "symmetry", "handle_pct", "similarity_pct", "pole_pct", "range_pct", "retraced_pct"]


def listed(sql: str, *own: str) -> str:
    return f"SELECT {', '.join(COLUMNS)}, {', '.join(c if c in own else f'CAST(NULL AS DOUBLE) AS {c}' for c in SIG[len(COLUMNS):])} FROM ({sql})"


ALL = " UNION ALL ".join([listed(CUP, "symmetry", "handle_pct"), listed(ROUND, "symmetry"), listed(DOUBLE, "similarity_pct"), listed(BASE), listed(flags("flag", 20, 12, 38, "", 1.5, 2), *FLAG)])
found = lambda s, d: sc.scan(walks(s, d), *FAMILIES, latest=False)
SCAN = f"tops AS ({TOPS}), found AS ({ALL}), scan AS (SELECT *, 'bullish' AS direction FROM found WHERE symbol_id NOT IN (SELECT symbol_id FROM tops) UNION ALL SELECT symbol_id, 'head_shoulders', 'confirmed', NULL, NULL, signal_date, neckline, invalidation, 50.0, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, 'bearish' FROM tops)"
R.add("pt22_scan", lambda s, d: found(s, d).select(*SIG, "direction"), "pts", f"WITH {SCAN} SELECT * FROM scan")


def judged(s, d):
    z = F.col("symbol_id")
    rows = found(s, d).withColumns({"quality": F.round("quality", 6), "volume_ratio": 1.0 + (z % 10) / 10, "vol_z20": (z % 7) / 2.0, "vol_z50": (z % 5) * 0.6, "rel_strength_score": (z * 7 % 100).cast("double"), "sector_rs_percentile": F.when(z % 4 != 0, (z * 11 % 100).cast("double")), "stage2_score": (z * 13 % 100).cast("double")})
    return sc.signal_scores(rows.withColumns({c: F.round(c, 6) for c in SIG[len(COLUMNS) :]}))


def ladder(value: str, *pairs: tuple[float, float]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {limit} THEN {points}" for limit, points in pairs) + " ELSE 0 END"


ORDER = "round(quality, 9) DESC NULLS LAST, symbol_id, family, state, signal_date"
R.add("pt21_scores", lambda s, d: judged(s, d).select("symbol_id", "family", "state", "signal_date", "tier", "pattern_score", "priority_score", "pattern_rank", "priority_rank"), "pts", f"""WITH {SCAN}, a AS (SELECT *, 1.0 + (symbol_id % 10) / 10 >= 1.5 AS vr, (symbol_id % 7) / 2.0 >= 2 AS z20, (symbol_id % 5) * 0.6 >= 2 AS z50, symbol_id * 7 % 100 AS rs, CASE WHEN symbol_id % 4 <> 0 THEN symbol_id * 11 % 100 END AS sec, symbol_id * 13 % 100 AS s2 FROM scan),
b AS (SELECT *, vr AND (z20 OR z50) AS loud, vr AND z20 AS strong, CASE family WHEN 'cup_handle' THEN handle_pct <= 8 WHEN 'round_bottom' THEN symmetry BETWEEN 0.75 AND 1.35 WHEN 'double_bottom' THEN similarity_pct <= 3 WHEN 'flag' THEN retraced_pct <= 25 ELSE false END AS clear FROM a),
e AS (SELECT *, CASE WHEN family = 'head_shoulders' THEN 'suppression_only' WHEN family IN ('cup_handle', 'ascending_base') THEN 'tier_1' ELSE 'tier_2' END AS tier, CASE WHEN family = 'head_shoulders' THEN 0.0 ELSE least(100.0, CASE WHEN state = 'confirmed' THEN 40 ELSE 20 END + CASE WHEN strong THEN 20 WHEN loud THEN 18 ELSE 0 END + {ladder('rs', (80, 15), (60, 8))} + {ladder('sec', (70, 10), (60, 5))} + CASE WHEN dry THEN 10 ELSE 0 END + CASE WHEN clear THEN 10 ELSE 0 END + {ladder('s2', (85, 15), (70, 10), (50, 5))}) END AS ps FROM b),
f AS (SELECT *, CASE WHEN family = 'head_shoulders' THEN 0.0 ELSE least(100.0, 0.35 * ps + CASE WHEN tier = 'tier_1' THEN 22 ELSE 12 END + {ladder('s2', (85, 14), (70, 9), (50, 4))} + {ladder('rs', (80, 10), (60, 5))} + {ladder('sec', (70, 6), (60, 3))} + CASE WHEN state = 'confirmed' THEN CASE WHEN strong THEN 10 WHEN loud THEN 8 ELSE 4 END WHEN loud THEN 4 ELSE 0 END + least(12.0, greatest(0.0, 0.12 * quality))
+ CASE family WHEN 'cup_handle' THEN CASE WHEN handle_pct <= 8 THEN 8 ELSE 0 END WHEN 'round_bottom' THEN CASE WHEN symmetry BETWEEN 0.85 AND 1.15 THEN 8 WHEN symmetry BETWEEN 0.75 AND 1.35 THEN 4 ELSE 0 END WHEN 'double_bottom' THEN CASE WHEN similarity_pct <= 3 THEN 8 WHEN similarity_pct <= 5 THEN 4 ELSE 0 END WHEN 'flag' THEN CASE WHEN retraced_pct <= 25 THEN 8 WHEN retraced_pct <= 35 THEN 4 ELSE 0 END ELSE 0 END) END AS pp FROM e)
SELECT symbol_id, family, state, signal_date, tier, {r('CAST(ps AS DOUBLE)', 'pattern_score')}, {r('CAST(pp AS DOUBLE)', 'priority_score')}, row_number() OVER (ORDER BY round(ps, 9) DESC, {ORDER}) AS pattern_rank, row_number() OVER (ORDER BY round(pp, 9) DESC, round(ps, 9) DESC, {ORDER}) AS priority_rank FROM f""")

# --- the life of signals: three runs in a row ------------------------------------------------------------------
DAYS = ("1999-06-30", "1999-07-09", "1999-07-30")
LIFE = "symbol_id, family, state, signal_date, level, invalidation, pattern_score, lifecycle, as_of_date, first_seen_date, last_seen_date, invalidated_date, expired_date, carried_bars"


def three_runs(s, d):
    rows = walks(s, d)
    signals = sh.shapes(rows, "flag", "double_bottom", "ascending_base").filter("state = 'confirmed'").withColumns({"state": F.when(F.col("symbol_id") % 2 == 0, "watchlist").otherwise("confirmed"), "pattern_score": F.round("quality", 6)})
    signals = kept(signals.filter(F.col("signal_date").between("1999-05-01", "1999-07-30")))
    history = s.createDataFrame([], "symbol_id long, family string, state string, signal_date date, level double, invalidation double, pattern_score double, lifecycle string, as_of_date date, first_seen_date date, last_seen_date date, invalidated_date date, expired_date date, carried_bars int")
    last = lambda day: F.max_by(F.when(F.col("trade_date") <= day, F.col("close")), F.when(F.col("trade_date") <= day, F.col("trade_date")))
    known = kept(rows.groupBy("symbol_id").agg(*[last(day).alias(day) for day in DAYS], F.min("trade_date").alias("_first")))
    for day in DAYS:
        fresh = signals.filter((F.col("signal_date") <= day) & (F.col("signal_date") > F.date_sub(F.lit(day).cast("date"), 14 if day != DAYS[0] else 60)))
        closes = known.filter(F.col("_first") <= day).select("symbol_id", F.col(f"`{day}`").alias("close"))
        history = kept(sc.advance(history, fresh, closes, day))
    return history


def run_sql(k: int) -> str:
    day, prev = f"DATE '{DAYS[k]}'", f"h{k - 1}" if k else "none"
    bdays = lambda a: f"CASE WHEN {a} IS NULL THEN 10000 WHEN {day} <= {a} THEN 0 ELSE len(list_filter(generate_series(CAST({a} AS TIMESTAMP), CAST({day} AS TIMESTAMP), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) - 1 END"
    return f"""f{k} AS (SELECT * FROM sg WHERE signal_date <= {day} AND signal_date > {day} - {14 if k else 60} QUALIFY row_number() OVER (PARTITION BY symbol_id, family ORDER BY pattern_score DESC, signal_date DESC, state) = 1),
c{k} AS (SELECT symbol_id, max_by(close, trade_date) AS close FROM walks WHERE trade_date <= {day} GROUP BY 1), o{k} AS (SELECT p.*, close, {bdays('last_seen_date')} AS unseen, {bdays('invalidated_date')} AS dead FROM {prev} p LEFT JOIN c{k} USING (symbol_id) WHERE NOT EXISTS (SELECT 1 FROM f{k} f WHERE f.symbol_id = p.symbol_id AND f.family = p.family) AND lifecycle <> 'expired'),
q{k} AS (SELECT *, CASE WHEN lifecycle <> 'invalidated' AND close <= invalidation THEN 'invalidated' WHEN lifecycle = 'watchlist' AND unseen >= 10 OR lifecycle = 'confirmed' AND unseen >= 20 OR lifecycle = 'invalidated' AND dead >= 5 THEN 'expired' ELSE lifecycle END AS life FROM o{k}),
h{k} AS (SELECT f.symbol_id, f.family, f.state, f.signal_date, f.level, f.invalidation, f.pattern_score, f.state AS lifecycle, {day} AS as_of_date, coalesce(p.first_seen_date, f.signal_date) AS first_seen_date, {day} AS last_seen_date, CAST(NULL AS DATE) AS invalidated_date, CAST(NULL AS DATE) AS expired_date, 0 AS carried_bars FROM f{k} f LEFT JOIN {prev} p ON p.symbol_id = f.symbol_id AND p.family = f.family
UNION ALL SELECT symbol_id, family, state, signal_date, level, invalidation, pattern_score, life, {day}, first_seen_date, last_seen_date, CASE WHEN life = 'invalidated' THEN coalesce(invalidated_date, {day}) ELSE invalidated_date END, CASE WHEN life = 'expired' THEN {day} END, carried_bars + 1 FROM q{k})"""


NONE = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in zip(LIFE.split(", "), ["BIGINT", "VARCHAR", "VARCHAR", "DATE", "DOUBLE", "DOUBLE", "DOUBLE", "VARCHAR", *["DATE"] * 5, "INTEGER"], strict=True))
R.add("pt24_lifecycle", three_runs, "pts", f"""WITH sg AS MATERIALIZED (SELECT symbol_id, family, CASE WHEN symbol_id % 2 = 0 THEN 'watchlist' ELSE 'confirmed' END AS state, signal_date, level, invalidation, quality AS pattern_score FROM (SELECT {', '.join(COLUMNS)} FROM ({flags('flag', 20, 12, 38, '', 1.5, 2)}) UNION ALL SELECT {', '.join(COLUMNS)} FROM ({DOUBLE}) UNION ALL SELECT {', '.join(COLUMNS)} FROM ({BASE})) WHERE state = 'confirmed'),
none AS (SELECT {NONE} WHERE false), {', '.join(run_sql(k) for k in range(3))} SELECT {LIFE} FROM h0 UNION ALL SELECT {LIFE} FROM h1 UNION ALL SELECT {LIFE} FROM h2""")

# --- structure and context at a date ----------------------------------------------------------------------------
AS_OF = "2000-06-30"
FULL = lambda n, least, c="close": f"CASE WHEN count(close) {frame(n)} >= {least} THEN avg({c}) {frame(n)} END"
LAG = lambda c, n=1: f"lag({c}, {n}) {W}"


def structure_sql(source: str) -> str:
    """SQL of the structure of bars that have near, rs and vr (all known)."""
    slopes = ", ".join(f"100 * (sma_{n} / nullif({LAG(f'sma_{n}', 20)}, 0) - 1) AS slope{n}" for n in (50, 150, 200))
    points = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in [("close > sma_150", 15), ("close > sma_200", 15), ("sma_150 > sma_200", 15), ("slope200 > 0", 15), ("near <= 25", 10), ("near <= 15", 10), ("rs >= 70", 10), ("rs >= 85", 10), ("vr > 1.2", 10)])
    gate = [("below_sma150", "n150 >= 150 AND close > sma_150"), ("below_sma200", "n200 >= 200 AND close > sma_200"), ("sma150_below_sma200", "n200 >= 200 AND sma_150 > sma_200"), ("sma200_slope_negative", "n200 >= 200 AND slope200 > 0"), ("far_from_52w_high", "near <= 25")]
    hard = ", ".join(f"CASE WHEN coalesce({c}, false) THEN NULL ELSE '{name}' END" for name, c in gate)
    soft = "CASE WHEN rs < 70 THEN 'rs_below_70th_pctile' WHEN rs < 85 THEN 'rs_below_85th_pctile' END, CASE WHEN vr <= 1.2 THEN 'weak_volume' END, CASE WHEN near > 15 THEN 'not_near_breakout_zone' END"
    return f"""t1 AS (SELECT *, {FULL(20, 20)} AS sma_20, {FULL(50, 50)} AS sma_50, {FULL(150, 100)} AS sma_150, {FULL(200, 100)} AS sma_200, count(close) {frame(150)} AS n150, count(close) {frame(200)} AS n200, row_number() {W} AS rn FROM {source}),
t2 AS (SELECT *, {slopes}, 100 * (sma_50 / nullif(sma_200, 0) - 1) AS gap, 100 * (sma_20 / nullif(sma_50, 0) - 1) AS gap2 FROM t1), t3 AS (SELECT *, gap - {LAG('gap', 5)} AS d5, gap - {LAG('gap', 20)} AS d20, gap - {LAG('gap', 60)} AS d60, gap2 - {LAG('gap2', 10)} AS d10, {LAG('gap')} AS pg FROM t2),
t4 AS (SELECT *, CASE WHEN gap >= 0 THEN rn - max(CASE WHEN gap >= 0 AND pg < 0 THEN rn END) OVER (PARTITION BY symbol_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS since FROM t3),
st AS (SELECT *, coalesce(gap < 0 AND pg >= 0 AND {LAG('since')} <= 20, false) AS golden_cross_failed, CAST(least(100, {points}) AS DOUBLE) AS stage2_score, list_filter([{hard}], lambda x: x IS NOT NULL) AS hard, list_filter([{soft}], lambda x: x IS NOT NULL) AS soft FROM t4)"""


LABEL = "CASE WHEN len(hard) = 0 AND stage2_score >= 85 THEN 'strong_stage2' WHEN len(hard) = 0 AND stage2_score >= 70 THEN 'stage2' WHEN len(hard) > 0 AND stage2_score >= 50 THEN 'stage1_to_stage2' ELSE 'non_stage2' END"
NEAR = f"coalesce(greatest(0, least(100, 100 * (1 - close / nullif(CASE WHEN count(*) {frame(252)} >= 20 THEN max(high) {frame(252)} END, 0)))), 999) AS near, coalesce(volume / nullif(CASE WHEN count(*) {frame(20, 1)} >= 10 THEN avg(volume) {frame(20, 1)} END, 0), 1) AS vr"


def placed_rows(s, d):
    rows = walks(s, d)
    high, volume = full(F.max("high").over(trailing(252)), trailing(252), 20), full(F.avg("volume").over(trailing(20, skip=1)), trailing(20, skip=1), 10)
    return rows.withColumns({"near_52w_high_pct": clip(100 * (1 - ratio(F.col("close"), high)), 0, 100), "volume_ratio_20": ratio(F.col("volume"), volume), "rel_strength_score": (F.col("symbol_id") * 7 % 100).cast("double")})


GAPS = {"sma50_slope_20d_pct": "slope50", "sma150_slope_20d_pct": "slope150", "sma200_slope_20d_pct": "slope200", "sma50_sma200_gap_pct": "gap", "sma50_sma200_gap_delta_5d": "d5", "sma50_sma200_gap_delta_20d": "d20", "sma50_sma200_gap_delta_60d": "d60", "sma20_sma50_gap_pct": "gap2", "sma20_sma50_gap_delta_10d": "d10"}
R.add("ti19_structure", lambda s, d: sc.stage2_structure(placed_rows(s, d)).select("symbol_id", "trade_date", *GAPS, F.col("golden_cross_days_since").cast("long").alias("golden_cross_days_since"), "golden_cross_failed", "stage2_score", "is_stage2_structural", "stage2_label", "stage2_hard_fail_reason", "stage2_fail_reason"), "walks", f"""WITH x AS (SELECT *, {NEAR}, symbol_id * 7 % 100 AS rs FROM walks), {structure_sql('x')}
SELECT symbol_id, trade_date, {', '.join(r(v, k) for k, v in GAPS.items())}, since AS golden_cross_days_since, golden_cross_failed, stage2_score, len(hard) = 0 AS is_stage2_structural, {LABEL} AS stage2_label, array_to_string(hard, ',') AS stage2_hard_fail_reason, array_to_string(hard || soft, ',') AS stage2_fail_reason FROM st""")

CONTEXT = ["symbol_id", "bar_count", "close", "ohlcv_valid_ratio", "continuity_ratio", "median_turnover", "median_volume", "rel_strength_score", "liquidity_percentile", "range_contraction_ratio", "volume_dry_up_ratio", "base_depth_pct", "pivot_distance_pct", "rs_trend_delta_pct", "stage2_score", "stage2_label", "weekly_stage", "weekly_stage_transition", "weekly_stage_age", "weekly_fresh", "standard_gate", "early_failed", "early_gate", "liquidity_gate", "base_failed", "base_structure", "stage2_valid"]


def listings(s, d):
    """Walks of which every fifth symbol has its last 45 bars at the date alone, and every other fifth its last 110."""
    past = F.col("trade_date") <= AS_OF
    of = Window.partitionBy("symbol_id")
    keep = F.when(F.col("symbol_id") % 5 == 0, 45).when(F.col("symbol_id") % 5 == 1, 110).otherwise(100_000)
    back = F.count_if(past).over(of) - F.row_number().over(of.orderBy("trade_date")) + 1
    return walks(s, d).withColumn("_b", back).filter(~past | (F.col("_b") <= keep)).drop("_b")


def at_date(s, d):
    weekly = walks(s, d).groupBy("symbol_id", F.next_day(F.date_sub("trade_date", 1), "Fri").alias("week_end")).agg(F.count("*").alias("n")).select("symbol_id", "week_end", F.when(F.col("symbol_id") % 3 == 0, "S1").otherwise("S2").alias("stage"), F.when(F.col("symbol_id") % 4 == 1, "S1_TO_S2").alias("transition"))
    gone = master(s, d).filter("symbol_id % 6 = 0").select((F.col("symbol_id") * 8).alias("symbol_id"), F.lit("1999-01-01").cast("date").alias("effective_from"), F.when(F.col("symbol_id") % 12 == 0, F.lit("1999-12-31").cast("date")).alias("effective_to"))
    return sc.context(listings(s, d), AS_OF, weekly, gone, early={**sc.EARLY, "turnover": 50_000.0, "volume": 500.0, "missing": 0.9, "continuity": 0.1})


MID = lambda value, a, b: f"quantile_cont(CASE WHEN back BETWEEN {a} AND {b} THEN {value} END, 0.5)"
RET = lambda h: f"coalesce(CASE WHEN {LAG('close', h)} > 0 THEN close / {LAG('close', h)} - 1 END, 0) AS ret{h}"
CHECKS = [("bar_band", "bar_count BETWEEN 35 AND 49"), ("missing_sessions", "1 - continuity_ratio <= 0.9"), ("median_turnover", "median_turnover >= 50000"), ("median_volume", "median_volume >= 500"), ("minimum_close", "close >= 20"), ("estimation_sessions", "bar_count >= 20"), ("continuity", "continuity_ratio >= 0.1"), ("ohlcv_quality", "ohlcv_valid_ratio >= 1"), ("latest_session", "last_day = final_day"), ("no_exclusion", "NOT bad")]
SOLID = [("sma150_band", "abs(close / sma_150 - 1) <= 0.15"), ("sma150_flat", "abs(slope150) <= 2"), ("base_depth", "base_depth_pct <= 35"), ("range_contraction", "range_contraction_ratio <= 0.9"), ("pivot_proximity", "pivot_distance_pct <= 10"), ("rs_trend", "rs_trend_delta_pct >= 0"), ("volume_dry_up", "volume_dry_up_ratio <= 0.9"), ("long_term_not_deteriorating", "close / sma_200 >= 0.85 AND slope200 >= -1")]
FAILS = lambda checks: "list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, false) THEN NULL ELSE '{n}' END" for n, c in checks) + "], lambda x: x IS NOT NULL)"
SQL["ctx"] = f"""WITH w0 AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY trade_date DESC) AS back FROM walks WHERE trade_date <= DATE '{AS_OF}'), w1 AS (SELECT *, {RET(20)}, {RET(60)}, {RET(120)} FROM w0 WHERE back <= CASE symbol_id % 5 WHEN 0 THEN 45 WHEN 1 THEN 110 ELSE 100000 END),
l AS (SELECT symbol_id, 20 * {pct('ret20', '1')} + 50 * {pct('ret60', '1')} + 30 * {pct('ret120', '1')} AS rs, {pct('close * volume', '1')} AS liq FROM w1 WHERE back = 1), x AS (SELECT w1.*, rs, liq, {NEAR} FROM w1 JOIN l USING (symbol_id)), {structure_sql('x')},
g AS (SELECT symbol_id, count(*) AS bar_count, count(DISTINCT trade_date) AS seen, min(trade_date) AS first_day, max(trade_date) AS last_day, max(CASE WHEN back = 1 THEN close END) AS close, max(CASE WHEN back = 21 THEN close END) AS c21, max(CASE WHEN back = 61 THEN close END) AS c61, avg(CASE WHEN high >= greatest(open, close, low) AND low <= least(open, close, high) AND least(open, high, low, close) > 0 THEN 1.0 ELSE 0 END) AS ohlcv_valid_ratio,
{MID('close * volume', 1, 20)} AS median_turnover, {MID('volume', 1, 20)} AS median_volume, max(CASE WHEN back <= 65 THEN high END) AS hi, min(CASE WHEN back <= 65 THEN low END) AS lo, {MID('high - low', 1, 20)} / {MID('high - low', 21, 40)} AS range_contraction_ratio, {MID('volume', 1, 20)} / {MID('volume', 21, 40)} AS volume_dry_up_ratio,
{', '.join(f'max(CASE WHEN back = 1 THEN {a} END) AS {b}' for a, b in (('sma_150', 'sma_150'), ('sma_200', 'sma_200'), ('slope150', 'slope150'), ('slope200', 'slope200'), ('stage2_score', 'stage2_score'), (LABEL, 'stage2_label'), ('CASE WHEN len(hard) = 0 THEN 1 ELSE 0 END', 'solid'), ('rs', 'rel_strength_score'), ('liq', 'liquidity_percentile')))} FROM st GROUP BY 1),
days AS (SELECT DISTINCT trade_date AS day FROM w1), wk AS (SELECT symbol_id, max(CAST(trade_date + CAST((12 - isodow(trade_date)) % 7 AS INTEGER) AS DATE)) AS week_end FROM (SELECT * FROM walks WHERE CAST(trade_date + CAST((12 - isodow(trade_date)) % 7 AS INTEGER) AS DATE) <= DATE '{AS_OF}') GROUP BY 1),
h AS (SELECT g.*, seen / (SELECT count(*) FROM days WHERE day >= first_day) AS continuity_ratio, 100 * (hi - lo) / nullif(hi, 0) AS base_depth_pct, 100 * greatest(0, hi - close) / nullif(hi, 0) AS pivot_distance_pct, 100 * ((close / c21 - 1) - (close / c61 - 1)) AS rs_trend_delta_pct, (SELECT max(day) FROM days) AS final_day,
coalesce((SELECT true FROM supplier WHERE s_suppkey * 8 = g.symbol_id AND s_suppkey % 6 = 0 AND s_suppkey % 12 <> 0), false) AS bad, CASE WHEN week_end IS NULL THEN NULL WHEN g.symbol_id % 3 = 0 THEN 'S1' ELSE 'S2' END AS weekly_stage, CASE WHEN week_end IS NOT NULL AND g.symbol_id % 4 = 1 THEN 'S1_TO_S2' ELSE 'NONE' END AS weekly_stage_transition, CASE WHEN week_end IS NOT NULL THEN (SELECT count(*) FROM days WHERE day > week_end) END AS weekly_stage_age FROM g LEFT JOIN wk USING (symbol_id)),
i AS (SELECT *, coalesce(weekly_stage_age <= 10, false) AS weekly_fresh, coalesce(bar_count >= 50 AND close >= 20 AND liquidity_percentile >= 0.2 AND NOT bad, false) AS standard_gate, {FAILS(CHECKS)} AS early_failed, {FAILS(SOLID)} AS base_failed FROM h)
SELECT *, len(early_failed) = 0 AS early_gate, CASE WHEN bar_count < 50 THEN len(early_failed) = 0 ELSE standard_gate END AS liquidity_gate, len(base_failed) = 0 AS base_structure, coalesce(bar_count >= 200 AND solid = 1 AND sma_150 IS NOT NULL AND slope200 IS NOT NULL, false) AS stage2_valid FROM i"""
NEEDS["ctx"] = ["walks"]
ROUNDED = {"close", "ohlcv_valid_ratio", "continuity_ratio", "median_turnover", "median_volume", "rel_strength_score", "liquidity_percentile", "range_contraction_ratio", "volume_dry_up_ratio", "base_depth_pct", "pivot_distance_pct", "rs_trend_delta_pct"}
R.add("pt34_context", lambda s, d: at_date(s, d).withColumn("weekly_stage_age", F.col("weekly_stage_age").cast("long")).select(*CONTEXT), "ctx", f"SELECT {', '.join(r(f'CAST({c} AS DOUBLE)', c) if c in ROUNDED else c for c in CONTEXT)} FROM ctx")
R.add("pt33_lanes", lambda s, d: sc.lanes(at_date(s, d)).select("symbol_id", "bar_count", "lane", "history_band", "lane_reasons"), "ctx", """WITH a AS (SELECT *, stage2_valid AND stage2_score >= 70 AS two, weekly_fresh AND base_structure AND weekly_stage = 'S1' AS one, weekly_fresh AND base_structure AND weekly_stage_transition = 'S1_TO_S2' AS turning FROM ctx)
SELECT symbol_id, bar_count, CASE WHEN bar_count BETWEEN 35 AND 49 AND early_gate THEN 'ipo_early_base' WHEN bar_count >= 50 AND standard_gate THEN CASE WHEN bar_count < 180 THEN 'young_listing_base' WHEN two THEN 'stage2_continuation' WHEN one OR turning THEN 'stage1_base' ELSE 'no_lane' END ELSE 'no_lane' END AS lane,
CASE WHEN bar_count < 35 THEN 'under_35' WHEN bar_count < 50 THEN '35_49' WHEN bar_count < 120 THEN '50_119' WHEN bar_count < 180 THEN '120_179' ELSE '180_plus' END AS history_band,
CASE WHEN bar_count < 35 THEN ['INSUFFICIENT_HISTORY'] WHEN bar_count < 50 THEN CASE WHEN early_gate THEN ['AGE_35_49_EARLY_IPO_LIQUIDITY_PASS'] ELSE ['EARLY_IPO_LIQUIDITY_FAIL'] END WHEN NOT standard_gate THEN ['STANDARD_LIQUIDITY_FAIL'] WHEN bar_count < 180 THEN ['AGE_50_179_STANDARD_LIQUIDITY_PASS'] WHEN two THEN ['MATURE_STAGE2_INPUTS_VALID', 'STAGE2_SCORE_THRESHOLD_PASS']
WHEN one THEN ['FRESH_WEEKLY_STAGE1', 'STAGE1_STRUCTURE_PASS'] WHEN turning THEN ['FRESH_WEEKLY_STAGE1_TRANSITION', 'STAGE1_STRUCTURE_PASS'] ELSE ['MATURE_STRUCTURE_NOT_ELIGIBLE'] END AS lane_reasons FROM a""")
