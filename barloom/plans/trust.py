"""Queries of data quality (DQ), corporate actions (CA) and point-in-time operators (PIT) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.stats import along
from barloom.operators import actions as ca
from barloom.operators import asof as pit
from barloom.operators import quality as dq
from barloom.operators import ranking as rk
from barloom.plans.kit import SQL, Registry
from barloom.plans.ranks import LATEST
from barloom.plans.technical import W, frame, r
from barloom.sources.bars import bars, fundamentals, master, table

R = Registry()
D = lambda x: F.to_date(F.lit(x))
END = "DATE '2001-11-15'"

SQL |= {
    "prov": "SELECT *, CASE WHEN day(trade_date) % 5 = 0 THEN 'fallback' WHEN day(trade_date) % 11 = 0 THEN NULL ELSE 'primary' END AS provider, CASE WHEN month(trade_date) % 6 = 0 THEN 'special' ELSE 'regular' END AS segment FROM bars",
    "quar": "SELECT s_suppkey AS symbol_id, s_suppkey % 3 = 0 AS active, CAST(DATE '1999-01-01' + CAST((s_suppkey % 1200) AS INTEGER) AS DATE) AS from_date FROM supplier",
    "other": "SELECT symbol_id, trade_date, CASE WHEN day(trade_date) % 7 = 0 THEN close * 1.5 ELSE close END AS close FROM bars WHERE day(trade_date) % 10 <> 3",
    "act": "SELECT s_suppkey AS symbol_id, CAST(DATE '1998-06-01' + CAST((s_suppkey % 300) * k AS INTEGER) AS DATE) AS ex_date, 1.0 / (1 + k) AS price_factor FROM supplier, (VALUES (1), (2)) AS t(k)",
}
from barloom.plans.kit import NEEDS  # noqa: E402

NEEDS |= {"prov": ["bars"], "other": ["bars"]}


def prov(s, d):
    day = F.dayofmonth("trade_date")
    return bars(s, d).withColumns({"provider": F.when(day % 5 == 0, "fallback").when(day % 11 == 0, F.lit(None)).otherwise("primary"), "segment": F.when(F.month("trade_date") % 6 == 0, "special").otherwise("regular")})


def quar(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("symbol_id"), (k % 3 == 0).alias("active"), F.date_add(D("1999-01-01"), (k % 1200).cast("int")).alias("from_date"))


def other(s, d):
    day = F.dayofmonth("trade_date")
    return bars(s, d).filter(day % 10 != 3).select("symbol_id", "trade_date", F.when(day % 7 == 0, F.col("close") * 1.5).otherwise(F.col("close")).alias("close"))


def act(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("symbol_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("symbol_id", F.date_add(D("1998-06-01"), ((F.col("symbol_id") % 300) * F.col("k")).cast("int")).alias("ex_date"), (1.0 / (1 + F.col("k"))).alias("price_factor"))


def broken(s, d):
    """Bars with some made invalid."""
    day = F.dayofmonth("trade_date")
    return bars(s, d).withColumns({"close": F.when(day != 9, F.col("close")), "high": F.when(day == 4, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(day == 6, -F.col("volume")).otherwise(F.col("volume"))})


BROKEN = "broken AS (SELECT symbol_id, trade_date, open, low, delivery_pct, CASE WHEN day(trade_date) <> 9 THEN close END AS close, CASE WHEN day(trade_date) = 4 THEN low - 1 ELSE high END AS high, CASE WHEN day(trade_date) = 6 THEN -volume ELSE volume END AS volume FROM bars)"
VIOL = "concat_ws(',', CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'null_price' END, CASE WHEN coalesce(volume, 0) < 0 THEN 'volume' END, CASE WHEN high < greatest(open, close, low) THEN 'high' END, CASE WHEN low > least(open, close, high) THEN 'low' END)"
MOVE = f"m AS (SELECT *, close / nullif(lag(close) {W}, 0) - 1 AS move FROM bars)"
KEY = ["symbol_id", "trade_date"]

R.add("dq1_bar_violations", lambda s, d: dq.bar_violations(broken(s, d)).select(*KEY, "violations"), "bars", f"WITH {BROKEN} SELECT symbol_id, trade_date, {VIOL} AS violations FROM broken")
R.add("dq2_delivery_violations", lambda s, d: dq.delivery_violations(broken(s, d).withColumn("delivery_pct", F.col("delivery_pct") + F.when(F.dayofmonth("trade_date") == 2, 50.0).otherwise(0.0))).select(*KEY, "violations"), "bars", f"WITH {BROKEN}, x AS (SELECT *, delivery_pct + CASE WHEN day(trade_date) = 2 THEN 50 ELSE 0 END AS dp FROM broken) SELECT symbol_id, trade_date, concat_ws(',', CASE WHEN dp IS NULL OR dp < 0 OR dp > 100 THEN 'delivery_pct' END, CASE WHEN coalesce(volume, 0) < 0 THEN 'volume' END) AS violations FROM x")
R.add("dq3_rule_table", lambda s, d: dq.rule_table(broken(s, d)), "bars", f"""WITH {BROKEN} SELECT 'null_fields' AS rule, count(*) FILTER (WHERE close IS NULL OR open IS NULL) AS failed FROM broken UNION ALL SELECT 'ohlc', count(*) FILTER (WHERE high < low OR high < close OR low > close) FROM broken
UNION ALL SELECT 'negative_volume', count(*) FILTER (WHERE volume < 0) FROM broken UNION ALL SELECT 'wide_range', count(*) FILTER (WHERE high / nullif(low, 0) > 2) FROM broken UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM broken GROUP BY symbol_id, trade_date HAVING count(*) > 1)""")
R.add("dq4_jump_days", lambda s, d: dq.jump_days(bars(s, d)), "bars", f"""WITH {MOVE}, a AS (SELECT trade_date, count(*) AS n, quantile_cont(abs(move), 0.5) AS med, avg(CASE WHEN abs(move) > 0.3 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN abs(move) > 0.5 THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN abs(move) > 1 THEN 1.0 ELSE 0 END) AS c FROM m WHERE move IS NOT NULL GROUP BY trade_date)
SELECT trade_date, n, {r('med', 'median_move')}, {r('a', 'over_30')}, {r('b', 'over_50')}, {r('c', 'over_100')}, n >= 3 AND med > 0.1 AS flagged FROM a""")
R.add("dq5_provider_shares", lambda s, d: dq.provider_shares(prov(s, d)), "prov", f"WITH x AS (SELECT * FROM prov WHERE trade_date = (SELECT max(trade_date) FROM prov)), y AS (SELECT count(*) AS n, avg(CASE WHEN provider = 'primary' THEN 1.0 WHEN provider IS NOT NULL THEN 0 END) AS p, avg(CASE WHEN provider = 'fallback' THEN 1.0 WHEN provider IS NOT NULL THEN 0 END) AS f, avg(CASE WHEN provider IS NULL THEN 1.0 ELSE 0 END) AS u FROM x) SELECT n, {r('p', 'primary_share')}, {r('f', 'fallback_share')}, {r('u', 'unknown_share')}, p < 0.7 AS low FROM y")
R.add("dq6_unadjusted_gaps", lambda s, d: dq.unadjusted_gaps(bars(s, d), act(s, d).select("symbol_id", "ex_date")), "bars act", f"WITH {MOVE} SELECT symbol_id, trade_date, {r('move', 'move')}, ex_date FROM m JOIN act USING (symbol_id) WHERE abs(move) >= 0.3 AND abs(trade_date - ex_date) <= 3")
R.add("dq7_segment_drift", lambda s, d: dq.segment_drift(prov(s, d), D("2001-07-04")), "prov", f"WITH x AS (SELECT DATE '2001-07-04' - trade_date AS age, CASE WHEN segment <> 'regular' THEN 1.0 ELSE 0 END AS o FROM prov), y AS (SELECT avg(CASE WHEN age >= 0 AND age < 7 THEN o END) AS a, avg(CASE WHEN age >= 7 AND age < 37 THEN o END) AS b FROM x) SELECT {r('a', 'recent')}, {r('b', 'prior')}, {r('a - b', 'delta')}, coalesce(abs(a - b) > 0.05, false) AS drift FROM y")
CRIT = f"crit AS (SELECT symbol_id, quantile_cont(close * volume, 0.5) AS median_value, count(*) AS days FROM bars WHERE {END} - trade_date BETWEEN 0 AND 365 GROUP BY symbol_id HAVING count(*) >= 10 ORDER BY round(quantile_cont(close * volume, 0.5), 6) DESC, symbol_id LIMIT 20)"
crit = lambda s, d: dq.critical_universe(bars(s, d), 20, D("2001-11-15"))
R.add("dq8_quarantine_state", lambda s, d: dq.quarantine_state(crit(s, d), quar(s, d)), "bars quar", f"WITH {CRIT}, x AS (SELECT count(*) AS universe, count(*) FILTER (WHERE active) AS quarantined FROM crit LEFT JOIN quar USING (symbol_id)) SELECT universe, quarantined, quarantined > 0.1 * universe AS blocked FROM x")
R.add("dq9_sector_coverage", lambda s, d: dq.sector_coverage(master(s, d).withColumn("sector", F.when(F.col("symbol_id") % 8 != 0, F.col("sector")))), "master", f"WITH x AS (SELECT avg(CASE WHEN symbol_id % 8 = 0 OR sector IS NULL THEN 1.0 ELSE 0 END) AS a FROM master) SELECT {r('a', 'missing_share')}, a > 0.1 AS failed FROM x")
R.add("dq10_basis_shifts", lambda s, d: dq.basis_shifts(bars(s, d)), "bars", f"WITH {MOVE} SELECT trade_date, count(DISTINCT symbol_id) AS symbols, {r('quantile_cont(abs(move), 0.5)', 'median_gap')}, {r('max(abs(move))', 'max_gap')} FROM m WHERE abs(move) >= 0.3 GROUP BY trade_date HAVING count(DISTINCT symbol_id) >= 2")
R.add("dq11_reconcile_providers", lambda s, d: dq.reconcile_providers(bars(s, d).select(*KEY, "close"), other(s, d)), "bars other", "SELECT symbol_id, trade_date, round(b.close, 6) AS close, CASE WHEN abs(b.close - o.close) > 0 THEN 0.8 WHEN o.close IS NOT NULL THEN 1.0 END AS confidence, CASE WHEN abs(b.close - o.close) > 0 THEN 'differs' END AS note FROM bars b LEFT JOIN other o USING (symbol_id, trade_date)")
R.add("dq12_trust_summary", lambda s, d: dq.trust_summary(prov(s, d), quar(s, d)), "prov quar", f"WITH x AS (SELECT trade_date, count(*) AS n, avg(CASE WHEN provider = 'fallback' THEN 1.0 WHEN provider IS NOT NULL THEN 0 END) AS f, count(*) FILTER (WHERE active) AS q FROM prov LEFT JOIN quar USING (symbol_id) GROUP BY trade_date) SELECT trade_date, n, {r('f', 'fallback_ratio')}, q AS quarantined, CASE WHEN q > 0.5 * n THEN 'blocked' WHEN f > 0.2 THEN 'degraded' ELSE 'trusted' END AS status FROM x")
R.add("dq13_critical_universe", crit, "bars", f"WITH {CRIT} SELECT symbol_id, {r('median_value', 'median_value')}, days FROM crit")
R.add("dq14_stale_quarantine", lambda s, d: dq.stale_quarantine(quar(s, d), bars(s, d).filter("trade_date < '2000-06-01'"), D("2001-11-15")), "bars quar", f"WITH l AS (SELECT symbol_id, max(trade_date) AS last_ FROM bars WHERE trade_date < DATE '2000-06-01' GROUP BY symbol_id) SELECT symbol_id, min(from_date) AS since FROM quar LEFT JOIN l USING (symbol_id) WHERE active AND {END} - from_date > 30 AND (last_ IS NULL OR last_ < from_date) GROUP BY symbol_id")
R.add("dq15_trust_state", lambda s, d: dq.trust_state(prov(s, d).filter("provider is not null"), quar(s, d)), "prov quar", "WITH x AS (SELECT symbol_id, provider, trade_date FROM prov WHERE provider IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY trade_date DESC) = 1) SELECT symbol_id, provider, trade_date AS last_date, coalesce(active, false) AS quarantined FROM x LEFT JOIN quar USING (symbol_id)")
R.add("dq16_compare_bars", lambda s, d: dq.compare_bars(bars(s, d).filter(F.dayofmonth("trade_date") != 20), other(s, d)), "bars other", "WITH x AS (SELECT coalesce(b.symbol_id, o.symbol_id) AS symbol_id, CASE WHEN b.symbol_id IS NULL THEN 'missing' WHEN o.symbol_id IS NULL THEN 'extra' WHEN b.close IS NOT DISTINCT FROM o.close THEN 'match' ELSE 'mismatch' END AS k FROM (SELECT * FROM bars WHERE day(trade_date) <> 20) b FULL OUTER JOIN other o ON b.symbol_id = o.symbol_id AND b.trade_date = o.trade_date) SELECT symbol_id, count(*) FILTER (WHERE k = 'missing') AS missing, count(*) FILTER (WHERE k = 'extra') AS extra, count(*) FILTER (WHERE k = 'mismatch') AS mismatch, count(*) FILTER (WHERE k = 'match') AS match FROM x GROUP BY symbol_id")
R.add("dq17_shift_score", lambda s, d: dq.shift_score(bars(s, d), other(s, d), 1), "bars other", f"WITH h AS (SELECT b.symbol_id, count(*) AS h FROM bars b JOIN other o ON b.symbol_id = o.symbol_id AND o.trade_date = b.trade_date + 1 GROUP BY b.symbol_id), a AS (SELECT symbol_id, count(*) AS a FROM bars GROUP BY symbol_id), b AS (SELECT symbol_id, count(*) AS b FROM other GROUP BY symbol_id) SELECT symbol_id, {r('coalesce(h, 0) * 1.0 / least(a, b)', 'score')} FROM a JOIN b USING (symbol_id) LEFT JOIN h USING (symbol_id)")
R.add("dq18_scale_ratio", lambda s, d: dq.scale_ratio(bars(s, d), other(s, d)), "bars other", f"SELECT symbol_id, {r('quantile_cont(b.close / nullif(o.close, 0), 0.5)', 'scale')}, count(*) AS n FROM bars b JOIN other o USING (symbol_id, trade_date) GROUP BY symbol_id")
R.add("dq19_stale_symbols", lambda s, d: dq.stale_symbols(bars(s, d), D("2001-10-25"), 300), "bars", "SELECT symbol_id, max(trade_date) AS last_date, count(*) AS n FROM bars GROUP BY symbol_id HAVING max(trade_date) <= DATE '2001-10-25' OR count(*) < 300")
R.add("dq20_readiness", lambda s, d: dq.readiness(bars(s, d), 60).select(*KEY, "ready"), "bars", f"SELECT symbol_id, trade_date, row_number() {W} >= 60 AS ready FROM bars")
R.add("dq21_feature_confidence", lambda s, d: dq.feature_confidence(dq.reconcile_providers(dq.readiness(bars(s, d), 60), other(s, d))).select(*KEY, "feature_confidence"), "bars other", f"WITH x AS (SELECT b.symbol_id, b.trade_date, row_number() OVER (PARTITION BY b.symbol_id ORDER BY b.trade_date) >= 60 AS ready, CASE WHEN abs(b.close - o.close) > 0 THEN 0.8 WHEN o.close IS NOT NULL THEN 1.0 END AS c FROM bars b LEFT JOIN other o USING (symbol_id, trade_date)) SELECT symbol_id, trade_date, CAST(greatest(0.0, least(1.0, CASE WHEN ready THEN 1.0 ELSE 0.0 END, coalesce(c, 1.0))) AS DOUBLE) AS feature_confidence FROM x")
R.add("dq22_feature_coverage", lambda s, d: dq.feature_coverage(rk.returns(bars(s, d), 20), ["ret_20"], D("2001-11-04")), "bars", f"WITH x AS (SELECT trade_date, lag(close, 20) {W} AS p FROM bars), y AS (SELECT avg(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0 END) AS c, max(CASE WHEN p IS NOT NULL THEN trade_date END) AS latest FROM x) SELECT {r('c', 'coverage')}, latest, c < 0.8 AS low_coverage, latest < DATE '2001-11-04' AS stale FROM y")
R.add("dq23_compare_cells", lambda s, d: dq.compare_cells(bars(s, d).select(*KEY, F.col("close").alias("value")), other(s, d).withColumnRenamed("close", "value"), KEY, 0.01), "bars other", "SELECT CASE WHEN b.close IS NULL THEN 'missing_left' WHEN o.close IS NULL THEN 'missing_right' WHEN abs(b.close - o.close) > 0.01 THEN 'mismatch' ELSE 'match' END AS kind, count(*) AS n FROM bars b FULL OUTER JOIN other o ON b.symbol_id = o.symbol_id AND b.trade_date = o.trade_date GROUP BY 1")


def subjects(s, d):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Bonus "), (k % 4 + 1).cast("string"), F.lit(":"), (k % 5 + 1).cast("string"))).when(k % 3 == 1, F.concat(F.lit("Sub-division from Rs 10 to Re "), (k % 4 + 1).cast("string"))).otherwise("Dividend 5")
    return table(s, d, "supplier").select(k.alias("symbol_id"), text.alias("subject"))


R.add("ca1_parse_actions", lambda s, d: ca.parse_actions(subjects(s, d)), "", f"WITH x AS (SELECT s_suppkey AS symbol_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Bonus ' || (s_suppkey % 4 + 1) || ':' || (s_suppkey % 5 + 1) WHEN s_suppkey % 3 = 1 THEN 'Sub-division from Rs 10 to Re ' || (s_suppkey % 4 + 1) ELSE 'Dividend 5' END AS subject, CASE WHEN s_suppkey % 3 = 0 THEN 'bonus' WHEN s_suppkey % 3 = 1 THEN 'split' END AS action, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 4 + 1 + s_suppkey % 5 + 1) * 1.0 / (s_suppkey % 5 + 1) WHEN s_suppkey % 3 = 1 THEN 10.0 / (s_suppkey % 4 + 1) END AS f FROM supplier) SELECT symbol_id, subject, action, {r('f', 'share_factor')}, {r('1 / f', 'price_factor')} FROM x")
R.add("ca2_reconcile", lambda s, d: ca.reconcile(act(s, d).filter(F.col("symbol_id") % 4 != 0), act(s, d).filter(F.col("symbol_id") % 5 != 0).withColumn("price_factor", F.when(F.col("symbol_id") % 7 == 0, F.lit(0.25)).otherwise(F.col("price_factor"))), ["symbol_id", "ex_date"], "price_factor"), "act", f"WITH f AS (SELECT * FROM act WHERE symbol_id % 4 <> 0), s AS (SELECT symbol_id, ex_date, CASE WHEN symbol_id % 7 = 0 THEN 0.25 ELSE price_factor END AS price_factor FROM act WHERE symbol_id % 5 <> 0) SELECT coalesce(f.symbol_id, s.symbol_id) AS symbol_id, coalesce(f.ex_date, s.ex_date) AS ex_date, {r('coalesce(f.price_factor, s.price_factor)', 'price_factor')}, CASE WHEN s.symbol_id IS NULL THEN 'inserted' WHEN f.symbol_id IS NULL THEN 'deactivated' WHEN f.price_factor = s.price_factor THEN 'unchanged' ELSE 'changed' END AS status FROM f FULL OUTER JOIN s ON f.symbol_id = s.symbol_id AND f.ex_date = s.ex_date AND f.price_factor IS NOT NULL")
R.add("ca3_adjust", lambda s, d: ca.adjust(bars(s, d), act(s, d)).select(*KEY, "factor", "adjusted_close"), "bars act", f"WITH x AS (SELECT b.symbol_id, b.trade_date, b.close, coalesce(exp(sum(ln(price_factor))), 1.0) AS f FROM bars b LEFT JOIN act a ON a.symbol_id = b.symbol_id AND a.ex_date > b.trade_date GROUP BY ALL) SELECT symbol_id, trade_date, {r('f', 'factor')}, {r('close * f', 'adjusted_close')} FROM x")
R.add("ca4_action_set_hash", lambda s, d: ca.action_set_hash(act(s, d)))
R.add("ca5_canonical", lambda s, d: ca.canonical(master(s, d).select("symbol_id"), table(s, d, "supplier").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("symbol_id"), (F.col("s_suppkey") - 1).alias("canonical_id"))), "", "SELECT s_suppkey AS symbol_id, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey - 1 ELSE s_suppkey END AS canonical_id FROM supplier")
R.add("ca6_segment", lambda s, d: table(s, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "BE").when(F.col("l_returnflag") == "A", "EQ").otherwise("XX").alias("series")).withColumn("segment", ca.segment(F.col("series"))).groupBy("series", "segment").agg(F.count("*").alias("n")), "", "SELECT CASE l_returnflag WHEN 'R' THEN 'BE' WHEN 'A' THEN 'EQ' ELSE 'XX' END AS series, CASE l_returnflag WHEN 'R' THEN 'trade_to_trade' WHEN 'A' THEN 'regular' ELSE 'other' END AS segment, count(*) AS n FROM lineitem GROUP BY ALL")
R.add("ca7_one_security", lambda s, d: ca.one_security(table(s, d, "lineitem").select((F.col("l_suppkey") % 40).alias("isin"), F.col("l_suppkey").alias("symbol_id"), F.col("l_returnflag").alias("listing"))).select("isin", F.array_join("listings", ",").alias("listings"), "symbol_id"), "", "SELECT l_suppkey % 40 AS isin, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS listings, min(l_suppkey) AS symbol_id FROM lineitem GROUP BY 1")
R.add("ca8_trading_days", lambda s, d: ca.trading_days(bars(s, d), D("1999-01-01"), D("2000-12-31")), "bars", "SELECT DISTINCT trade_date FROM bars WHERE trade_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'")
R.add("ca9_first_of_month", lambda s, d: ca.first_of_month(bars(s, d).select("trade_date").distinct()), "bars", "SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, min(trade_date) AS first_day FROM bars GROUP BY 1")
HOL = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS holiday FROM orders WHERE day(o_orderdate) = 1)"
R.add("ca10_gap_days", lambda s, d: ca.gap_days(bars(s, d).groupBy("symbol_id").agg(F.max("trade_date").alias("last_date")), D("2001-11-15"), table(s, d, "orders").filter(F.dayofmonth("o_orderdate") == 1).select(F.to_date("o_orderdate").alias("holiday")).distinct()), "bars", f"WITH l AS (SELECT symbol_id, max(trade_date) AS l FROM bars GROUP BY 1), x AS (SELECT symbol_id, CAST(unnest(generate_series(l + INTERVAL 1 DAY, TIMESTAMP '2001-11-15', INTERVAL 1 DAY)) AS DATE) AS day FROM l WHERE l < {END}) SELECT symbol_id, count(*) AS missing FROM x WHERE isodow(day) < 6 AND day NOT IN (SELECT holiday FROM {HOL}) GROUP BY symbol_id")

FU = "SELECT symbol_id, available_at, sales FROM fundamentals"
as_of = lambda s, d, strict=False: pit.as_of_join(bars(s, d).select(*KEY, "close"), fundamentals(s, d).select("symbol_id", "available_at", "sales"), "symbol_id", "trade_date", "available_at", ["sales"], strict)
ASOF = "SELECT b.symbol_id, b.trade_date, round(b.close, 6) AS close, max(f.available_at) AS matched_at, round(arg_max(f.sales, f.available_at), 6) AS sales FROM bars b LEFT JOIN fundamentals f ON f.symbol_id = b.symbol_id AND f.available_at {op} b.trade_date {more} GROUP BY b.symbol_id, b.trade_date, b.close"
R.add("pit1_as_of", as_of, "bars fundamentals", ASOF.format(op="<=", more=""))
R.add("pit2_as_of_cutoff", lambda s, d: pit.as_of_join(bars(s, d).select(*KEY, "close"), fundamentals(s, d).filter("available_at <= '1999-06-30'").select("symbol_id", "available_at", "sales"), "symbol_id", "trade_date", "available_at", ["sales"]), "bars fundamentals", ASOF.format(op="<=", more="AND f.available_at <= DATE '1999-06-30'"))
R.add("pit3_events_as_of", lambda s, d: as_of(s, d, True), "bars fundamentals", ASOF.format(op="<", more=""))
R.add("pit4_known_by", lambda s, d: pit.known_by(fundamentals(s, d).withColumn("published_at", F.col("report_date")).withColumn("available_at", F.when(F.month("report_date") != 3, F.col("available_at"))), D("1999-01-15")).select("symbol_id", "report_date"), "fundamentals", "SELECT symbol_id, report_date FROM fundamentals WHERE CASE WHEN month(report_date) <> 3 THEN available_at ELSE report_date END <= DATE '1999-01-15'")


def memberships(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("symbol_id"), F.to_date("o_orderdate").alias("valid_from"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add(F.to_date("o_orderdate"), 200)).alias("valid_to"), F.date_add(F.to_date("o_orderdate"), 10).alias("recorded_at"), (F.col("o_orderkey") % 4).alias("trust"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") - 1).alias("supersedes"))


MEM = "mem AS (SELECT o_orderkey AS id, o_custkey % 50 AS symbol_id, CAST(o_orderdate AS DATE) AS valid_from, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 200 END AS valid_to, CAST(o_orderdate AS DATE) + 10 AS recorded_at, o_orderkey % 4 AS trust, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 END AS supersedes FROM orders)"
R.add("pit5_membership_at", lambda s, d: pit.membership_at(memberships(s, d), D("1998-01-01"), D("1998-06-01")).select("id", "symbol_id", "trust"), "", f"WITH {MEM} SELECT id, symbol_id, trust FROM mem WHERE recorded_at <= DATE '1998-06-01' AND valid_from <= DATE '1998-01-01' AND (valid_to IS NULL OR valid_to > DATE '1998-01-01') AND id NOT IN (SELECT supersedes FROM mem WHERE recorded_at <= DATE '1998-06-01' AND supersedes IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY trust DESC, recorded_at DESC, id DESC) = 1")
R.add("pit6_resolve_observations", lambda s, d: pit.resolve_observations(memberships(s, d).select("symbol_id", F.col("valid_from").alias("week_end"), F.col("trust").alias("status_rank"), "recorded_at", "id").dropDuplicates(["symbol_id", "week_end", "status_rank"]), memberships(s, d).filter("id % 6 = 0").select("symbol_id", F.col("valid_from").alias("week_end")).distinct(), D("2000-01-01")).select("symbol_id", "week_end", "status_rank"), "", f"WITH {MEM} SELECT symbol_id, valid_from AS week_end, trust AS status_rank FROM mem m WHERE recorded_at <= DATE '2000-01-01' AND NOT EXISTS (SELECT 1 FROM mem q WHERE q.id % 6 = 0 AND q.symbol_id = m.symbol_id AND q.valid_from = m.valid_from) QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY valid_from DESC, trust DESC, recorded_at DESC) = 1")
STAGE = f"st AS (SELECT symbol_id, trade_date, CASE WHEN close > avg(close) {frame(30)} THEN 'S2' ELSE 'S4' END AS stage FROM bars)"
stages = lambda s, d: bars(s, d).select(*KEY, F.when(F.col("close") > F.avg("close").over(along().rowsBetween(-29, 0)), "S2").otherwise("S4").alias("stage"))
R.add("pit7_latest_at", lambda s, d: pit.latest_at(stages(s, d), D("2000-01-01"), "trade_date"), "bars", f"WITH {STAGE} SELECT * FROM st WHERE trade_date <= DATE '2000-01-01' {LATEST}")
R.add("pit8_prior_state", lambda s, d: pit.prior_state(stages(s, d), "stage", "trade_date"), "bars", f"WITH {STAGE}, c AS (SELECT *, CASE WHEN stage IS NOT DISTINCT FROM lag(stage) {W} THEN 0 ELSE 1 END AS c FROM st), g AS (SELECT *, sum(c) {W} AS g FROM c), a AS (SELECT *, row_number() OVER (PARTITION BY symbol_id, g ORDER BY trade_date) AS age, min(trade_date) OVER (PARTITION BY symbol_id, g) AS since FROM g) SELECT symbol_id, trade_date, stage, lag(stage) {W} AS prior_state, CAST(lag(age) {W} AS INTEGER) AS prior_age, lag(since) {W} AS prior_since FROM a")
R.add("pit9_filter_by_stage", lambda s, d: pit.filter_by_stage(master(s, d).select("symbol_id"), pit.latest_at(stages(s, d), D("2001-11-15"), "trade_date").withColumn("confidence", (F.col("symbol_id") % 10) / 10), ["S2"], 0.4, False), "bars master", f"WITH {STAGE}, l AS (SELECT * FROM st {LATEST}) SELECT symbol_id, stage FROM master LEFT JOIN l USING (symbol_id) WHERE stage IS NULL OR (stage = 'S2' AND symbol_id % 10 / 10.0 >= 0.4)")
R.add("pit10_attach_stage", lambda s, d: pit.as_of_join(bars(s, d).select(*KEY), stages(s, d).filter(F.weekday("trade_date") == 4).select("symbol_id", F.col("trade_date").alias("week_end"), "stage"), "symbol_id", "trade_date", "week_end", ["stage"]), "bars", f"WITH {STAGE} SELECT b.symbol_id, b.trade_date, max(s.trade_date) AS matched_at, arg_max(s.stage, s.trade_date) AS stage FROM bars b LEFT JOIN st s ON s.symbol_id = b.symbol_id AND s.trade_date <= b.trade_date AND isodow(s.trade_date) = 5 GROUP BY b.symbol_id, b.trade_date")
cand = lambda s, d, m, lo: table(s, d, "supplier").filter(F.col("s_suppkey") % m == 0).select(F.col("s_suppkey").alias("symbol_id"), F.when(F.col("s_acctbal") > lo, F.col("s_acctbal")).alias("score"))
R.add("pit11_candidate_union", lambda s, d: pit.candidate_union([("ranked", cand(s, d, 2, 5000)), ("breakout", cand(s, d, 3, 0)), ("watch", cand(s, d, 5, -1e9))], ["score"]), "", """WITH u AS (SELECT s_suppkey AS symbol_id, CASE WHEN s_acctbal > lo THEN s_acctbal END AS score, p, nm FROM supplier JOIN (VALUES (2, 5000.0, 0, 'ranked'), (3, 0.0, 1, 'breakout'), (5, -1e9, 2, 'watch')) AS t(m, lo, p, nm) ON s_suppkey % m = 0)
SELECT symbol_id, round(arg_min(score, p) FILTER (WHERE score IS NOT NULL), 6) AS score, string_agg(nm, ',' ORDER BY p) AS sources, arg_min(nm, p) AS primary_source FROM u GROUP BY symbol_id""")
ev = lambda s, d, t: table(s, d, "events").filter(F.col("event_type") == t).select(F.col("user_id").alias("symbol_id"), F.to_date("ts").alias("day"))
R.add("pit12_reconcile_events", lambda s, d: pit.reconcile_events(ev(s, d, "signup"), ev(s, d, "purchase")), "", "WITH a AS (SELECT user_id AS u, min(CAST(ts AS DATE)) AS l, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id AS u, min(CAST(ts AS DATE)) AS r, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT coalesce(a.u, b.u) AS symbol_id, l AS left_day, r AS right_day, CASE WHEN r IS NULL THEN 'left_only' WHEN l IS NULL THEN 'right_only' WHEN l < r THEN 'before' WHEN l = r THEN 'same_day' ELSE 'after' END AS relation, coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1 AS repeated FROM a FULL OUTER JOIN b ON a.u = b.u")
R.add("pit13_episodes", lambda s, d: pit.episodes(table(s, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id"), "", "SELECT event_id, user_id, event_type, user_id || ':' || event_type AS episode_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS is_first, count(*) OVER (PARTITION BY user_id, event_type) AS observations FROM events")
