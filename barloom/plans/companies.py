"""Queries of outcomes (OUT), models (ML), fundamentals (FU), lists (WL), ledgers (TJ) and events (EV) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import company as co
from barloom.operators import indicators as ti
from barloom.operators import market as mk
from barloom.operators import outcomes as out
from barloom.operators import ranking as rk
from barloom.plans import markets  # noqa: F401  its SQL definitions are used here
from barloom.plans.kit import NEEDS, SQL, Registry
from barloom.plans.ranks import LATEST
from barloom.plans.technical import W, frame, pct, r
from barloom.sources.bars import bars, events, fundamentals, master, table, trades

R = Registry()
KEY = ["symbol_id", "trade_date"]
SQL["pan"] = f"SELECT symbol_id, trade_date, close, high, low, volume, round(close / nullif(lag(close, 20) {W}, 0) - 1, 6) AS s, round(lead(close, 5) {W} / nullif(close, 0) - 1, 6) AS fwd_5, lead(trade_date, 5) {W} AS matured_5, round(lead(close, 20) {W} / nullif(close, 0) - 1, 6) AS fwd_20, lead(trade_date, 20) {W} AS matured_20 FROM bars"
NEEDS["pan"] = ["bars"]
#: Returns as they are: means of rounded ones may fall on a half of the last digit.
SQL["raw"] = f"SELECT symbol_id, trade_date, close / nullif(lag(close, 20) {W}, 0) - 1 AS s, lead(close, 5) {W} / nullif(close, 0) - 1 AS fwd_5 FROM bars"
NEEDS["raw"] = ["bars"]


def pan(s, d):
    from barloom.functions.stats import along

    b = mk.forward(bars(s, d), 5, 20)
    return b.withColumns({"s": F.round(F.col("close") / F.nullif(F.lag("close", 20).over(along()), F.lit(0.0)) - 1, 6), "fwd_5": F.round("fwd_5", 6), "fwd_20": F.round("fwd_20", 6)})


def raw(s, d):
    from barloom.functions.stats import along

    return mk.forward(bars(s, d), 5).withColumn("s", F.col("close") / F.nullif(F.lag("close", 20).over(along()), F.lit(0.0)) - 1)


SUMM = lambda v: f"count(*) AS n, {r(f'avg({v})', 'mean')}, {r(f'quantile_cont({v}, 0.5)', 'median')}, {r(f'avg(CASE WHEN {v} > 0 THEN 1.0 ELSE 0 END)', 'win_rate')}"
R.add("out1_forward", lambda s, d: pan(s, d).select(*KEY, "fwd_5", "matured_5", "fwd_20", "matured_20"), "pan", "SELECT symbol_id, trade_date, fwd_5, matured_5, fwd_20, matured_20 FROM pan")
RANKD = "row_number() OVER (PARTITION BY trade_date ORDER BY s DESC, symbol_id)"
BAND = "CASE WHEN k <= 10 THEN 'top_10' WHEN k <= 50 THEN '11_50' WHEN k <= 200 THEN '51_200' ELSE '201_plus' END"


def banded(s, d):
    from pyspark.sql import Window

    rows = pan(s, d).filter("s is not null").withColumn("k", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("s"), "symbol_id")))
    return rows.withColumn("band", out.band(F.col("k")))


SQL["bnd"] = f"SELECT *, {BAND} AS band FROM (SELECT *, {RANKD} AS k FROM pan WHERE s IS NOT NULL)"
NEEDS["bnd"] = ["pan"]
R.add("out2_bands", lambda s, d: out.summary(banded(s, d), "fwd_20", "band"), "bnd", f"SELECT band, {SUMM('fwd_20')} FROM bnd WHERE fwd_20 IS NOT NULL GROUP BY band")
R.add("out3_buckets", lambda s, d: out.summary(raw(s, d).join(master(s, d), "symbol_id"), "fwd_5", "sector"), "raw master", f"SELECT sector, {SUMM('fwd_5')} FROM raw JOIN master USING (symbol_id) WHERE fwd_5 IS NOT NULL GROUP BY sector")
R.add("out4_against_control", lambda s, d: out.against_control(pan(s, d).withColumn("bucket", F.when(F.col("symbol_id") % 4 == 0, "control").otherwise(F.concat(F.lit("b"), (F.col("symbol_id") % 4).cast("string")))), "fwd_5"), "pan", f"WITH x AS (SELECT *, CASE WHEN symbol_id % 4 = 0 THEN 'control' ELSE 'b' || (symbol_id % 4) END AS bucket FROM pan WHERE fwd_5 IS NOT NULL), c AS (SELECT trade_date, avg(fwd_5) AS c FROM x WHERE bucket = 'control' GROUP BY 1) SELECT bucket, count(*) AS n, {r('avg(fwd_5 - c)', 'edge')} FROM x JOIN c USING (trade_date) WHERE bucket <> 'control' GROUP BY bucket")
IC = lambda keys: f"SELECT {keys + ', ' if keys else ''}count(*) AS n, {r('CASE WHEN count(*) >= 3 AND NOT isnan(corr(a, b)) THEN corr(a, b) END', 'ic')} FROM x {'GROUP BY ' + keys if keys else ''}"
R.add("out5_spearman", lambda s, d: out.spearman(pan(s, d), "s", "fwd_20"), "pan", f"WITH k AS (SELECT * FROM pan WHERE s IS NOT NULL AND fwd_20 IS NOT NULL), x AS (SELECT {pct('s')} AS a, {pct('fwd_20')} AS b FROM k) {IC('')}")
R.add("out6_cohort_ic", lambda s, d: out.spearman(banded(s, d), "s", "fwd_20", "band", few=True), "bnd", f"WITH k AS (SELECT * FROM bnd WHERE fwd_20 IS NOT NULL), x AS (SELECT band, {pct('s', 'band')} AS a, {pct('fwd_20', 'band')} AS b FROM k) {IC('band')}")
R.add("out8_coverage", lambda s, d: out.factor_coverage(pan(s, d), ["s", "fwd_5", "fwd_20"]), "pan", " UNION ALL ".join(f"SELECT '{c}' AS factor, count({c}) AS known, round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage, min(CASE WHEN {c} IS NOT NULL THEN trade_date END) AS first_date, max(CASE WHEN {c} IS NOT NULL THEN trade_date END) AS last_date, CASE WHEN count({c}) = 0 THEN 'missing' WHEN avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0 END) < 0.8 THEN 'partial' ELSE 'ok' END AS status FROM pan" for c in ("s", "fwd_5", "fwd_20")))
R.add("out12_anomalies", lambda s, d: out.anomalies(pan(s, d), "fwd_5", 2.0), "pan", "SELECT count(fwd_5) AS n, count(*) FILTER (WHERE abs(fwd_5) > 2) AS anomalous FROM pan")
R.add("out13_rolling_ic", lambda s, d: out.rolling_ic(pan(s, d), "s", "fwd_5"), "pan", f"WITH k AS (SELECT * FROM pan WHERE s IS NOT NULL AND fwd_5 IS NOT NULL), x AS (SELECT trade_date, {pct('s', 'trade_date')} AS a, {pct('fwd_5', 'trade_date')} AS b FROM k), y AS (SELECT trade_date, count(*) AS n, CASE WHEN count(*) >= 3 AND NOT isnan(corr(a, b)) THEN corr(a, b) END AS ic FROM x GROUP BY 1) SELECT trade_date, n, {r('ic', 'ic')}, {r('avg(ic) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 'rolling_ic')} FROM y")
R.add("out14_regimes", lambda s, d: out.summary(pan(s, d).join(mk.regime(mk.breadth_score(mk.breadth(bars(s, d)))).select("trade_date", "label"), "trade_date"), "fwd_20", "label"), "pan brs", f"SELECT label, {SUMM('fwd_20')} FROM pan JOIN brs USING (trade_date) WHERE fwd_20 IS NOT NULL GROUP BY label")
R.add("out16_quintiles", lambda s, d: out.quintile_returns(pan(s, d).filter("s is not null"), "s", "fwd_5").select("quintile", "n", "mean", "rises"), "pan", f"WITH x AS (SELECT *, ntile(5) OVER (PARTITION BY trade_date ORDER BY s, symbol_id) AS q FROM pan WHERE s IS NOT NULL), y AS (SELECT CAST(q AS INTEGER) AS quintile, count(*) AS n, avg(fwd_5) AS m FROM x WHERE fwd_5 IS NOT NULL GROUP BY 1) SELECT quintile, n, {r('m', 'mean')}, round(m, 9) > lag(round(m, 9)) OVER (ORDER BY quintile) AS rises FROM y")
R.add("out18_rallies", lambda s, d: out.rallies(bars(s, d), F.to_date(F.lit("1999-01-01")), F.to_date(F.lit("1999-12-31")), 20), "bars", f"WITH x AS (SELECT symbol_id, arg_min(close, trade_date) AS a, arg_max(close, trade_date) AS z, min(close) AS l, max(close) AS h FROM bars WHERE trade_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY 1 HAVING count(*) >= 10) SELECT symbol_id, {r('z / a - 1', 'ret')}, {r('l', 'low_close')}, {r('h', 'high_close')}, {r('h / l - 1', 'rally')} FROM x ORDER BY round(h / l - 1, 6) DESC, symbol_id LIMIT 20")
R.add("out20_deciles", lambda s, d: out.summary(out.buckets(pan(s, d).filter("s is not null"), "s", 10, "trade_date"), "fwd_20", "bucket").select("bucket", "n", "median"), "pan", f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY s, symbol_id) AS k, count(*) OVER (PARTITION BY trade_date) AS c FROM pan WHERE s IS NOT NULL) SELECT CASE WHEN c = 1 THEN 1 ELSE CAST(greatest(ceil((k - 1) * 10.0 / nullif(c - 1, 0)) - 1, 0) + 1 AS INTEGER) END AS bucket, count(*) AS n, {r('quantile_cont(fwd_20, 0.5)', 'median')} FROM x WHERE fwd_20 IS NOT NULL GROUP BY 1")
EXC = "sig AS (SELECT symbol_id, trade_date FROM bars WHERE day(trade_date) = 15)"
R.add("out24_excursions", lambda s, d: out.excursions(bars(s, d), bars(s, d).filter(F.dayofmonth("trade_date") == 15), 10), "bars", f"WITH {EXC}, b AS (SELECT *, row_number() {W} AS n FROM bars), e AS (SELECT symbol_id, trade_date AS event_date, close AS c, n AS e FROM b WHERE day(trade_date) = 15) SELECT e.symbol_id, event_date, {r('arg_max(close, n) / any_value(c) - 1', 'ret')}, {r('max(high) / any_value(c) - 1', 'mfe')}, {r('min(low) / any_value(c) - 1', 'mae')}, count(*) AS sessions FROM e JOIN b ON b.symbol_id = e.symbol_id AND b.n > e.e AND b.n <= e.e + 10 GROUP BY 1, 2")
R.add("out25_cohorts", lambda s, d: out.cohorts(banded(s, d).join(master(s, d), "symbol_id"), "fwd_5", "band", "parent"), "bnd master", f"SELECT band, parent, count(*) AS n, {r('avg(CASE WHEN fwd_5 > 0 THEN 1.0 ELSE 0 END)', 'win_rate')}, {r('avg(CASE WHEN fwd_5 > 0 THEN fwd_5 END) / nullif(-avg(CASE WHEN fwd_5 <= 0 THEN fwd_5 END), 0)', 'payoff')}, {r('avg(fwd_5)', 'expectancy')} FROM bnd JOIN master USING (symbol_id) WHERE fwd_5 IS NOT NULL GROUP BY CUBE (band, parent)")
R.add("out27_exclusions", lambda s, d: out.exclusion_reasons(pan(s, d)).select(*KEY, "excluded"), "pan", "SELECT symbol_id, trade_date, concat_ws(',', CASE WHEN matured_5 IS NULL THEN 'not_matured' END, CASE WHEN abs(fwd_5) > 1 THEN 'anomalous' END, CASE WHEN volume <= 10 THEN 'thin' END) AS excluded FROM pan")
R.add("out32_basket", lambda s, d: out.basket(pan(s, d), "s", 5), "pan", f"WITH dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n FROM (SELECT DISTINCT trade_date FROM pan)), t AS (SELECT * FROM pan JOIN dd USING (trade_date) WHERE s IS NOT NULL QUALIFY {RANKD} <= 5) SELECT t.trade_date, count(*) AS n, {r('avg(t.fwd_5)', 'ret')}, count(p.symbol_id) AS overlap FROM t LEFT JOIN t p ON p.symbol_id = t.symbol_id AND p.n = t.n - 1 GROUP BY 1")
R.add("out33_performance", lambda s, d: out.performance(mk.equal_weight_index(bars(s, d)).select("trade_date", "ret")), "bars", f"WITH x AS (SELECT trade_date, close / nullif(lag(close) {W}, 0) - 1 AS x FROM bars), y AS (SELECT trade_date, avg(CASE WHEN x IS NOT NULL THEN greatest(-0.5, least(0.5, x)) END) AS ret FROM x GROUP BY 1 HAVING count(x) > 0), z AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY trade_date)) AS l FROM y), q AS (SELECT *, greatest(1, max(l) OVER (ORDER BY trade_date)) AS t FROM z) SELECT count(*) AS n, {r('exp(sum(ln(1 + ret))) - 1', 'total')}, {r('power(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1', 'cagr')}, {r('stddev_pop(ret) * sqrt(252)', 'volatility')}, {r('avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252)', 'sharpe')}, {r('min(l / t - 1)', 'max_drawdown')}, {r('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END)', 'win_rate')} FROM q")
R.add("out35_periods", lambda s, d: out.summary(out.long_horizons(banded(s, d).withColumn("period", F.year("trade_date")), [5, 20], "band", "period"), "ret", "band", "horizon", "period"), "bnd", f"WITH x AS (SELECT band, year(trade_date) AS period, 5 AS horizon, fwd_5 AS ret FROM bnd UNION ALL SELECT band, year(trade_date), 20, fwd_20 FROM bnd) SELECT band, horizon, CAST(period AS INTEGER) AS period, {SUMM('ret')} FROM x WHERE ret IS NOT NULL GROUP BY 1, 2, 3")
R.add("out37_best_worst", lambda s, d: out.best_and_worst(pan(s, d), "fwd_20", 30, 5), "pan", "WITH m AS (SELECT symbol_id, count(*) AS n, round(avg(fwd_20), 6) AS mean FROM pan WHERE fwd_20 IS NOT NULL GROUP BY 1 HAVING count(*) >= 30) SELECT * FROM (SELECT *, 'best' AS side FROM m ORDER BY mean DESC, symbol_id LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'worst' AS side FROM m ORDER BY mean, symbol_id LIMIT 5)")
R.add("out38_opposite_run", lambda s, d: out.first_opposite_run(mk.classify(mk.weekly(bars(s, d))), "S4", 2), "stg", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY week_end) - row_number() OVER (PARTITION BY symbol_id, stage ORDER BY week_end) AS k FROM stg), g AS (SELECT symbol_id, k, count(*) AS l, min(week_end) AS since FROM x WHERE stage = 'S4' GROUP BY 1, 2 HAVING count(*) >= 2) SELECT symbol_id, min(since) AS since, arg_min(l, since) AS length FROM g GROUP BY 1")
R.add("ml1_labels", lambda s, d: out.top_labels(pan(s, d), "fwd_5").select(*KEY, "label"), "pan", "SELECT symbol_id, trade_date, CAST(fwd_5 >= quantile_cont(fwd_5, 0.6) OVER (PARTITION BY trade_date) AS INTEGER) AS label FROM pan WHERE fwd_5 IS NOT NULL")
R.add("ml7_precision", lambda s, d: out.top_decile_precision(out.top_labels(raw(s, d), "fwd_5").filter("s is not null"), "s", "label", "fwd_5"), "raw", f"WITH x AS (SELECT *, CASE WHEN fwd_5 >= quantile_cont(fwd_5, 0.6) OVER (PARTITION BY trade_date) THEN 1.0 ELSE 0 END AS l FROM raw WHERE fwd_5 IS NOT NULL), y AS (SELECT *, {RANKD} AS k, count(*) OVER (PARTITION BY trade_date) AS c FROM x WHERE s IS NOT NULL) SELECT trade_date, count(*) AS n, {r('avg(l)', 'precision')}, {r('avg(fwd_5)', 'mean_return')} FROM y WHERE k <= ceil(0.1 * c) GROUP BY 1")
BIN = " + ".join(f"CASE WHEN x.s > q{k} THEN 1 ELSE 0 END" for k in range(1, 10))
QS = ", ".join(f"quantile_cont(s, {k / 10}) AS q{k}" for k in range(1, 10))
R.add("ml8_psi", lambda s, d: out.psi(pan(s, d).filter("trade_date < '1999-01-01'"), pan(s, d).filter("trade_date >= '1999-01-01'"), "s"), "pan", f"WITH e AS (SELECT {QS} FROM pan WHERE trade_date < DATE '1999-01-01'), b AS (SELECT {BIN} AS bin, trade_date < DATE '1999-01-01' AS ref FROM pan x, e WHERE s IS NOT NULL), c AS (SELECT bin, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM b GROUP BY 1), p AS (SELECT greatest(r * 1.0 / sum(r) OVER (), 1e-6) AS pr, greatest(c * 1.0 / sum(c) OVER (), 1e-6) AS pc FROM c) SELECT {r('sum((pc - pr) * ln(pc / pr))', 'psi')} FROM p")
R.add("tj5_wilson", lambda s, d: out.wilson(banded(s, d).filter("fwd_5 is not null").groupBy("band").agg(F.count_if(F.col("fwd_5") > 0).alias("hits"), F.count("*").alias("n")), "hits", "n"), "bnd", f"WITH x AS (SELECT band, count(*) FILTER (WHERE fwd_5 > 0) AS hits, count(*) AS n FROM bnd WHERE fwd_5 IS NOT NULL GROUP BY 1), y AS (SELECT *, hits * 1.0 / n AS p, 1.96 AS z FROM x) SELECT band, hits, n, {r('p', 'rate')}, {r('(p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)', 'low')}, {r('(p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)', 'high')} FROM y")

QW = "OVER (PARTITION BY symbol_id ORDER BY report_date)"
Q4 = "OVER (PARTITION BY symbol_id ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
SQL["gr0"] = f"SELECT *, sales / nullif(lag(sales, 1) {QW}, 0) - 1 AS qoq, sales / nullif(lag(sales, 4) {QW}, 0) - 1 AS yoy, CASE WHEN lag(sales, 8) {QW} > 0 AND sales > 0 THEN sqrt(sales / lag(sales, 8) {QW}) - 1 END AS cagr_8 FROM fundamentals"
SQL["gr"] = f"SELECT *, sum(CASE WHEN coalesce(qoq, 0) > 0 THEN 1 ELSE 0 END) {Q4} AS positive_4 FROM gr0"
SQL["csec"] = "SELECT c_custkey AS symbol_id, c_mktsegment AS sector FROM customer"
NEEDS |= {"gr0": ["fundamentals"], "gr": ["gr0"]}
gr = lambda s, d: co.growth(fundamentals(s, d))
csec = lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_mktsegment").alias("sector"))
R.add("fu1_trailing_year", lambda s, d: co.trailing_year(fundamentals(s, d), "sales", "orders").select("symbol_id", "report_date", "ttm_sales", "ttm_orders"), "fundamentals", f"SELECT symbol_id, report_date, {r(f'CASE WHEN count(sales) {Q4} >= 4 THEN sum(sales) {Q4} END', 'ttm_sales')}, {r(f'CASE WHEN count(orders) {Q4} >= 4 THEN sum(orders) {Q4} END', 'ttm_orders')} FROM fundamentals")
R.add("fu2_pivot", lambda s, d: co.pivot_metrics(fundamentals(s, d).select("symbol_id", "report_date", "available_at", F.explode(F.array(F.struct(F.lit("sales").alias("metric"), F.col("sales").alias("value")), F.struct(F.lit("orders").alias("metric"), F.col("orders").alias("value")))).alias("m")).select("symbol_id", "report_date", "available_at", "m.metric", "m.value"), ["sales", "orders"]), "fundamentals", "SELECT symbol_id, report_date, round(sales, 6) AS sales, orders FROM fundamentals")
R.add("fu10_growth", lambda s, d: gr(s, d).select("symbol_id", "report_date", "qoq", "yoy", "cagr_8", "positive_4"), "gr", f"SELECT symbol_id, report_date, {r('qoq', 'qoq')}, {r('yoy', 'yoy')}, {r('cagr_8', 'cagr_8')}, CAST(positive_4 AS BIGINT) AS positive_4 FROM gr")
R.add("fu11_tags", lambda s, d: co.insight_tags(gr(s, d)).select("symbol_id", "report_date", "tag"), "gr", "SELECT symbol_id, report_date, 'great_result' AS tag FROM gr WHERE yoy > 0.5 UNION ALL SELECT symbol_id, report_date, 'turnaround' FROM gr WHERE qoq > 0 AND yoy < 0 UNION ALL SELECT symbol_id, report_date, 'compounder' FROM gr WHERE positive_4 >= 3")
SQL["sg0"] = f"SELECT sector, report_date, sum(sales) AS sales, quantile_cont(yoy, 0.5) AS median_yoy, avg(CASE WHEN yoy > 0 THEN 1.0 WHEN yoy IS NOT NULL THEN 0 END) AS growing_share FROM gr JOIN csec USING (symbol_id) GROUP BY 1, 2"
SQL["sg"] = "SELECT *, sales / nullif(lag(sales, 4) OVER (PARTITION BY sector ORDER BY report_date), 0) - 1 AS sales_yoy FROM sg0"
NEEDS |= {"sg0": ["gr", "csec"], "sg": ["sg0"]}
sg = lambda s, d: co.sector_growth(gr(s, d), csec(s, d))
R.add("fu12_sector_growth", sg, "sg", f"SELECT sector, report_date, {r('sales', 'sales')}, {r('median_yoy', 'median_yoy')}, {r('growing_share', 'growing_share')}, {r('sales_yoy', 'sales_yoy')} FROM sg")
R.add("fu13_leadership", lambda s, d: co.leadership(sg(s, d)).select("sector", "report_date", "score", "trend"), "sg", f"WITH x AS (SELECT sector, report_date, round(sales_yoy, 9) AS a, round(median_yoy, 9) AS b FROM sg), y AS (SELECT sector, report_date, 50 * coalesce({pct('a', 'report_date')}, 0.5) + 50 * coalesce({pct('b', 'report_date')}, 0.5) AS score FROM x) SELECT sector, report_date, {r('score', 'score')}, CASE WHEN score >= 70 THEN 'leading' WHEN score >= 40 THEN 'middle' ELSE 'lagging' END AS trend FROM y")
LASTQ = "QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY report_date DESC) = 1"
R.add("fu14_score", lambda s, d: co.fundamental_score(gr(s, d)).select("symbol_id", "report_date", "score", "tier", "red_flags"), "gr", f"WITH x AS (SELECT *, 0.4 * greatest(0.0, least(100.0, 50 + 100 * coalesce(qoq, 0))) + 0.4 * greatest(0.0, least(100.0, 50 + 100 * coalesce(yoy, 0))) + 0.2 * greatest(0.0, least(100.0, orders * 10)) AS sc FROM gr) SELECT symbol_id, report_date, {r('sc', 'score')}, CASE WHEN sc >= 70 THEN 'A' WHEN sc >= 55 THEN 'B' WHEN sc >= 40 THEN 'C' ELSE 'D' END AS tier, concat_ws(',', CASE WHEN yoy < -0.5 THEN 'collapse' END, CASE WHEN orders < 2 THEN 'thin' END, CASE WHEN yoy IS NULL THEN 'no_history' END) AS red_flags FROM x")
R.add("fu15_within_sector", lambda s, d: co.within_sector(rk.latest(fundamentals(s, d), order="report_date").join(csec(s, d), "symbol_id"), "sales").select("symbol_id", "sales_pct"), "fundamentals csec", f"WITH x AS (SELECT * FROM fundamentals JOIN csec USING (symbol_id) {LASTQ}) SELECT symbol_id, {r(f'100 * {pct('sales', 'sector')}', 'sales_pct')} FROM x")
H8 = "OVER (PARTITION BY symbol_id ORDER BY report_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
R.add("fu7_own_history", lambda s, d: co.own_history(fundamentals(s, d), "sales", 8).select("symbol_id", "report_date", "sales_median", "sales_own_pct").withColumn("zone", co.valuation_zone(F.round("sales_own_pct", 6))), "fundamentals", f"WITH x AS (SELECT symbol_id, report_date, sales, quantile_cont(sales, 0.5) {H8} AS m, list(sales) {H8} AS l FROM fundamentals), y AS (SELECT *, len(list_filter(l, lambda v: v <= sales)) * 1.0 / len(l) AS p FROM x) SELECT symbol_id, report_date, {r('m', 'sales_median')}, {r('p', 'sales_own_pct')}, CASE WHEN round(p, 6) <= 0.2 THEN 'cheap' WHEN round(p, 6) <= 0.8 THEN 'fair' ELSE 'rich' END AS zone FROM y")
R.add("fu6_trimmed", lambda s, d: co.trimmed(gr(s, d).join(csec(s, d), "symbol_id").filter("yoy is not null"), "yoy", "sector"), "gr csec", f"WITH x AS (SELECT sector, yoy FROM gr JOIN csec USING (symbol_id) WHERE yoy IS NOT NULL), e AS (SELECT sector, quantile_cont(yoy, 0.1) AS lo, quantile_cont(yoy, 0.9) AS hi, quantile_cont(yoy, 0.5) AS m FROM x GROUP BY 1) SELECT sector, {r('m', 'median')}, {r('avg(CASE WHEN yoy BETWEEN lo AND hi THEN yoy END)', 'trimmed_mean')}, {r('avg(CASE WHEN yoy < 0 THEN 1.0 ELSE 0 END)', 'loss_share')} FROM x JOIN e USING (sector) GROUP BY sector, m")
R.add("fu27_first_to_last", lambda s, d: co.first_to_last_growth(fundamentals(s, d), "sales"), "fundamentals", f"WITH x AS (SELECT symbol_id, min(report_date) AS a, max(report_date) AS b, arg_min(sales, report_date) AS p, arg_max(sales, report_date) AS q FROM fundamentals WHERE sales > 0 GROUP BY 1) SELECT symbol_id, {r('power(q / p, 1 / ((b - a) / 365.25)) - 1', 'cagr')} FROM x WHERE b > a")
R.add("fu16_snapshots", lambda s, d: co.compare_snapshots(rk.latest(co.fundamental_score(gr(s, d)), order="report_date").select("symbol_id", "score"), rk.latest(co.fundamental_score(gr(s, d)).filter("report_date < '2000-01-01'"), order="report_date"), "score").withColumn("trend", F.when(F.abs(F.abs("delta") - 5) > 1e-6, F.col("trend")).otherwise("edge")), "gr", f"WITH x AS (SELECT symbol_id, report_date, 0.4 * greatest(0.0, least(100.0, 50 + 100 * coalesce(qoq, 0))) + 0.4 * greatest(0.0, least(100.0, 50 + 100 * coalesce(yoy, 0))) + 0.2 * greatest(0.0, least(100.0, orders * 10)) AS score FROM gr), a AS (SELECT symbol_id, score FROM x {LASTQ}), b AS (SELECT symbol_id, score AS o FROM x WHERE report_date < DATE '2000-01-01' {LASTQ}) SELECT symbol_id, {r('score', 'score')}, {r('score - o', 'delta')}, CASE WHEN abs(abs(score - o) - 5) <= 1e-6 THEN 'edge' WHEN score - o > 5 THEN 'improving' WHEN score - o < -5 THEN 'deteriorating' WHEN o IS NOT NULL THEN 'stable' ELSE CASE WHEN abs(abs(score - o) - 5) > 1e-6 THEN 'new' ELSE 'edge' END END AS trend FROM a LEFT JOIN b USING (symbol_id)")

ranked = lambda s, d: rk.latest(rk.returns(bars(s, d), 20)).select("symbol_id", F.round(50 + F.coalesce("ret_20", F.lit(0.0)) / 2, 6).alias("composite"))
wl = lambda s, d: co.watchlist(ranked(s, d), mk.breakouts(bars(s, d)))
SQL["wl0"] = f"WITH k AS (SELECT symbol_id, round(50 + coalesce(100 * (close / nullif(lag(close, 20) {W}, 0) - 1), 0) / 2, 6) AS composite FROM bars {LATEST}), b AS (SELECT symbol_id, setup_family, conviction FROM bo WHERE setup_family IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY conviction DESC, trade_date DESC) = 1) SELECT k.*, setup_family, CAST(conviction AS DOUBLE) AS conviction, concat_ws(',', CASE WHEN composite < 50 THEN 'rank' END, CASE WHEN coalesce(conviction, 0) < 60 THEN 'conviction' END, CASE WHEN setup_family IS NULL THEN 'no_setup' END) AS fails, concat_ws(',', CASE WHEN composite >= 80 THEN 'leader' END, CASE WHEN conviction >= 80 THEN 'power' END) AS tags FROM k LEFT JOIN b USING (symbol_id)"
SQL["wl"] = "SELECT *, CASE WHEN fails = '' THEN 0 ELSE len(string_split(fails, ',')) END AS n_fails, nullif(split_part(fails, ',', 1), '') AS first_fail FROM wl0"
NEEDS |= {"wl0": ["bo"], "wl": ["wl0"]}
R.add("wl1_watchlist", lambda s, d: wl(s, d).select("symbol_id", "composite", "setup_family", "conviction", "fails", "tags"), "wl", "SELECT symbol_id, composite, setup_family, conviction, fails, tags FROM wl")
R.add("wl3_failing", lambda s, d: wl(s, d).filter("n_fails > 0").select("symbol_id", "fails", "first_fail"), "wl", "SELECT symbol_id, fails, first_fail FROM wl WHERE n_fails > 0")
R.add("wl4_score", lambda s, d: co.watch_score(wl(s, d)).select("symbol_id", "watch_score"), "wl", f"SELECT symbol_id, {r('0.6 * composite + 0.3 * coalesce(conviction, 0) - 5 * n_fails', 'watch_score')} FROM wl")
R.add("wl6_buckets", lambda s, d: co.priority_bucket(wl(s, d)).select("symbol_id", "bucket"), "wl", "SELECT symbol_id, CASE WHEN composite >= 80 AND n_fails = 0 THEN '1_act' WHEN n_fails = 0 THEN '2_ready' WHEN n_fails = 1 THEN '3_near' ELSE '4_rest' END AS bucket FROM wl")
AGE = "DATE '2024-01-31' - CAST(ts AS DATE)"
R.add("wl23_repeats", lambda s, d: co.repeat_counts(events(s, d), F.to_date(F.lit("2024-01-31")), 5, 10, 20), "ev", f"SELECT symbol_id, category, {', '.join(f'count(*) FILTER (WHERE {AGE} >= 0 AND {AGE} < {n}) AS seen_{n}' for n in (5, 10, 20))}, {r('arg_min(importance, event_id)', 'first_value')}, {r('arg_max(importance, event_id)', 'last_value')}, arg_max(importance, event_id) > arg_min(importance, event_id) AS escalated FROM ev GROUP BY 1, 2")
R.add("wl33_screen", lambda s, d: co.screen(wl(s, d), {"composite": (">=", 45.0), "conviction": (">=", 20.0)}, "conviction", 15).select("symbol_id", "composite", "conviction"), "wl", "SELECT symbol_id, composite, conviction FROM wl WHERE composite >= 45 AND conviction >= 20 ORDER BY round(conviction, 6) DESC NULLS LAST, symbol_id LIMIT 15")
R.add("wl34_sector_stages", lambda s, d: rk.latest(mk.classify(mk.weekly(bars(s, d))), order="week_end").join(master(s, d), "symbol_id").groupBy("sector", "stage").agg(F.count("*").alias("n"), F.max("week_end").alias("latest")), "stg master", "WITH l AS (SELECT * FROM stg QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY week_end DESC) = 1) SELECT sector, stage, count(*) AS n, max(week_end) AS latest FROM l JOIN master USING (symbol_id) GROUP BY 1, 2")
R.add("wl37_progress", lambda s, d: co.progress(bars(s, d), ["close", "volume", "low"]).select(*KEY, "improved", "worsened", "progress"), "bars", f"WITH x AS (SELECT symbol_id, trade_date, " + ", ".join(f"{' + '.join(f'CASE WHEN {c} {op} lag({c}) {W} THEN 1 ELSE 0 END' for c in ('close', 'volume', 'low'))} AS {n}" for op, n in ((">", "improved"), ("<", "worsened"))) + " FROM bars) SELECT symbol_id, trade_date, CAST(improved AS INTEGER) AS improved, CAST(worsened AS INTEGER) AS worsened, CASE WHEN improved > worsened THEN 'PROGRESSING' WHEN improved < worsened THEN 'REGRESSING' ELSE 'FLAT' END AS progress FROM x")

trust = lambda s, d: table(s, d, "events").select((F.col("event_id") % 2).alias("source")).distinct().withColumn("trust", F.when(F.col("source") == 0, 90.0).otherwise(60.0))
R.add("ev1_materiality", lambda s, d: co.materiality(events(s, d), trust(s, d)).select("event_id", "materiality"), "ev", f"SELECT event_id, {r('''0.35 * greatest(0.0, least(100.0, importance / 2)) + 0.25 * CASE WHEN source = 0 THEN 90 ELSE 60 END + 0.4 * CASE WHEN category = 'purchase' THEN 80 ELSE 30 END''', 'materiality')} FROM ev")
R.add("ev2_lookback", lambda s, d: co.within_lookback(events(s, d), F.to_date(F.lit("2024-01-20"))).select("event_id"), "ev", "SELECT event_id FROM ev WHERE DATE '2024-01-20' - CAST(ts AS DATE) BETWEEN 0 AND CASE category WHEN 'purchase' THEN 10 WHEN 'signup' THEN 20 WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 5 END")
R.add("ev3_corroborated", lambda s, d: co.corroborated(events(s, d)).select("event_id"), "ev", "SELECT event_id FROM ev a WHERE EXISTS (SELECT 1 FROM ev b WHERE b.symbol_id = a.symbol_id AND b.category = a.category AND b.source <> a.source AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 86400000000)")
R.add("ev4_suppressed", lambda s, d: co.suppressed(events(s, d).filter("event_id % 5 <> 0"), events(s, d).filter("event_id % 5 = 0")).select("event_id"), "ev", "SELECT event_id FROM ev a WHERE event_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.event_id % 5 = 0 AND b.symbol_id = a.symbol_id AND b.category = a.category AND CAST(a.ts AS DATE) - CAST(b.ts AS DATE) BETWEEN 0 AND 7)")
R.add("ev5_allowed", lambda s, d: events(s, d).filter(F.col("category").isin("purchase", "signup")).select("event_id", "category"), "ev", "SELECT event_id, category FROM ev WHERE category IN ('purchase', 'signup')")
R.add("ev6_universe", lambda s, d: events(s, d).join(master(s, d).select("symbol_id"), "symbol_id", "left_semi").select("event_id"), "ev master", "SELECT event_id FROM ev WHERE symbol_id IN (SELECT symbol_id FROM master)")
R.add("ev7_triggers", lambda s, d: co.triggers(events(s, d), 100.0), "ev", f"SELECT symbol_id, CAST(ts AS DATE) AS day, {r('greatest(0.0, least(100.0, max(importance) / 2))', 'strength')}, count(*) AS n FROM ev WHERE importance >= 100 GROUP BY 1, 2")
R.add("ev9_per_sector", lambda s, d: events(s, d).join(master(s, d), "symbol_id").groupBy("sector").agg(F.count("*").alias("n")), "ev master", "SELECT sector, count(*) AS n FROM ev JOIN master USING (symbol_id) GROUP BY 1")
R.add("ev11_catalysts", lambda s, d: co.catalysts(events(s, d)), "ev", "WITH x AS (SELECT symbol_id, importance, event_id, CASE WHEN regexp_matches(category, 'purchase|order') THEN 'demand' WHEN regexp_matches(category, 'signup') THEN 'growth' WHEN regexp_matches(category, 'error|fail') THEN 'risk' ELSE 'none' END AS catalyst FROM ev), y AS (SELECT *, CASE catalyst WHEN 'demand' THEN 3.0 WHEN 'growth' THEN 2.0 WHEN 'risk' THEN -2.0 ELSE 0.0 END AS score FROM x) SELECT symbol_id, catalyst, CAST(score AS DOUBLE) AS score, event_id FROM y QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY score DESC, importance DESC NULLS LAST, event_id DESC) = 1")
R.add("ev12_trusted", lambda s, d: events(s, d).join(trust(s, d), "source").filter("trust >= 80").select("event_id"), "ev", "SELECT event_id FROM ev WHERE source = 0")

FIFO = """r AS (SELECT *, sum(qty) OVER (PARTITION BY account, instrument, side ORDER BY executed_on, l_orderkey, l_linenumber, price, qty ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM trades),
c AS (SELECT account, instrument, e - qty AS a0, max(CASE WHEN side = 'BUY' THEN {'p': price, 'd': executed_on, 'e': e} END) AS b, max(CASE WHEN side = 'SELL' THEN {'p': price, 'd': executed_on, 'e': e} END) AS s FROM r GROUP BY ALL),
f AS (SELECT account, instrument, a0, lead(a0) OVER w AS nx, last_value(b IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, last_value(s IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM c WINDOW w AS (PARTITION BY account, instrument ORDER BY a0)),
m AS (SELECT account, instrument, least(coalesce(nx, b.e), b.e, s.e) - a0 AS qty, b.d AS bought_on, s.d AS sold_on, b.p AS bp, s.p AS sp FROM f WHERE b IS NOT NULL AND s IS NOT NULL AND least(coalesce(nx, b.e), b.e, s.e) > a0)"""
R.add("tj1_fifo", lambda s, d: co.fifo(trades(s, d)), "trades", f"WITH {FIFO} SELECT account, instrument, {r('qty', 'qty')}, bought_on, sold_on, {r('qty * (sp - bp)', 'pnl')} FROM m")
NET = "net AS (SELECT account, instrument, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS net_qty, max(executed_on) AS last_fill, count(*) AS fills FROM trades GROUP BY 1, 2 HAVING sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) <> 0)"
net = lambda s, d: co.net_positions(trades(s, d))
R.add("tj2_compare", lambda s, d: co.compare_positions(net(s, d).filter("instrument % 9 <> 0"), net(s, d).filter("instrument % 11 <> 0").withColumn("net_qty", F.when(F.col("instrument") % 4 == 0, F.col("net_qty") + 5).otherwise(F.col("net_qty")))), "trades", f"WITH {NET}, a AS (SELECT * FROM net WHERE instrument % 9 <> 0), b AS (SELECT account, instrument, CASE WHEN instrument % 4 = 0 THEN net_qty + 5 ELSE net_qty END AS net_qty FROM net WHERE instrument % 11 <> 0) SELECT coalesce(a.account, b.account) AS account, coalesce(a.instrument, b.instrument) AS instrument, CASE WHEN a.account IS NULL THEN 'broker_only' WHEN b.account IS NULL THEN 'ledger_only' WHEN abs(a.net_qty - b.net_qty) <= 1 THEN 'match' ELSE 'mismatch' END AS result FROM a FULL OUTER JOIN b ON a.account = b.account AND a.instrument = b.instrument")
R.add("tj4_statistics", lambda s, d: co.ledger_statistics(co.fifo(trades(s, d))), "trades", f"WITH {FIFO}, p AS (SELECT account, qty * (sp - bp) AS pnl FROM m) SELECT account, count(*) AS lots, {r('sum(pnl)', 'pnl')}, {r('sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0)', 'profit_factor')}, {r('avg(pnl)', 'expectancy')}, {r('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END)', 'win_rate')} FROM p GROUP BY 1")
R.add("tj7_net_positions", net, "trades", f"WITH {NET} SELECT * FROM net")
R.add("tj9_costs", lambda s, d: co.fill_costs(trades(s, d)).groupBy("side").agg(F.sum("value").alias("value"), F.sum("cost").alias("cost"), F.sum("net").alias("net")), "trades", f"WITH x AS (SELECT side, qty * price AS v FROM trades) SELECT side, {r('sum(v)', 'value')}, {r('sum(v * 5 / 10000)', 'cost')}, {r('''sum(CASE WHEN side = 'BUY' THEN -v * (1 + 5 / 10000.0) ELSE v * (1 - 5 / 10000.0) END)''', 'net')} FROM x GROUP BY 1")
R.add("tj10_size", lambda s, d: co.position_size(rk.latest(ti.atr(bars(s, d))), 1e8).select("symbol_id", "shares"), "bars", f"WITH a AS (SELECT symbol_id, trade_date, greatest(high, lag(close) {W}) - least(low, lag(close) {W}) AS tr FROM bars), b AS (SELECT symbol_id, avg(tr) {frame(14)} AS atr FROM a {LATEST}) SELECT symbol_id, CAST(floor(coalesce(1e6 / nullif(2 * atr, 0), 0)) AS BIGINT) AS shares FROM b")
R.add("tj11_breaches", lambda s, d: co.limit_breaches(net(s, d), 40, 0.05).select("account", "instrument", "breaches"), "trades", f"WITH {NET}, x AS (SELECT *, count(*) OVER (PARTITION BY account) AS c, abs(net_qty) / nullif(sum(abs(net_qty)) OVER (PARTITION BY account), 0) AS w FROM net) SELECT account, instrument, concat_ws(',', CASE WHEN c > 40 THEN 'positions' END, CASE WHEN w > 0.05 THEN 'weight' END) AS breaches FROM x")
