"""Queries of valuation, statements and industry scores (FU) and of candidate lists (WL) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.stats import along
from barloom.operators import candidates as ca
from barloom.operators import company as co
from barloom.operators import market as mk
from barloom.operators import ranking as rk
from barloom.operators import valuation as va
from barloom.plans import companies, markets  # noqa: F401  their SQL definitions are used here
from barloom.plans.companies import Q4, csec, gr
from barloom.plans.kit import NEEDS, SQL, Registry
from barloom.plans.markets import stage_rows
from barloom.plans.ranks import LATEST
from barloom.plans.technical import W, frame, r
from barloom.sources.bars import bars, fundamentals, master, table

R = Registry()
KEY = ["symbol_id", "trade_date"]

# --- statements ---------------------------------------------------------------------------------------------
SQL["books"] = """SELECT symbol_id, report_date, CASE WHEN orders % 3 <> 0 THEN sales / 1e6 * CASE WHEN month(report_date) = 3 THEN 100 ELSE 1 END END AS adjusted_shares, CASE WHEN orders % 2 = 0 THEN sales * 50 END AS share_count,
CASE WHEN month(report_date) <> 6 THEN sales / 2000 END AS share_capital, CASE WHEN orders > 1 THEN sales / 100 END AS reserves FROM fundamentals"""
NEEDS["books"] = ["fundamentals"]


def books(s, d):
    sales, n, month = F.col("sales"), F.col("orders"), F.month("report_date")
    return fundamentals(s, d).withColumns({"adjusted_shares": F.when(n % 3 != 0, sales / 1e6 * F.when(month == 3, 100).otherwise(1)), "share_count": F.when(n % 2 == 0, sales * 50), "share_capital": F.when(month != 6, sales / 2000), "reserves": F.when(n > 1, sales / 100)})


R.add("fu3_share_book", lambda s, d: va.share_book(books(s, d)).select("symbol_id", "report_date", "shares", "book_value"), "books", f"""WITH x AS (SELECT *, share_count / 1e7 AS c, share_capital / 10 AS i FROM books),
y AS (SELECT *, CASE WHEN i > 0 AND adjusted_shares < 0.1 * i AND c > 0 THEN c WHEN adjusted_shares > 0 THEN adjusted_shares ELSE c END AS f FROM x)
SELECT symbol_id, report_date, {r('CASE WHEN i > 0 AND (f IS NULL OR f <= 0) THEN i ELSE f END', 'shares')}, {r('share_capital + reserves', 'book_value')} FROM y""")

SQL |= {
    "gain": "SELECT symbol_id, report_date, available_at, sales - 150000 AS profit FROM fundamentals",
    "tq": f"SELECT symbol_id, available_at, sum(profit) {Q4} AS ttm_profit FROM gain QUALIFY count(*) {Q4} = 4",
    "ta": "SELECT symbol_id, make_date(year(report_date) + 1, 3, 1) AS available_at, sum(profit) AS annual_profit FROM gain GROUP BY ALL",
    "ttm": """SELECT b.symbol_id, b.trade_date, b.close, coalesce(q.ttm_profit, a.annual_profit) AS ttm_profit, CASE WHEN q.ttm_profit IS NOT NULL THEN 'quarterly_ttm' WHEN a.annual_profit IS NOT NULL THEN 'annual_fallback' ELSE 'missing' END AS earnings_source
FROM bars b ASOF LEFT JOIN tq q ON b.symbol_id = q.symbol_id AND b.trade_date >= q.available_at ASOF LEFT JOIN ta a ON b.symbol_id = a.symbol_id AND b.trade_date >= a.available_at""",
    "stock": "SELECT ttm.*, sector, parent AS universe, 1000 * close * (1 + symbol_id % 9) AS market_cap FROM ttm JOIN master USING (symbol_id)",
}
NEEDS |= {"gain": ["fundamentals"], "tq": ["gain"], "ta": ["gain"], "ttm": ["bars", "tq", "ta"], "stock": ["ttm", "master"]}


def ttm(s, d):
    gain = fundamentals(s, d).withColumn("profit", F.col("sales") - 150000)
    annual = gain.groupBy("symbol_id", F.make_date(F.year("report_date") + 1, F.lit(3), F.lit(1)).alias("available_at")).agg(F.sum("profit").alias("annual_profit"))
    return va.ttm_grid(bars(s, d).select(*KEY, "close"), co.trailing_year(gain, "profit").filter("ttm_profit is not null").select("symbol_id", "available_at", "ttm_profit"), annual)


def stock(s, d):
    return ttm(s, d).join(master(s, d).select("symbol_id", "sector", F.col("parent").alias("universe")), "symbol_id").withColumn("market_cap", 1000 * F.col("close") * (1 + F.col("symbol_id") % 9))


R.add("fu4_ttm_grid", lambda s, d: ttm(s, d).select(*KEY, "ttm_profit", "earnings_source"), "ttm", f"SELECT symbol_id, trade_date, {r('ttm_profit', 'ttm_profit')}, earnings_source FROM ttm")

# --- indices ------------------------------------------------------------------------------------------------
SQL |= {
    "ix0": "SELECT *, CASE WHEN trade_date - lag(trade_date) OVER w BETWEEN 1 AND 7 THEN close / nullif(lag(close) OVER w, 0) - 1 END AS x FROM stock WINDOW w AS (PARTITION BY universe, symbol_id ORDER BY trade_date)",
    "ix1": "SELECT universe, trade_date, count(symbol_id) AS constituents, sum(market_cap) AS total_cap, coalesce(sum(ttm_profit), 0) AS total_profit, avg(x) AS e, sum(market_cap * x) / nullif(sum(market_cap), 0) AS c FROM ix0 GROUP BY ALL",
    "ix": """SELECT *, total_cap / nullif(total_profit, 0) AS pe_ttm, total_profit / nullif(total_cap, 0) AS earnings_yield, product(1 + coalesce(return_1d, 0)) OVER (PARTITION BY universe, index_type ORDER BY trade_date) AS grown
FROM (SELECT * EXCLUDE (e, c), 'equal_weight' AS index_type, e AS return_1d FROM ix1 UNION ALL SELECT * EXCLUDE (e, c), 'market_cap_weight', c FROM ix1)""",
}
NEEDS |= {"ix0": ["stock"], "ix1": ["ix0"], "ix": ["ix1"]}
IX = ["universe", "index_type", "trade_date"]
R.add("fu5_universe_index", lambda s, d: va.universe_index(stock(s, d)).select(*IX, F.ln("level").alias("log_level"), "return_1d", "constituents", "pe_ttm", "earnings_yield"), "ix", f"SELECT {', '.join(IX)}, {r('ln(1000 * grown)', 'log_level')}, {r('return_1d', 'return_1d')}, constituents, {r('pe_ttm', 'pe_ttm')}, {r('earnings_yield', 'earnings_yield')} FROM ix")

U = lambda n, k: f"OVER (PARTITION BY {k} ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def place(n: int, least: str, k: str) -> str:
    seen, last = f"list(pe_ttm) {U(n, k)}", f"last_value(pe_ttm IGNORE NULLS) {U(n, k)}"
    return f"CASE WHEN count(pe_ttm) {U(n, k)} >= {least} THEN {seen} END AS l{n}, {last} AS v{n}, count(pe_ttm) {U(n, k)} AS c{n}"


def placed(n: int) -> str:
    return f"round(100 * (len(list_filter(l{n}, lambda x: x < v{n})) + (len(list_filter(l{n}, lambda x: x = v{n})) + 1) / 2) / c{n}, 9)"


def spread(n: int, least: str, k: str) -> str:
    return f"CASE WHEN count(pe_ttm) {U(n, k)} >= {least} THEN (pe_ttm - avg(pe_ttm) {U(n, k)}) / nullif(stddev_samp(pe_ttm) {U(n, k)}, 0) END"


def middle(n: int, least: str, k: str) -> str:
    return f"CASE WHEN count(pe_ttm) {U(n, k)} >= {least} THEN quantile_cont(pe_ttm, 0.5) {U(n, k)} END"


SQL |= {
    "uv0": """SELECT universe, trade_date, sum(market_cap) AS total_cap, coalesce(sum(CASE WHEN ttm_profit > 0 THEN market_cap END), 0) AS profit_cap, coalesce(sum(CASE WHEN ttm_profit > 0 THEN ttm_profit END), 0) AS p, coalesce(sum(CASE WHEN ttm_profit > 0 THEN NULL ELSE market_cap END), 0) AS loss_cap FROM stock GROUP BY ALL""",
    "uv1": "SELECT *, CASE WHEN p > 0 THEN profit_cap / p END AS pe_ttm, CASE WHEN profit_cap > 0 THEN p / profit_cap END AS earnings_yield, CASE WHEN total_cap > 0 THEN loss_cap / total_cap END AS loss_share FROM uv0",
    "uv2": f"""SELECT *, CASE WHEN count(pe_ttm) {U(200, 'universe')} >= 20 THEN avg(pe_ttm) {U(200, 'universe')} END AS pe_200dma, {middle(252, '20', 'universe')} AS pe_1y_median, {middle(756, '60', 'universe')} AS pe_3y_median, {middle(1260, '60', 'universe')} AS pe_5y_median,
{spread(756, '60', 'universe')} AS pe_zscore_3y, {spread(1260, '60', 'universe')} AS pe_zscore_5y, {place(756, '60', 'universe')}, {place(1260, '60', 'universe')} FROM uv1""",
    "uv3": f"SELECT *, {placed(756)} AS pe_percentile_3y, {placed(1260)} AS pe_percentile_5y FROM uv2",
    "uv": "SELECT *, CASE WHEN z < 10 THEN 'deep_value_panic' WHEN z < 25 THEN 'cheap' WHEN z < 60 THEN 'fair' WHEN z < 80 THEN 'expensive' WHEN z < 90 THEN 'late_bull' WHEN z IS NOT NULL THEN 'bubble_top_risk' ELSE 'unknown' END AS valuation_zone FROM (SELECT *, coalesce(pe_percentile_5y, pe_percentile_3y) AS z FROM uv3)",
}
NEEDS |= {"uv0": ["stock"], "uv1": ["uv0"], "uv2": ["uv1"], "uv3": ["uv2"], "uv": ["uv3"]}
UV = ["pe_ttm", "earnings_yield", "loss_share", "pe_200dma", "pe_1y_median", "pe_3y_median", "pe_5y_median", "pe_zscore_3y", "pe_zscore_5y", "pe_percentile_3y", "pe_percentile_5y"]
R.add("fu9_universe_valuation", lambda s, d: va.universe_valuation(stock(s, d)).select("universe", "trade_date", *UV, "valuation_zone"), "uv", f"SELECT universe, trade_date, {', '.join(r(c, c) for c in UV)}, valuation_zone FROM uv")
R.add("fu29_valuation_cycle", lambda s, d: va.valuation_cycle(va.universe_valuation(stock(s, d))).select("universe", "trade_date", "pe_distance", "cycle_signal"), "uv", f"""WITH x AS (SELECT *, 100 * (pe_ttm / nullif(pe_200dma, 0) - 1) AS d FROM uv), y AS (SELECT *, coalesce(d, 0) AS e, coalesce(pe_percentile_5y, 0) AS pl FROM x)
SELECT universe, trade_date, {r('d', 'pe_distance')}, CASE WHEN e > 0 AND pl > 80 THEN 'expensive_bull_phase' WHEN e < 0 AND pl < 25 THEN 'valuation_reset_bear_phase' WHEN e > 0 AND pl < 40 THEN 'early_bull_recovery' WHEN e < 0 AND valuation_zone IN ('late_bull', 'bubble_top_risk') THEN 'top_risk_warning' ELSE 'neutral' END AS cycle_signal FROM y""")
entities = lambda s, d: va.universe_index(stock(s, d)).filter("index_type = 'market_cap_weight' and pe_ttm is not null").select(F.col("universe").alias("entity"), "trade_date", "pe_ttm")
SQL["ent"] = "SELECT *, CASE WHEN n >= 756 OR n < 252 THEN 756 ELSE 252 END AS least FROM (SELECT universe AS entity, trade_date, pe_ttm, count(*) OVER (PARTITION BY universe) AS n FROM ix WHERE index_type = 'market_cap_weight' AND pe_ttm IS NOT NULL)"
NEEDS["ent"] = ["ix"]
CF = ["pe_pctile_3y", "pe_pctile_5y", "pe_pctile_10y", "pe_median_5y", "pe_avg_5y", "pe_zscore_3y", "pe_zscore_5y", "pe_zscore_10y"]
YEARS = (("3y", 756), ("5y", 1260), ("10y", 2520))
R.add("fu8_cycle_features", lambda s, d: va.cycle_features(entities(s, d)).select("entity", "trade_date", *CF, "valuation_zone", "cycle_signal"), "ent", f"""WITH a AS (SELECT *, {', '.join(f"{place(n, 'least', 'entity')}, {spread(n, 'least', 'entity')} AS pe_zscore_{y}" for y, n in YEARS)}, {middle(1260, 'least', 'entity')} AS pe_median_5y, CASE WHEN count(pe_ttm) {U(1260, 'entity')} >= least THEN avg(pe_ttm) {U(1260, 'entity')} END AS pe_avg_5y FROM ent),
b AS (SELECT *, {', '.join(f'{placed(n)} AS pe_pctile_{y}' for y, n in YEARS)} FROM a), c AS (SELECT *, coalesce(pe_pctile_10y, pe_pctile_5y, pe_pctile_3y) AS p, coalesce(pe_zscore_10y, pe_zscore_5y, pe_zscore_3y) AS z FROM b),
e AS (SELECT *, CASE WHEN p IS NULL THEN 'unknown' WHEN p < 10 THEN 'depressed' WHEN p < 20 THEN 'cheap' WHEN p > 90 THEN 'bubble' WHEN p > 80 THEN 'expensive' ELSE 'fair' END AS valuation_zone FROM c)
SELECT entity, trade_date, {', '.join(r(c, c) for c in CF)}, valuation_zone, CASE WHEN valuation_zone IN ('depressed', 'cheap') AND z < -1 THEN 'bottom_zone' WHEN valuation_zone = 'bubble' AND z > 1.5 THEN 'top_zone' ELSE 'neutral' END AS cycle_signal FROM e""")
sector_pe = lambda s, d: stock(s, d).groupBy("sector", "trade_date").agg((F.sum("market_cap") / F.nullif(F.sum("ttm_profit"), F.lit(0.0))).alias("pe_ttm"))

# --- choices ------------------------------------------------------------------------------------------------
SQL["stmt"] = "SELECT o_custkey AS symbol_id, CASE WHEN o_orderpriority LIKE '1%' THEN ' Standalone ' WHEN o_orderpriority LIKE '5%' THEN '' ELSE 'consolidated' END AS basis, CASE WHEN o_orderkey % 4 = 0 THEN 'annual' ELSE 'quarterly' END AS period_type, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS report_date FROM orders"


def statements(s, d):
    p = F.col("o_orderpriority")
    basis = F.when(p.startswith("1"), " Standalone ").when(p.startswith("5"), "").otherwise("consolidated")
    return table(s, d, "orders").select(F.col("o_custkey").alias("symbol_id"), basis.alias("basis"), F.when(F.col("o_orderkey") % 4 == 0, "annual").otherwise("quarterly").alias("period_type"), F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("report_date"))


N = lambda b, p: f"count(DISTINCT CASE WHEN b = '{b}' AND period_type = '{p}' THEN report_date END)"
R.add("fu19_statement_basis", lambda s, d: va.statement_basis(statements(s, d)), "stmt", f"""WITH k AS (SELECT *, CASE WHEN trim(lower(basis)) = '' THEN 'standalone' ELSE trim(lower(basis)) END AS b FROM stmt),
g AS (SELECT symbol_id, max(report_date) FILTER (WHERE b = 'consolidated' AND period_type = 'quarterly') AS c, max(report_date) FILTER (WHERE b = 'standalone' AND period_type = 'quarterly') AS a, {N('consolidated', 'quarterly')} >= least({N('standalone', 'quarterly')}, 5) AND {N('consolidated', 'annual')} >= least({N('standalone', 'annual')}, 2) AS e, bool_or(b = 'standalone') AS alone FROM k GROUP BY symbol_id),
x AS (SELECT *, CASE WHEN c IS NOT NULL AND a IS NULL AND e THEN 'consolidated_only_quarterly' WHEN c >= a AND e THEN 'consolidated_current' WHEN alone AND c IS NULL THEN 'standalone_fallback_no_consolidated_quarterly' WHEN alone AND NOT e THEN 'standalone_fallback_insufficient_consolidated_history' WHEN alone THEN 'standalone_fallback_newer_quarter' ELSE 'consolidated_only_no_quarterly' END AS reason FROM g)
SELECT symbol_id, c AS consolidated_latest, a AS standalone_latest, split_part(reason, '_', 1) AS basis, reason FROM x""")
R.add("fu26_scope", lambda s, d: va.statement_scope(statements(s, d).groupBy("symbol_id", F.when(F.trim("basis") == "consolidated", "consolidated").otherwise("standalone").alias("scope")).agg((F.count_if(F.col("period_type") == "quarterly") / F.count("*")).alias("completeness"))), "stmt", f"""WITH x AS (SELECT symbol_id, CASE WHEN trim(basis) = 'consolidated' THEN 'consolidated' ELSE 'standalone' END AS scope, count(*) FILTER (WHERE period_type = 'quarterly') / count(*) AS completeness FROM stmt GROUP BY ALL),
y AS (SELECT symbol_id, max(completeness) FILTER (WHERE scope = 'consolidated' AND completeness >= 0.7) AS c, max(completeness) FILTER (WHERE scope = 'standalone' AND completeness > 0) AS a FROM x GROUP BY symbol_id)
SELECT symbol_id, CASE WHEN c IS NOT NULL THEN 'consolidated' WHEN a IS NOT NULL THEN 'standalone' ELSE 'SCOPE_UNRESOLVED' END AS scope, {r('coalesce(c, a, 0)', 'completeness')}, CASE WHEN c IS NOT NULL THEN 'consolidated_usable' WHEN a IS NOT NULL THEN 'standalone_fallback_no_splicing' ELSE 'no_usable_scope' END AS reason FROM y""")
seg = lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.when(F.col("c_custkey") % 11 == 0, "AMBIGUOUS").otherwise("RESOLVED").alias("identity_status"), F.when(F.col("c_mktsegment") == "BUILDING", "SME").when(F.col("c_mktsegment") == "MACHINERY", "BOARD_UNKNOWN").otherwise("MAIN").alias("board_status"), F.col("c_acctbal").alias("market_cap"), F.when(F.col("c_nationkey") > 2, F.col("c_nationkey") / 25).alias("completeness"))
R.add("fu25_disposition", lambda s, d: va.disposition(seg(s, d), 1000, 8000).select("symbol_id", "disposition"), "", """SELECT c_custkey AS symbol_id, CASE WHEN c_custkey % 11 = 0 THEN 'DATA_REPAIR_REQUIRED' WHEN c_mktsegment = 'MACHINERY' THEN 'ELIGIBILITY_UNKNOWN' WHEN c_mktsegment = 'BUILDING' THEN 'INELIGIBLE_BOARD_OR_INSTRUMENT' WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN 'ELIGIBILITY_UNKNOWN' WHEN c_acctbal NOT BETWEEN 1000 AND 8000 THEN 'INELIGIBLE_MARKET_CAP' WHEN c_nationkey <= 2 OR c_nationkey / 25 < 0.7 THEN 'DATA_REPAIR_REQUIRED' ELSE 'BOUNDARY_REVIEW' END AS disposition FROM customer""")

# --- industries and results ---------------------------------------------------------------------------------
SQL["ind"] = """SELECT nation AS sector, report_date, count(*) AS companies, round(100 * avg(yoy), 6) AS sales_growth, round(100 * sum(sales - 140000) / sum(sales), 6) AS opm, round(10 * avg(orders) - 5, 6) AS roce, round(100 * quantile_cont(qoq, 0.5), 6) AS return_1y, round(quantile_cont(sales, 0.5) / 4000 - 10, 6) AS median_pe FROM gr JOIN (SELECT c_custkey AS symbol_id, c_nationkey AS nation FROM customer) USING (symbol_id) GROUP BY ALL"""
NEEDS["ind"] = ["gr"]


def industries(s, d):
    nation = table(s, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_nationkey").alias("sector"))
    six = lambda c: F.round(c, 6)
    return gr(s, d).join(nation, "symbol_id").groupBy("sector", "report_date").agg(F.count("*").alias("companies"), six(100 * F.avg("yoy")).alias("sales_growth"), six(100 * F.sum(F.col("sales") - 140000) / F.sum("sales")).alias("opm"), six(10 * F.avg("orders") - 5).alias("roce"), six(100 * F.percentile("qoq", F.lit(0.5))).alias("return_1y"), six(F.percentile("sales", F.lit(0.5)) / 4000 - 10).alias("median_pe"))


CL = lambda c: f"CASE WHEN {c} IS NOT NULL THEN greatest({float(va.BOUNDS[c][0])}, least({float(va.BOUNDS[c][1])}, {c})) END"
PC = lambda c: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY report_date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY report_date, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY report_date) END"
SQL |= {
    "is0": f"SELECT *, {CL('sales_growth')} AS a, {CL('opm')} AS b, {CL('roce')} AS c, {CL('return_1y')} AS e, CASE WHEN median_pe > 0 THEN {CL('median_pe')} END AS f FROM ind",
    "is1": f"SELECT *, coalesce(100 * {PC('a')}, 50) AS g, 0.5 * coalesce(100 * {PC('c')}, 50) + 0.5 * coalesce(100 * {PC('b')}, 50) AS q, coalesce(100 - 100 * {PC('f')}, 50) AS v, coalesce(100 * {PC('e')}, 50) AS m FROM is0",
    "is2": "SELECT * EXCLUDE (a, b, c, e, f, g, q, v, m), round(round(g, 9), 2) AS growth_score, round(round(q, 9), 2) AS quality_score, round(round(v, 9), 2) AS valuation_score, round(round(m, 9), 2) AS momentum_score, round(round(0.3 * g + 0.3 * q + 0.2 * v + 0.2 * m, 9), 2) AS fundamental_score, (sales_growth IS NULL)::INT + (opm IS NULL)::INT + (roce IS NULL)::INT + (return_1y IS NULL)::INT + (median_pe IS NULL)::INT AS missing FROM is1",
    "isc": """SELECT *, concat_ws(';', CASE WHEN companies < 5 THEN 'low_company_count' END, CASE WHEN median_pe > 60 THEN 'expensive_sector' END, CASE WHEN opm < 0 THEN 'negative_opm' END, CASE WHEN roce < 8 THEN 'weak_roce' END, CASE WHEN sales_growth > 150 OR sales_growth < -50 THEN 'extreme_sales_growth' END, CASE WHEN opm < -50 OR opm > 80 THEN 'distorted_operating_margin' END, CASE WHEN missing >= 3 THEN 'missing_key_metrics' END) AS warnings,
CASE WHEN companies < 3 OR sales_growth > 200 OR sales_growth < -75 OR opm < -50 OR missing >= 3 THEN 'DISTORTED_DATA' WHEN fundamental_score >= 70 AND growth_score >= 65 AND quality_score >= 65 AND NOT coalesce(opm < -50 OR opm > 80, false) THEN 'QUALITY_GROWTH_LEADER' WHEN momentum_score >= 70 AND valuation_score <= 35 THEN 'EXPENSIVE_MOMENTUM'
WHEN valuation_score >= 65 AND quality_score >= 55 AND momentum_score <= 50 THEN 'VALUE_ROTATION_CANDIDATE' WHEN growth_score >= 60 AND momentum_score <= 55 AND valuation_score >= 50 THEN 'CYCLICAL_RECOVERY' WHEN fundamental_score < 40 OR quality_score < 35 THEN 'WEAK_FUNDAMENTALS' ELSE 'BALANCED' END AS label FROM is2""",
}
NEEDS |= {"is0": ["ind"], "is1": ["is0"], "is2": ["is1"], "isc": ["is2"]}
SCORES = ["growth_score", "quality_score", "valuation_score", "momentum_score", "fundamental_score"]
scored = lambda s, d: va.industry_scores(industries(s, d), "report_date")
R.add("fu17_industry_scores", lambda s, d: scored(s, d).select("sector", "report_date", *SCORES, "warnings", "label"), "isc", f"SELECT sector, report_date, {', '.join(SCORES)}, warnings, label FROM isc")


def trends(s, d):
    now = scored(s, d)
    return va.industry_trends(now, now.withColumn("report_date", F.last_day(F.add_months("report_date", 3))), "sector", "report_date")


D = lambda c: f"coalesce(round(n.{c} - o.{c}, 6), 0)"
ERODED = f"({D('quality_score')} < -3 OR {D('roce')} < -2 OR {D('opm')} < -3)"
R.add("fu18_industry_trends", lambda s, d: trends(s, d).select("sector", "report_date", "fundamental_score_delta", "trend"), "isc", f"""SELECT n.sector, n.report_date, {r('n.fundamental_score - o.fundamental_score', 'fundamental_score_delta')}, CASE WHEN o.fundamental_score IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN {D('fundamental_score')} > 5 AND NOT {ERODED} THEN 'IMPROVING' WHEN {D('fundamental_score')} < -5 OR {ERODED} THEN 'DETERIORATING'
WHEN {D('momentum_score')} > 10 AND {D('growth_score')} >= 0 THEN 'MOMENTUM_BUILDING' WHEN {D('momentum_score')} < -10 THEN 'MOMENTUM_FADING' WHEN {D('valuation_score')} > 8 AND {D('quality_score')} < 0 THEN 'VALUE_TRAP_RISK' ELSE 'STABLE' END AS trend FROM isc n LEFT JOIN isc o ON o.sector = n.sector AND last_day(o.report_date + INTERVAL 3 MONTH) = n.report_date""")

SQL["res"] = f"""SELECT *, 100 * yoy AS sales_yoy, 100 * qoq AS sales_qoq, 120 * yoy AS op_yoy, 110 * qoq AS op_qoq, CASE WHEN orders > 1 THEN 90 * yoy END AS profit_yoy, 95 * qoq AS profit_qoq, 500 * yoy AS opm_yoy_bps, 400 * qoq AS opm_qoq_bps, positive_4 AS sales_up, positive_4 AS profit_up, sum(CASE WHEN yoy > 0 THEN 1 ELSE 0 END) {Q4} AS margin_up FROM gr"""
NEEDS["res"] = ["gr"]


def results(s, d):
    y, q = F.col("yoy"), F.col("qoq")
    up = F.sum(F.when(y > 0, 1).otherwise(0)).over(along(order="report_date").rowsBetween(-3, 0))
    return gr(s, d).withColumns({"sales_yoy": 100 * y, "sales_qoq": 100 * q, "op_yoy": 120 * y, "op_qoq": 110 * q, "profit_yoy": F.when(F.col("orders") > 1, 90 * y), "profit_qoq": 95 * q, "opm_yoy_bps": 500 * y, "opm_qoq_bps": 400 * q, "sales_up": F.col("positive_4"), "profit_up": F.col("positive_4"), "margin_up": up})


PART = " + ".join(f"{w} * coalesce(CASE WHEN {c} IS NOT NULL THEN greatest(0.0, least(100.0, ({c} - {a}) / ({b} - {a}) * 100)) END, 50)" for c, (w, a, b) in va.RESULT_WEIGHTS.items())
Z = lambda c: f"coalesce({c}, 0)"
R.add("fu20_result_scores", lambda s, d: va.result_scores(rk.latest(results(s, d), order="report_date")).select("symbol_id", "report_date", "low_base", "penalty", "result_score", "result_bucket"), "res", f"""WITH a AS (SELECT *, profit_yoy IS NULL OR profit_yoy > 150 OR coalesce(profit_yoy > 80 AND profit_qoq > 40, false) AS low_base FROM res QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY report_date DESC) = 1),
b AS (SELECT *, CASE WHEN low_base THEN 10.0 ELSE 0 END + CASE WHEN sales_yoy < 5 AND profit_yoy > 50 THEN 10.0 ELSE 0 END + CASE WHEN opm_yoy_bps < -200 THEN 15.0 ELSE 0 END AS penalty FROM a),
c AS (SELECT *, round(round(greatest(0.0, least(100.0, {PART} + 0.10 * (least(4, sales_up) + least(4, profit_up) + least(4, margin_up)) / 12 * 100 - penalty)), 9), 2) AS result_score FROM b)
SELECT symbol_id, report_date, low_base, CAST(penalty AS DOUBLE) AS penalty, CAST(result_score AS DOUBLE) AS result_score, CASE WHEN result_score < 45 OR {Z('opm_yoy_bps')} <= -200 OR {Z('profit_yoy')} < 0 THEN 'DETERIORATING' WHEN result_score >= 85 AND {Z('sales_yoy')} >= 25 AND {Z('op_yoy')} >= 40 AND {Z('opm_yoy_bps')} >= 300 THEN 'BLOWOUT_RESULT' WHEN result_score >= 75 AND {Z('sales_yoy')} >= 15 AND {Z('op_yoy')} >= 25 AND {Z('opm_yoy_bps')} >= 100 THEN 'GREAT_RESULT'
WHEN result_score >= 70 AND {Z('sales_qoq')} >= 5 AND {Z('op_qoq')} >= 10 AND {Z('opm_qoq_bps')} >= 75 THEN 'RESULT_ACCELERATION' WHEN {Z('opm_yoy_bps')} >= 200 AND {Z('op_yoy')} >= 20 THEN 'MARGIN_EXPANSION' WHEN {Z('profit_yoy')} >= 50 AND {Z('sales_yoy')} >= 10 AND {Z('opm_yoy_bps')} >= 300 THEN 'TURNAROUND' ELSE 'IGNORE' END AS result_bucket FROM c""")

# --- candidate lists ----------------------------------------------------------------------------------------
funds = lambda s, d: gr(s, d).withColumns({"fundamental_status": F.when(F.col("orders") > 2, "MISSING").when(F.col("orders") > 1, "AVAILABLE").otherwise("available"), "revenue_yoy": 100 * F.col("yoy"), "pat_yoy": 30 * F.col("qoq"), "opm_change": F.col("qoq") - F.col("yoy"), "profit_quarters": F.col("positive_4"), "margin_quarters": F.col("positive_4") - 1})
R.add("wl20_fundamental_points", lambda s, d: ca.fundamental_points(funds(s, d)).select("symbol_id", "report_date", "fundamental_score", "fa_missing", "fa_improvement", "fa_trigger_confirmed"), "gr", """SELECT symbol_id, report_date, CAST(CASE WHEN orders > 2 THEN 10 ELSE CASE WHEN yoy > 0 THEN 5 ELSE 0 END + CASE WHEN 100 * yoy > 10 THEN 3 ELSE 0 END + CASE WHEN qoq > 0 THEN 5 ELSE 0 END + CASE WHEN qoq - yoy > 0 THEN 3 ELSE 0 END + CASE WHEN positive_4 >= 3 THEN 4 ELSE 0 END END AS INTEGER) AS fundamental_score,
orders > 2 AS fa_missing, coalesce(yoy > 0, false) OR coalesce(qoq > 0, false) OR coalesce(qoq - yoy > 0, false) AS fa_improvement, coalesce(30 * qoq > 15, false) OR coalesce(100 * yoy > 20, false) AS fa_trigger_confirmed FROM gr""")

VERDICT = "CASE WHEN conviction >= 80 THEN 'HIGH_CONVICTION' WHEN conviction >= 55 THEN 'medium_conviction' WHEN conviction >= 35 THEN 'WATCH_ONLY' ELSE 'NOISE_TRAP' END"
SQL["cand"] = f"""SELECT symbol_id, trade_date, close, high, low, volume, setup_family, conviction AS final_score, {VERDICT} AS verdict, volume_ratio, close < low + 0.35 * (high - low) AS hard_trap_flag, volume_ratio > 1.2 AS credible_trigger, CASE WHEN symbol_id % 3 = 0 THEN ' ' ELSE setup_family END AS trigger_reason, CASE WHEN symbol_id % 2 = 0 THEN 'base' END AS move_tag, CASE WHEN symbol_id % 5 = 0 THEN low * 0.99 END AS invalidation_price FROM bo"""
NEEDS["cand"] = ["bo"]


def cand(s, d):
    return mk.breakouts(bars(s, d)).select(
        *KEY, "close", "high", "low", "volume", "setup_family", F.col("conviction").alias("final_score"), F.expr(VERDICT).alias("verdict"), "volume_ratio", F.expr("close < low + 0.35 * (high - low)").alias("hard_trap_flag"), F.expr("volume_ratio > 1.2").alias("credible_trigger"),
        F.expr("CASE WHEN symbol_id % 3 = 0 THEN ' ' ELSE setup_family END").alias("trigger_reason"), F.expr("CASE WHEN symbol_id % 2 = 0 THEN 'base' END").alias("move_tag"), F.expr("CASE WHEN symbol_id % 5 = 0 THEN low * 0.99 END").alias("invalidation_price"),
    )


R.add("wl22_final_gate", lambda s, d: ca.final_gate(cand(s, d).join(master(s, d).select("symbol_id", "sector"), "symbol_id")).select(*KEY, "thesis", "invalidation_level", "invalidation_source", "gate_status"), "cand master", f"""WITH x AS (SELECT *, coalesce(nullif(trim(trigger_reason), ''), 'investigator trigger') AS t FROM cand JOIN master USING (symbol_id))
SELECT symbol_id, trade_date, concat_ws('; ', t, CASE WHEN move_tag <> t THEN move_tag END, 'sector ' || sector, 'score ' || printf('%.2f', final_score), verdict) AS thesis, {r('coalesce(invalidation_price, low)', 'invalidation_level')}, CASE WHEN invalidation_price IS NOT NULL THEN 'invalidation_price' ELSE 'low' END AS invalidation_source, 'PENDING' AS gate_status
FROM x WHERE final_score >= 55 AND NOT hard_trap_flag AND (coalesce(credible_trigger, false) OR verdict = 'HIGH_CONVICTION')""")

SQL["track"] = """SELECT *, CASE WHEN symbol_id % 7 = 0 THEN NULL ELSE final_score + (symbol_id % 4) * 10 END AS composite, 1 + symbol_id % 4 AS appearances, CAST(day(trade_date) AS INTEGER) AS days_since_seen, close - (high + low) / 2 AS price_progression_pct, (symbol_id % 9) - 4 AS rank_change_20d, symbol_id % 2 AS sector_support_score, symbol_id % 5 AS sector_cluster_count, symbol_id % 13 = 0 AS sector_rotation, false AS fa_trigger_confirmed, hard_trap_flag AND symbol_id % 3 = 0 AS long_upper_wick_trap, volume_ratio < 0.5 AS low_delivery_flag, volume_ratio < 0.9 AS volume_declining, volume_ratio > 3 AS volume_escalation, symbol_id % 17 = 0 AS fa_improvement, CAST(NULL AS BOOLEAN) AS high_priority_repeat FROM cand"""
NEEDS["track"] = ["cand"]


def tracked(s, d):
    return cand(s, d).selectExpr(
        "*", "CASE WHEN symbol_id % 7 = 0 THEN NULL ELSE final_score + (symbol_id % 4) * 10 END AS composite", "1 + symbol_id % 4 AS appearances", "day(trade_date) AS days_since_seen", "close - (high + low) / 2 AS price_progression_pct", "(symbol_id % 9) - 4 AS rank_change_20d", "symbol_id % 2 AS sector_support_score", "symbol_id % 5 AS sector_cluster_count", "symbol_id % 13 = 0 AS sector_rotation",
        "false AS fa_trigger_confirmed", "hard_trap_flag AND symbol_id % 3 = 0 AS long_upper_wick_trap", "volume_ratio < 0.5 AS low_delivery_flag", "volume_ratio < 0.9 AS volume_declining", "volume_ratio > 3 AS volume_escalation", "symbol_id % 17 = 0 AS fa_improvement", "CAST(NULL AS BOOLEAN) AS high_priority_repeat",
    )


KEEP = "(final_score >= 55 OR appearances >= 3 OR price_progression_pct > 0 OR rank_change_20d < 0 OR sector_rotation)"
TR = "coalesce(credible_trigger, false)"
R.add("wl24_lifecycle", lambda s, d: ca.lifecycle(tracked(s, d)).select(*KEY, "status", "drop_reason"), "track", f"""WITH x AS (SELECT *, CASE WHEN verdict = 'NOISE_TRAP' THEN 'NOISE_TRAP' WHEN long_upper_wick_trap THEN 'LONG_UPPER_WICK_TRAP' WHEN low_delivery_flag AND appearances <= 1 AND days_since_seen > 0 THEN 'LOW_DELIVERY_NO_REPEAT' WHEN composite < 35 AND NOT {TR} THEN 'LOW_RANK_NO_NEWS'
WHEN days_since_seen >= 5 AND appearances <= 1 AND price_progression_pct < 0 AND NOT {TR} AND NOT (sector_support_score > 0 OR sector_rotation) THEN 'ONE_CANDLE_DRAMA' WHEN days_since_seen >= 10 AND appearances < 2 AND volume_declining AND NOT volume_escalation AND rank_change_20d >= 0 THEN 'STALE_NO_REPEAT'
WHEN days_since_seen >= 20 AND appearances < 3 AND NOT fa_improvement AND sector_cluster_count < 3 AND NOT {KEEP} THEN 'FAILED_FOLLOW_THROUGH' ELSE '' END AS drop_reason FROM track)
SELECT symbol_id, trade_date, CASE WHEN drop_reason IN ('ONE_CANDLE_DRAMA', 'STALE_NO_REPEAT') THEN 'DROPPED' WHEN drop_reason <> '' THEN 'ARCHIVED' WHEN verdict = 'HIGH_CONVICTION' THEN 'HIGH_CONVICTION' WHEN final_score >= 55 THEN 'ACTIVE_RESEARCH' WHEN verdict = 'WATCH_ONLY' THEN 'WATCHLIST' WHEN appearances <= 1 THEN 'NEW_TRIGGER' ELSE 'TRACKING' END AS status, drop_reason FROM x""")

gated = lambda s, d: cand(s, d).filter("setup_family is not null").selectExpr("symbol_id", "date_add(trade_date, CAST(symbol_id % 3 AS INT)) AS entry_date", "final_score", "low AS invalidation_level")
LEADS = ", ".join(f"lead(close, {k}) {W} AS c{k}" for k in range(1, 5))
R.add("wl26_exit_monitoring", lambda s, d: ca.exit_monitoring(gated(s, d), bars(s, d)), "cand", f"""WITH g AS (SELECT symbol_id, trade_date + CAST(symbol_id % 3 AS INTEGER) AS entry_date, final_score, low AS invalidation_level FROM cand WHERE setup_family IS NOT NULL),
p AS (SELECT symbol_id, trade_date, close, {LEADS}, row_number() {W} AS n, count(*) OVER (PARTITION BY symbol_id) AS total, max(trade_date) OVER (PARTITION BY symbol_id) AS last_date, arg_max(close, trade_date) OVER (PARTITION BY symbol_id) AS last_close FROM bars),
m AS (SELECT g.*, p.* EXCLUDE (symbol_id), trade_date = entry_date AS same FROM g ASOF LEFT JOIN p ON g.symbol_id = p.symbol_id AND g.entry_date >= p.trade_date), a AS (SELECT *, nullif(total - n + same::INT, 0) AS after FROM m),
b AS (SELECT *, CASE WHEN after IS NULL THEN 'UNKNOWN' WHEN after < 4 THEN 'PENDING_3D' WHEN greatest(c1, c2, c3, CASE WHEN NOT same THEN c4 END) > close AND last_close >= close THEN 'CONFIRMED' ELSE 'FAILED_3D' END AS followthrough, CASE WHEN after IS NOT NULL THEN last_close < invalidation_level END AS breached FROM a),
c AS (SELECT *, CASE WHEN breached THEN 'INVALIDATION_BREACH' WHEN followthrough = 'FAILED_3D' THEN 'FAILED_3D_FOLLOWTHROUGH' WHEN final_score < 55 THEN 'SCORE_BELOW_55' WHEN followthrough = 'UNKNOWN' THEN 'UNKNOWN_DATA' ELSE 'NONE' END AS exit_reason FROM b)
SELECT symbol_id, entry_date, CAST(final_score AS DOUBLE) AS final_score, {r('invalidation_level', 'invalidation_level')}, CAST(CASE WHEN after IS NOT NULL THEN last_date - entry_date END AS INTEGER) AS days_since_entry, {r('CASE WHEN after IS NOT NULL THEN last_close END', 'latest_close')}, breached, followthrough, exit_reason NOT IN ('NONE', 'UNKNOWN_DATA') AS exit_triggered, exit_reason FROM c""")


def views(s, d):
    last = rk.latest(rk.returns(cand(s, d), 20))
    top = last.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("ret_20", 6)), "symbol_id"))).filter("rank <= 40")
    a = top.select("symbol_id", "rank", F.col("final_score").alias("composite"), F.when(F.col("symbol_id") % 2 == 0, F.col("close")).alias("close"), F.lit(None).cast("double").alias("rel_strength"))
    b = last.filter("symbol_id % 3 <> 0").selectExpr("symbol_id", "final_score AS pattern_score", "final_score >= 20 AS pattern_positive", "CASE WHEN symbol_id % 4 = 0 THEN low END AS close", "ret_20 AS rel_strength")
    return a, b, last.filter("symbol_id % 4 <> 0").selectExpr("symbol_id", "final_score AS breakout_score", "final_score >= 10 AS breakout_positive", "high AS close", "-ret_20 AS rel_strength")


R.add("wl29_scan_view", lambda s, d: ca.scan_view(*views(s, d)), "cand", f"""WITH l AS (SELECT *, 100 * (close / nullif(lag(close, 20) {W}, 0) - 1) AS ret FROM cand {LATEST}), a AS (SELECT symbol_id, row_number() OVER (ORDER BY round(ret, 6) DESC NULLS LAST, symbol_id) AS rank, final_score AS composite, CASE WHEN symbol_id % 2 = 0 THEN close END AS close FROM l QUALIFY rank <= 40),
b AS (SELECT symbol_id, final_score AS pattern_score, final_score >= 20 AS pp, CASE WHEN symbol_id % 4 = 0 THEN low END AS close, ret FROM l WHERE symbol_id % 3 <> 0), c AS (SELECT symbol_id, final_score AS breakout_score, final_score >= 10 AS bp, high AS close, -ret AS ret FROM l WHERE symbol_id % 4 <> 0),
j AS (SELECT symbol_id, CAST(rank AS INTEGER) AS rank, composite, pattern_score, coalesce(pp, false) AS pattern_positive, breakout_score, coalesce(bp, false) AS breakout_positive, coalesce(a.close, b.close, c.close) AS close, coalesce(b.ret, c.ret) AS rel_strength FROM a FULL JOIN b USING (symbol_id) FULL JOIN c USING (symbol_id)),
k AS (SELECT *, CASE WHEN rank IS NOT NULL THEN 0 WHEN pattern_positive THEN 1 WHEN breakout_positive THEN 2 END AS scan_group, rank IS NULL AND pattern_positive AS discovered_by_pattern FROM j)
SELECT symbol_id, rank, CAST(composite AS DOUBLE) AS composite, {r('close', 'close')}, {r('rel_strength', 'rel_strength')}, CAST(pattern_score AS DOUBLE) AS pattern_score, pattern_positive, CAST(breakout_score AS DOUBLE) AS breakout_score, breakout_positive, scan_group, discovered_by_pattern FROM k WHERE scan_group IS NOT NULL""")

bundle = lambda s, d: cand(s, d).selectExpr(*KEY, "symbol_id % 41 = 0 AS review_eligible", "symbol_id % 37 = 0 AS thesis_eligible", "final_score AS breakout_score", "CASE WHEN symbol_id % 3 = 0 THEN 'A' WHEN symbol_id % 3 = 1 THEN 'B' END AS breakout_tier", "CASE WHEN symbol_id % 6 = 0 THEN 'transition_1_to_2' END AS provisional_stage", "final_score + 10 AS stage_confidence", "CASE WHEN symbol_id % 19 = 0 THEN 'early_accumulation' END AS lifecycle_hint", "CASE WHEN symbol_id % 4 = 0 THEN final_score END AS accumulation_score", "final_score AS evidence_score", "upper(verdict) AS verdict", "final_score + 5 AS pattern_score", "-(symbol_id % 12) AS rank_velocity", "CASE WHEN symbol_id % 5 <> 0 THEN 100 - final_score END AS rank_percentile")
RULES = [("investigator_primary_onset", "investigator_primary", "symbol_id % 41 = 0"), ("fundamental_thesis", "fundamental_thesis", "symbol_id % 37 = 0"), ("qualified_breakout", "breakout", "final_score >= 80 AND symbol_id % 3 <> 1"), ("stage_transition", "stage_1_to_2_transition", "symbol_id % 6 = 0 AND final_score >= 65"), ("early_accumulation", "early_accumulation", "symbol_id % 19 = 0 OR (symbol_id % 4 = 0 AND final_score >= 75)"), ("investigator_promotion", "base_building", "final_score >= 70"), ("qualified_pattern", "base_building", "final_score >= 75"), ("rank_velocity", "momentum_leader", "symbol_id % 12 >= 5 AND symbol_id % 5 <> 0 AND final_score <= 25"), ("rank_threshold", "momentum_leader", "symbol_id % 5 <> 0 AND final_score <= 10")]
R.add("wl31_admission", lambda s, d: ca.admission(bundle(s, d)).select(*KEY, "rules", "chosen_rule", "setup_family"), "cand", f"SELECT symbol_id, trade_date, concat_ws(',', {', '.join(f'''CASE WHEN {c} THEN '{n}' END''' for n, _, c in RULES)}) AS rules, CASE {' '.join(f'''WHEN {c} THEN '{n}' ''' for n, _, c in RULES)} END AS chosen_rule, CASE {' '.join(f'''WHEN {c} THEN '{f}' ''' for _, f, c in RULES)} END AS setup_family FROM cand")

GUARD = ["symbol_id", "week_end", "CASE WHEN bars_in_stage <= 2 THEN 'PROVISIONAL' ELSE 'LOCKED' END AS stage_status", "CASE WHEN stage = 'S2' THEN 'transition_1_to_2' ELSE stage END AS provisional_stage", "100 * confidence AS confidence", "CASE WHEN symbol_id % 5 = 0 THEN 'PROVISIONAL' ELSE 'LOCKED' END AS sector_status", "CASE WHEN symbol_id % 3 = 0 THEN 'stage_1_basing' ELSE 'stage_2_advancing' END AS sector_stage", "CASE WHEN symbol_id % 4 = 0 THEN 'weakening' ELSE ' Improving' END AS sector_strength", "CASE WHEN symbol_id % 7 = 0 THEN 'WATCH' ELSE 'READY' END AS lifecycle_state", "CASE WHEN symbol_id % 6 = 0 THEN NULL ELSE 75 + symbol_id % 20 END AS evidence_score", "CASE WHEN symbol_id % 8 = 0 THEN 'HIGH' ELSE 'LOW' END AS extension_risk", "CASE WHEN symbol_id % 9 = 0 THEN 'bear' ELSE 'Bull' END AS market_regime"]
NEED = [("stage_status = 'PROVISIONAL'", "stock_not_provisional"), ("provisional_stage = 'transition_1_to_2'", "stock_not_in_transition"), ("confidence >= 75", "stock_confidence"), ("sector_status = 'LOCKED'", "sector_not_locked"), ("sector_stage = 'stage_2_advancing'", "sector_not_stage_2"), ("lower(trim(sector_strength)) = 'improving'", "sector_not_improving"), ("lifecycle_state = 'READY'", "not_ready"), ("evidence_score >= 80", "evidence"), ("extension_risk = 'LOW'", "extension_risk"), ("lower(market_regime) IN ('cautious_bull', 'bull', 'strong_bull')", "market_regime")]
BLOCK = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for c, n in NEED)
R.add("wl35_entry_guard", lambda s, d: ca.entry_guard(stage_rows(s, d).selectExpr(*GUARD)).select("symbol_id", "week_end", "blockers", "passed", "eligibility", "max_size"), "age", f"WITH x AS (SELECT {', '.join(GUARD)} FROM age), y AS (SELECT *, concat_ws(',', {BLOCK}) AS blockers FROM x) SELECT symbol_id, week_end, blockers, blockers = '' AS passed, CASE WHEN blockers = '' THEN 'CONDITIONALLY_ELIGIBLE' ELSE 'BLOCKED' END AS eligibility, CASE WHEN blockers = '' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS max_size FROM y")

FAMILY = "CASE WHEN final_score >= 80 THEN 'breakout' WHEN final_score >= 60 THEN 'base_building' WHEN final_score >= 45 THEN 'momentum_leader' ELSE 'early_accumulation' END"
SQL["eps"] = f"SELECT symbol_id, trade_date, {FAMILY} AS family, row_number() OVER (PARTITION BY symbol_id ORDER BY trade_date DESC) AS k FROM cand WHERE setup_family IS NOT NULL"
NEEDS["eps"] = ["cand"]


def matched(s, d):
    rows = cand(s, d).filter("setup_family is not null").select(*KEY, F.expr(FAMILY).alias("family"), F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date"))).alias("k"))
    signals = rows.filter("k = 1").select(F.col("symbol_id").alias("signal_id"), "symbol_id", "family", F.col("trade_date").alias("as_of"))
    opened = rows.filter("k > 1 and k <= 2 + symbol_id % 3 and symbol_id % 3 > 0").select("symbol_id", F.col("k").alias("episode_id"), F.col("family").alias("episode_family"), F.col("trade_date").alias("last_at"))
    return ca.match_episodes(signals, opened)


STEP = lambda c: "CASE " + c + "".join(f" WHEN '{f}' THEN {i + 1}" for i, f in enumerate(ca.PROGRESSION)) + " ELSE 0 END"
R.add("wl36_match_episodes", matched, "eps", f"""WITH j AS (SELECT g.symbol_id, g.family, g.trade_date AS as_of, o.k, o.family = g.family AS ex, {STEP('g.family')} > 0 AND {STEP('o.family')} > 0 AND {STEP('o.family')} <= {STEP('g.family')} AND g.trade_date - o.trade_date BETWEEN 0 AND 30 AS nr, g.family = 'breakout' AND o.family = 'momentum_leader' AS ol
FROM eps g LEFT JOIN eps o ON o.symbol_id = g.symbol_id AND o.k > 1 AND o.k <= 2 + g.symbol_id % 3 AND g.symbol_id % 3 > 0 WHERE g.k = 1), x AS (SELECT symbol_id, family, as_of, count(*) FILTER (WHERE ex) AS e, count(*) FILTER (WHERE nr) AS n, count(*) FILTER (WHERE ol) AS l, count(k) AS a, min(k) FILTER (WHERE ex) AS ei, min(k) FILTER (WHERE nr) AS ni, min(k) FILTER (WHERE ol) AS li FROM j GROUP BY ALL),
y AS (SELECT *, CASE WHEN e = 1 THEN 'EXACT' WHEN e > 1 THEN 'CONFLICT' WHEN n = 1 THEN 'PROGRESSION' WHEN a = 1 AND l = 1 THEN 'SUPERSEDES' WHEN a > 0 THEN 'CONFLICT' ELSE 'NEW_EPISODE' END AS outcome FROM x)
SELECT symbol_id AS signal_id, symbol_id, family, as_of, outcome, CAST(CASE outcome WHEN 'EXACT' THEN ei WHEN 'PROGRESSION' THEN ni WHEN 'SUPERSEDES' THEN li END AS INTEGER) AS episode_id FROM y""")


def members(s, d):
    last = rk.latest(rk.returns(bars(s, d), 20))
    ranks = last.select("symbol_id", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("ret_20", 6)), "symbol_id")).alias("rank")).filter("symbol_id % 6 <> 0")
    return ca.constituents(master(s, d).select("symbol_id", F.col("parent").alias("sector")), rk.latest(stage_rows(s, d), order="week_end").select("symbol_id", "stage"), ranks, "ASIA", 25)


R.add("wl39_constituents", members, "age master", f"""WITH l AS (SELECT symbol_id, 100 * (close / nullif(lag(close, 20) {W}, 0) - 1) AS ret FROM bars {LATEST}), k AS (SELECT symbol_id, row_number() OVER (ORDER BY round(ret, 6) DESC NULLS LAST, symbol_id) AS rank FROM l), g AS (SELECT symbol_id, stage FROM age QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY week_end DESC) = 1)
SELECT symbol_id, parent AS sector, stage, CAST(CASE WHEN symbol_id % 6 <> 0 THEN rank END AS INTEGER) AS rank FROM master LEFT JOIN g USING (symbol_id) LEFT JOIN k USING (symbol_id) WHERE parent = 'ASIA' ORDER BY CASE WHEN symbol_id % 6 <> 0 THEN rank END NULLS LAST, symbol_id LIMIT 25""")
LIST = ["CASE WHEN symbol_id % 50 = 0 THEN NULL ELSE symbol_id % 90 END AS symbol_id", "symbol_id % 95 AS rank", "CASE WHEN symbol_id % 20 = 1 THEN 101.0 ELSE final_score END AS watchlist_score", "CASE WHEN symbol_id % 8 = 3 THEN 'Blocked' END AS trust_status", "CASE WHEN symbol_id % 4 = 0 THEN 'CORE_MOMENTUM' WHEN symbol_id % 4 = 1 THEN 'OTHER' END AS bucket", "CASE WHEN symbol_id % 9 <> 0 THEN 'watch' END AS operator_action", "CASE WHEN symbol_id % 3 = 0 THEN 'PASSED' WHEN symbol_id % 3 = 1 THEN 'HELD' END AS gate_status"]
CHECKS = {"null symbol_id": "symbol_id IS NULL", "duplicate symbol_id": "symbol_id IS NOT NULL AND ks > 1", "duplicate rank": "kr > 1", "watchlist_score outside 0 to 100": "watchlist_score NOT BETWEEN 0 AND 100", "blocked trust_status": "lower(trust_status) = 'blocked'", "unknown bucket": "bucket = 'OTHER'", "empty operator_action": "operator_action IS NULL", "unknown gate_status": "gate_status = 'HELD'"}
R.add("wl5_watchlist_warnings", lambda s, d: ca.watchlist_warnings(rk.latest(cand(s, d)).selectExpr(*LIST)), "cand", f"WITH l AS (SELECT * FROM cand {LATEST}), x AS (SELECT {', '.join(LIST)} FROM l), y AS (SELECT *, row_number() OVER (PARTITION BY symbol_id) AS ks, row_number() OVER (PARTITION BY rank) AS kr FROM x) SELECT * FROM ({' UNION ALL '.join(f'''SELECT '{n}' AS warning, count(*) AS n_rows FROM y WHERE {c}''' for n, c in CHECKS.items())}) WHERE n_rows > 0")
SQL["spe"] = "SELECT sector, trade_date, sum(market_cap) / nullif(sum(ttm_profit), 0) AS pe_ttm FROM stock GROUP BY ALL"
NEEDS["spe"] = ["stock"]
SU = "OVER (PARTITION BY sector ORDER BY trade_date ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW)"
# the quadrants of this query come from the sign of the P/E, so that its SQL stays short
quads = lambda s, d: sector_pe(s, d).groupBy("sector").agg(F.max_by("pe_ttm", "trade_date").alias("_v")).select("sector", F.when(F.col("_v") > 0, "Leading").when(F.col("_v") < -200, " Improving ").otherwise("Lagging").alias("quadrant"))
R.add("fu28_sector_context", lambda s, d: va.sector_context(quads(s, d), sector_pe(s, d)).select("sector", "premium_pct", "valuation"), "spe", f"""WITH a AS (SELECT *, CASE WHEN count(pe_ttm) {SU} >= 60 THEN avg(pe_ttm) {SU} END AS m FROM spe), l AS (SELECT sector, pe_ttm, round(100 * (pe_ttm / nullif(m, 0) - 1), 9) AS p FROM a QUALIFY row_number() OVER (PARTITION BY sector ORDER BY trade_date DESC) = 1)
SELECT sector, {r('p', 'premium_pct')}, CASE WHEN p IS NULL THEN '5Y avg unavailable' WHEN p <= -10 THEN 'Below 5Y avg' WHEN p < 10 THEN 'Near 5Y avg' WHEN p < 25 THEN 'Above 5Y avg' ELSE 'High premium' END AS valuation FROM l WHERE pe_ttm > 0 OR pe_ttm < -200""")
