"""Valuation of companies and universes, choice of statements, and scores of industries and results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import along, clip, full, pct_rank, ratio, reasons, trailing
from barloom.operators.asof import as_of_join


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


# --- statements ---------------------------------------------------------------------------------------------


def share_book(rows: DataFrame) -> DataFrame:
    """Shares (in ten millions) and book value of each statement.

    Rows have adjusted_shares, share_count, share_capital and reserves. Adjusted
    shares below a tenth of what the capital implies give way to the count, as
    do missing ones; where nothing positive is left the capital decides.
    """
    counted, implied, given = F.col("share_count") / 1e7, F.col("share_capital") / 10, F.col("adjusted_shares")
    first = F.when((implied > 0) & (given < 0.1 * implied) & (counted > 0), counted).when(given > 0, given).otherwise(counted)
    return rows.withColumns({"shares": F.when((implied > 0) & ~_is(first > 0), implied).otherwise(first), "book_value": F.col("share_capital") + F.col("reserves")})


def ttm_grid(days: DataFrame, quarterly: DataFrame, annual: DataFrame) -> DataFrame:
    """Trailing-year profit that was known on each day: of four quarters, else of the last full year, and which of them.

    Days have symbol_id and trade_date; quarterly has ttm_profit, annual has
    annual_profit, both available_at.
    """
    grid = as_of_join(days, quarterly, "symbol_id", "trade_date", "available_at", ["ttm_profit"]).drop("matched_at").withColumnRenamed("ttm_profit", "_q")
    grid = as_of_join(grid, annual, "symbol_id", "trade_date", "available_at", ["annual_profit"]).drop("matched_at")
    source = F.when(F.col("_q").isNotNull(), "quarterly_ttm").when(F.col("annual_profit").isNotNull(), "annual_fallback").otherwise("missing")
    return grid.withColumns({"ttm_profit": F.coalesce("_q", "annual_profit"), "earnings_source": source}).drop("_q", "annual_profit")


def statement_basis(rows: DataFrame) -> DataFrame:
    """Consolidated or standalone statements for each symbol, by how recent and how complete they are.

    Rows have symbol_id, basis, period_type and report_date; a blank basis is a
    standalone one.
    """
    name = F.lower(F.trim("basis"))
    known = rows.select("symbol_id", F.when(name != "", name).otherwise("standalone").alias("_b"), F.lower(F.trim("period_type")).alias("_p"), "report_date").distinct()
    of = lambda basis, period: (F.col("_b") == basis) & (F.col("_p") == period)
    last = lambda basis: F.max(F.when(of(basis, "quarterly"), F.col("report_date")))
    n = lambda basis, period: F.count(F.when(of(basis, period), F.col("report_date")))
    per = known.groupBy("symbol_id").agg(
        last("consolidated").alias("consolidated_latest"),
        last("standalone").alias("standalone_latest"),
        (n("consolidated", "quarterly") >= F.least(n("standalone", "quarterly"), F.lit(5))).alias("_quarters"),
        (n("consolidated", "annual") >= F.least(n("standalone", "annual"), F.lit(2))).alias("_years"),
        F.bool_or(F.col("_b") == "standalone").alias("_alone"),
        F.bool_or(F.col("_b") == "consolidated").alias("_whole"),
    )
    whole, alone, enough = F.col("consolidated_latest"), F.col("standalone_latest"), F.col("_quarters") & F.col("_years")
    reason = (
        F.when(whole.isNotNull() & (alone.isNull() | (whole >= alone)) & enough, F.when(alone.isNull(), "consolidated_only_quarterly").otherwise("consolidated_current"))
        .when(F.col("_alone") & whole.isNull(), "standalone_fallback_no_consolidated_quarterly")
        .when(F.col("_alone") & ~enough, "standalone_fallback_insufficient_consolidated_history")
        .when(F.col("_alone"), "standalone_fallback_newer_quarter")
        .when(F.col("_whole"), "consolidated_only_no_quarterly")
        .otherwise("standalone_fallback")
    )
    return per.withColumn("reason", reason).withColumn("basis", F.split_part("reason", F.lit("_"), F.lit(1))).select("symbol_id", "consolidated_latest", "standalone_latest", "basis", "reason")


def statement_scope(rows: DataFrame, least: float = 0.70) -> DataFrame:
    """The usable scope of each symbol: consolidated if complete enough, else standalone, never a mix. Rows have scope and completeness."""
    best = lambda scope, ok: F.max(F.when((F.col("scope") == scope) & ok, F.col("completeness")))
    per = rows.groupBy("symbol_id").agg(best("consolidated", F.col("completeness") >= least).alias("_c"), best("standalone", F.col("completeness") > 0).alias("_s"))
    pick = lambda c, s, none: F.when(F.col("_c").isNotNull(), c).when(F.col("_s").isNotNull(), s).otherwise(none)
    return per.select("symbol_id", pick("consolidated", "standalone", "SCOPE_UNRESOLVED").alias("scope"), F.coalesce("_c", "_s", F.lit(0.0)).alias("completeness"), pick("consolidated_usable", "standalone_fallback_no_splicing", "no_usable_scope").alias("reason"))


def disposition(rows: DataFrame, low: float, high: float, complete: float = 0.70) -> DataFrame:
    """Whether a company may be looked at. Rows have identity_status, board_status, market_cap and completeness."""
    board, cap = F.col("board_status"), F.col("market_cap")
    sized = _is(cap > 0) & ~F.isnan(cap) & (cap != float("inf"))
    ladder = (
        F.when(~_is(F.col("identity_status") == "RESOLVED"), "DATA_REPAIR_REQUIRED")
        .when(board == "BOARD_UNKNOWN", "ELIGIBILITY_UNKNOWN")
        .when(~_is(board.isin("MAIN", "ELIGIBLE")), "INELIGIBLE_BOARD_OR_INSTRUMENT")
        .when(~_is(sized), "ELIGIBILITY_UNKNOWN")
        .when(~cap.between(low, high), "INELIGIBLE_MARKET_CAP")
        .when(~_is(F.col("completeness") >= complete), "DATA_REPAIR_REQUIRED")
        .otherwise("BOUNDARY_REVIEW")
    )
    return rows.withColumn("disposition", ladder)


# --- indices and their valuation ----------------------------------------------------------------------------


def universe_index(stock: DataFrame, gap: int = 7, base: float = 1000.0) -> DataFrame:
    """Equal- and cap-weighted level, return, P/E and earnings yield of each universe and date.

    Stock rows, one per symbol and date, have universe, close, market_cap and
    ttm_profit. A return counts when the bar before is at most ``gap`` days old.
    The level runs over one row per universe, kind and date.
    """
    w = along("universe", "symbol_id")
    fresh = F.datediff("trade_date", F.lag("trade_date").over(w)).between(1, gap)
    moved = stock.withColumn("_r", F.when(fresh, ratio(F.col("close"), F.lag("close").over(w)) - 1))
    cap = F.sum("market_cap")
    day = moved.groupBy("universe", "trade_date").agg(F.count("symbol_id").alias("constituents"), cap.alias("total_cap"), F.coalesce(F.sum("ttm_profit"), F.lit(0.0)).alias("total_profit"), F.avg("_r").alias("_e"), ratio(F.sum(F.col("market_cap") * F.col("_r")), cap).alias("_c"))
    kinds = F.array(F.struct(F.lit("equal_weight").alias("k"), F.col("_e").alias("v")), F.struct(F.lit("market_cap_weight").alias("k"), F.col("_c").alias("v")))
    two = day.withColumn("_x", F.explode(kinds)).withColumns({"index_type": F.col("_x.k"), "return_1d": F.col("_x.v"), "pe_ttm": ratio(F.col("total_cap"), F.col("total_profit")), "earnings_yield": ratio(F.col("total_profit"), F.col("total_cap"))}).drop("_x", "_e", "_c")
    so_far = along("universe", "index_type").rowsBetween(Window.unboundedPreceding, 0)
    return two.withColumn("level", base * F.product(1 + F.coalesce("return_1d", F.lit(0.0))).over(so_far))


def _past(values: np.ndarray, n: int, chunk: int = 256):
    """Blocks of trailing windows of n values, the row itself last; what lies before the first row is unknown."""
    padded = np.concatenate([np.full(n - 1, np.nan), values])
    windows = np.lib.stride_tricks.sliding_window_view(padded, n)
    for at in range(0, len(values), chunk):
        yield at, windows[at : at + chunk]


def _measures(values: np.ndarray, n: int, least: int) -> dict[str, np.ndarray]:
    """Mean, median, z-score (sample deviation) and percentile of the last known value of n rows, where enough are known."""
    out = {k: np.full(len(values), np.nan) for k in ("avg", "zscore", "percentile")}
    last = pd.Series(np.where(np.isnan(values), np.nan, np.arange(len(values)))).ffill().to_numpy()
    for at, w in _past(values, n):
        known = ~np.isnan(w)
        count = known.sum(axis=1)
        rows = np.flatnonzero(count >= max(least, 1))
        if not len(rows):
            continue
        w, known, count, here = w[rows], known[rows], count[rows], at + rows
        mean = np.where(known, w, 0).sum(axis=1) / count
        spread = np.sqrt((np.where(known, w - mean[:, None], 0) ** 2).sum(axis=1) / np.where(count > 1, count - 1, np.nan))
        now = values[last[here].astype(int)][:, None]
        out["avg"][here] = mean
        out["zscore"][here] = (values[here] - mean) / np.where(spread == 0, np.nan, spread)
        out["percentile"][here] = np.round(100 * ((w < now).sum(axis=1) + ((w == now).sum(axis=1) + 1) / 2) / count, 9)
    out["median"] = pd.Series(values).rolling(n, min_periods=max(least, 1)).median().to_numpy()
    return out


def against_past(rows: DataFrame, key: str, value: str, windows: dict[str, tuple[int, int]], wanted: dict[str, tuple[str, str]], fallback: int | None = None) -> DataFrame:
    """A daily value of each entity against its own trailing windows, one entity at a time.

    ``windows`` names widths and least numbers of known values, ``wanted`` maps
    new columns to (window, measure). With a ``fallback``, an entity that has
    fewer values in all than a window needs, but that many, needs only that many.
    Rows are one per entity and date, so a group is as long as the calendar;
    sliding frames of thousands of rows would be summed anew for every row.
    """

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("trade_date", ignore_index=True)
        values = group[value].to_numpy(float, na_value=np.nan)
        all_known = int((~np.isnan(values)).sum())
        made = {}
        for label, (n, least) in windows.items():
            need = min(least, n)
            made[label] = _measures(values, n, fallback if fallback is not None and fallback <= all_known < need else need)
        return group.assign(**{c: made[label][measure] for c, (label, measure) in wanted.items()})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{c}` double" for c in wanted])
    return rows.groupBy(key).applyInPandas(fill, schema)


def zone(place: Column) -> Column:
    return F.when(place < 10, "deep_value_panic").when(place < 25, "cheap").when(place < 60, "fair").when(place < 80, "expensive").when(place < 90, "late_bull").when(place.isNotNull(), "bubble_top_risk").otherwise("unknown")


def universe_valuation(stock: DataFrame) -> DataFrame:
    """P/E of the profitable members of each universe, share of the cap that makes losses, and both against their past."""
    gain, cap, p = F.col("ttm_profit") > 0, F.col("market_cap"), F.col("ttm_profit")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    day = stock.groupBy("universe", "trade_date").agg(F.sum(cap).alias("total_cap"), none(F.sum(F.when(gain, cap))).alias("profit_cap"), none(F.sum(F.when(gain, p))).alias("_p"), none(F.sum(F.when(~_is(gain), cap))).alias("loss_cap"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    day = day.withColumns({"pe_ttm": part("profit_cap", "_p"), "earnings_yield": part("_p", "profit_cap"), "loss_share": part("loss_cap", "total_cap")})
    wanted = {"pe_200dma": ("200d", "avg"), "pe_1y_median": ("1y", "median")} | {f"pe_{m}_{y}": (y, m) for y in ("3y", "5y") for m in ("zscore", "percentile")} | {f"pe_{y}_median": (y, "median") for y in ("3y", "5y")}
    day = against_past(day, "universe", "pe_ttm", {"200d": (200, 20), "1y": (252, 20), "3y": (756, 60), "5y": (1260, 60)}, wanted)
    return day.withColumn("valuation_zone", zone(F.coalesce("pe_percentile_5y", "pe_percentile_3y"))).drop("_p")


def valuation_cycle(rows: DataFrame) -> DataFrame:
    """Distance of the P/E from its 200-day mean in per cent and the signal of the cycle; what is unknown counts 0."""
    distance = 100 * (ratio(F.col("pe_ttm"), F.col("pe_200dma")) - 1)
    rows = rows.withColumn("pe_distance", distance)
    d, p = F.coalesce("pe_distance", F.lit(0.0)), F.coalesce("pe_percentile_5y", F.lit(0.0))
    signal = F.when((d > 0) & (p > 80), "expensive_bull_phase").when((d < 0) & (p < 25), "valuation_reset_bear_phase").when((d > 0) & (p < 40), "early_bull_recovery").when((d < 0) & F.col("valuation_zone").isin("late_bull", "bubble_top_risk"), "top_risk_warning").otherwise("neutral")
    return rows.withColumn("cycle_signal", signal)


def cycle_features(rows: DataFrame, least: int = 756) -> DataFrame:
    """P/E of each entity against its last three, five and ten years. Rows have entity, trade_date and pe_ttm.

    An entity with fewer than ``least`` values in all needs 252 of them.
    """
    wanted = {f"pe_{name}_{y}": (y, m) for y in ("3y", "5y", "10y") for name, m in (("pctile", "percentile"), ("zscore", "zscore"))} | {"pe_median_5y": ("5y", "median"), "pe_avg_5y": ("5y", "avg")}
    rows = against_past(rows, "entity", "pe_ttm", {"3y": (756, least), "5y": (1260, least), "10y": (2520, least)}, wanted, fallback=252)
    p, z = (F.coalesce(*[f"pe_{k}_{y}" for y in ("10y", "5y", "3y")]) for k in ("pctile", "zscore"))
    name = F.when(p.isNull(), "unknown").when(p < 10, "depressed").when(p < 20, "cheap").when(p > 90, "bubble").when(p > 80, "expensive").otherwise("fair")
    signal = F.when(F.col("valuation_zone").isin("depressed", "cheap") & (z < -1), "bottom_zone").when((F.col("valuation_zone") == "bubble") & (z > 1.5), "top_zone").otherwise("neutral")
    return rows.withColumn("valuation_zone", name).withColumn("cycle_signal", signal)


def sector_context(sectors: DataFrame, valuation: DataFrame) -> DataFrame:
    """Leading and improving sectors with their latest P/E against its five-year mean. Valuation has sector, trade_date and pe_ttm."""
    spec = trailing(1260, "sector")
    seen = valuation.withColumn("_a", full(F.avg("pe_ttm").over(spec), spec, 60, F.col("pe_ttm")))
    last = seen.groupBy("sector").agg(F.max_by(F.struct("pe_ttm", "_a"), "trade_date").alias("_v")).select("sector", F.col("_v.pe_ttm").alias("pe_ttm"), F.col("_v._a").alias("pe_avg_5y"))
    premium = F.round(100 * (ratio(F.col("pe_ttm"), F.col("pe_avg_5y")) - 1), 9)
    label = F.when(premium.isNull(), "5Y avg unavailable").when(premium <= -10, "Below 5Y avg").when(premium < 10, "Near 5Y avg").when(premium < 25, "Above 5Y avg").otherwise("High premium")
    return sectors.filter(F.trim("quadrant").isin("Leading", "Improving")).join(last, "sector", "left").withColumns({"premium_pct": premium, "valuation": label})


# --- scores -------------------------------------------------------------------------------------------------

#: Fixed bounds at which the values of an industry are clipped.
BOUNDS = {"sales_growth": (-50, 150), "opm": (-50, 80), "roce": (-30, 80), "return_1y": (-80, 200), "median_pe": (0, 150)}


def industry_scores(rows: DataFrame, *keys: str) -> DataFrame:
    """Growth, quality, valuation and momentum of the industries of a snapshot (keys), their blend, warnings and label.

    Rows have companies and the columns of ``BOUNDS``. What is missing scores 50.
    """
    clipped = rows.withColumns({f"_{c}": clip(F.col(c), *b) for c, b in BOUNDS.items()}).withColumn("_median_pe", F.when(F.col("median_pe") > 0, F.col("_median_pe")))
    place = {c: 100 * pct_rank(f"_{c}", *keys) for c in BOUNDS}
    scored = clipped.withColumns({f"_p_{c}": F.coalesce(v, F.lit(50.0)) for c, v in (place | {"median_pe": 100 - place["median_pe"]}).items()})
    p = lambda c: F.col(f"_p_{c}")
    parts = {"growth_score": p("sales_growth"), "quality_score": 0.5 * p("roce") + 0.5 * p("opm"), "valuation_score": p("median_pe"), "momentum_score": p("return_1y")}
    parts["fundamental_score"] = 0.30 * parts["growth_score"] + 0.30 * parts["quality_score"] + 0.20 * parts["valuation_score"] + 0.20 * parts["momentum_score"]
    out = scored.withColumns({c: F.round(F.round(v, 9), 2) for c, v in parts.items()})
    n, sales, opm = F.col("companies"), F.col("sales_growth"), F.col("opm")
    missing = sum((F.col(c).isNull().cast("int") for c in BOUNDS), F.lit(0))
    odd = (opm < -50) | (opm > 80)
    warnings = reasons((n < 5, "low_company_count"), (F.col("median_pe") > 60, "expensive_sector"), (opm < 0, "negative_opm"), (F.col("roce") < 8, "weak_roce"), ((sales > 150) | (sales < -50), "extreme_sales_growth"), (odd, "distorted_operating_margin"), (missing >= 3, "missing_key_metrics"))
    f, g, q, v, m = (F.col(f"{c}_score") for c in ("fundamental", "growth", "quality", "valuation", "momentum"))
    label = (
        F.when(_is((n < 3) | (sales > 200) | (sales < -75) | (opm < -50) | (missing >= 3)), "DISTORTED_DATA")
        .when((f >= 70) & (g >= 65) & (q >= 65) & ~_is(odd), "QUALITY_GROWTH_LEADER")
        .when((m >= 70) & (v <= 35), "EXPENSIVE_MOMENTUM")
        .when((v >= 65) & (q >= 55) & (m <= 50), "VALUE_ROTATION_CANDIDATE")
        .when((g >= 60) & (m <= 55) & (v >= 50), "CYCLICAL_RECOVERY")
        .when((f < 40) | (q < 35), "WEAK_FUNDAMENTALS")
        .otherwise("BALANCED")
    )
    return out.withColumns({"warnings": F.concat_ws(";", warnings), "label": label}).drop(*[f"_{c}" for c in BOUNDS], *[f"_p_{c}" for c in BOUNDS])


def industry_trends(now: DataFrame, before: DataFrame, *keys: str) -> DataFrame:
    """Change of each industry's scores since another snapshot and the class of the change."""
    columns = ["fundamental_score", "growth_score", "quality_score", "valuation_score", "momentum_score", "roce", "opm"]
    rows = now.join(before.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]), list(keys), "left")
    rows = rows.withColumns({f"{c}_delta": F.round(F.col(c) - F.col(f"_{c}"), 6) for c in columns})
    d = {c: F.coalesce(f"{c}_delta", F.lit(0.0)) for c in columns}
    eroded = (d["quality_score"] < -3) | (d["roce"] < -2) | (d["opm"] < -3)
    label = (
        F.when(F.col("_fundamental_score").isNull(), "INSUFFICIENT_HISTORY")
        .when((d["fundamental_score"] > 5) & ~eroded, "IMPROVING")
        .when((d["fundamental_score"] < -5) | eroded, "DETERIORATING")
        .when((d["momentum_score"] > 10) & (d["growth_score"] >= 0), "MOMENTUM_BUILDING")
        .when(d["momentum_score"] < -10, "MOMENTUM_FADING")
        .when((d["valuation_score"] > 8) & (d["quality_score"] < 0), "VALUE_TRAP_RISK")
        .otherwise("STABLE")
    )
    return rows.withColumn("trend", label).drop(*[f"_{c}" for c in columns])


#: Fixed weight and range of each growth figure (per cent, margins in basis points).
RESULT_WEIGHTS = {
    "sales_yoy": (0.15, 0, 25),
    "sales_qoq": (0.08, -5, 10),
    "op_yoy": (0.20, 0, 40),
    "op_qoq": (0.10, -5, 20),
    "profit_yoy": (0.12, 0, 40),
    "profit_qoq": (0.05, -5, 20),
    "opm_yoy_bps": (0.20, -200, 400),
}


def result_scores(rows: DataFrame) -> DataFrame:
    """Score and bucket of each company's last quarter, with points off for a low base, profit without sales and a falling margin.

    Rows have the columns of ``RESULT_WEIGHTS``, opm_qoq_bps, and the quarters of
    four with growing sales, growing profit and wider margins (sales_up,
    profit_up, margin_up). Missing growth scores 50; in the buckets it counts 0.
    """
    profit = F.col("profit_yoy")
    low_base = profit.isNull() | (profit > 150) | _is((profit > 80) & (F.col("profit_qoq") > 40))
    off = 10.0 * low_base.cast("int") + 10.0 * _is((F.col("sales_yoy") < 5) & (profit > 50)).cast("int") + 15.0 * _is(F.col("opm_yoy_bps") < -200).cast("int")
    steady = sum((clip(F.coalesce(c, F.lit(0)), 0, 4) for c in ("sales_up", "profit_up", "margin_up")), F.lit(0.0)) / 12 * 100
    parts = sum((w * F.coalesce(clip((F.col(c) - a) / (b - a) * 100, 0, 100), F.lit(50.0)) for c, (w, a, b) in RESULT_WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumns({"low_base": low_base, "penalty": off, "result_score": F.round(F.round(clip(parts + 0.10 * steady - off, 0, 100), 9), 2)})
    score, at = F.col("result_score"), lambda c: F.coalesce(c, F.lit(0.0))
    bucket = (
        F.when((score < 45) | (at("opm_yoy_bps") <= -200) | (at("profit_yoy") < 0), "DETERIORATING")
        .when((score >= 85) & (at("sales_yoy") >= 25) & (at("op_yoy") >= 40) & (at("opm_yoy_bps") >= 300), "BLOWOUT_RESULT")
        .when((score >= 75) & (at("sales_yoy") >= 15) & (at("op_yoy") >= 25) & (at("opm_yoy_bps") >= 100), "GREAT_RESULT")
        .when((score >= 70) & (at("sales_qoq") >= 5) & (at("op_qoq") >= 10) & (at("opm_qoq_bps") >= 75), "RESULT_ACCELERATION")
        .when((at("opm_yoy_bps") >= 200) & (at("op_yoy") >= 20), "MARGIN_EXPANSION")
        .when((at("profit_yoy") >= 50) & (at("sales_yoy") >= 10) & (at("opm_yoy_bps") >= 300), "TURNAROUND")
        .otherwise("IGNORE")
    )
    return rows.withColumn("result_bucket", bucket)
