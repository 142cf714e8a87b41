"""Reports on what scores and factors were worth: overlap, drift, concentration, capture, cohorts, folds and model frames.

Outcomes and factors are per cent. Windows over all rows are never used: ranks
over a whole window of dates are taken piece by piece (``spread_rank``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.shared import kept
from barloom.functions.stats import along, clip, full, rank_pairs, ratio, reasons, spread_rank, trailing

# Thresholds of the reports.
ACTIVATION_ROWS, ACTIVATION_IC = 30, 0.02
DRIFT_PERCENT, DRIFT_ROWS, DRIFT_CRITICAL_ROWS, DRIFT_DELTA, DRIFT_BASE = 30.0, 1500, 3000, 0.03, 0.05
WEAK_DELTA, STRONG_DELTA = 0.5, 1.5
BANDS = (("top-10", 1, 10), ("top-50", 1, 50), ("top-200", 1, 200), ("51-200", 51, 200), ("201+", 201, 10_000_000))
EXTREME, REVIEW = {5: 50.0, 10: 75.0, 20: 80.0, 60: 80.0}, 80.0
WEIGHTS = {"rel_strength": 0.25, "vol_intensity": 0.18, "trend_score": 0.15, "prox_high": 0.17, "delivery_pct": 0.10, "sector_strength": 0.15}
CONFIDENCE = {"ma_slope": 0.25, "price_position": 0.20, "relative_strength": 0.20, "base_breakout": 0.15, "volume": 0.10, "persistence": 0.10}
REGIME_BANDS = {"risk_off": (0.0, 0.30), "neutral": (0.30, 0.55), "cautious_bull": (0.55, 0.75), "bull": (0.55, 0.75), "strong_bull": (0.75, 1.0)}


def recent(rows: DataFrame, days: int, time: str = "trade_date") -> DataFrame:
    """Rows of the last days before the latest date there is."""
    last = rows.agg(F.max(time).alias("_last"))
    return rows.join(F.broadcast(last)).filter(F.col(time) >= F.date_sub("_last", days)).drop("_last")


def pooled_ic(rows: DataFrame, a: str, b: str, *keys: str, least: int = 3) -> DataFrame:
    """Rank correlation over all rows of a few large groups; null below ``least`` pairs."""
    ranked = rank_pairs(rows, a, b, *keys)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.nanvl(F.corr("_a", "_b"), F.lit(None))).alias("ic"))


def factor_overlap(rows: DataFrame, a: str, b: str, days: int = 180) -> DataFrame:
    """Rank correlation of two factors over a window of days, and how far they say the same."""
    out = pooled_ic(recent(rows, days), a, b, least=30)
    size = F.abs("ic")
    status = F.when(size.isNull(), "insufficient_sample").when(size >= 0.8, "high_overlap").when(size >= 0.6, "moderate_overlap").otherwise("low_overlap")
    return out.withColumn("status", status)


def by_factor(rows: DataFrame, factors: list[str], *keep: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors])
    return rows.select(*keep, F.explode(items).alias("_x")).select(*keep, "_x.factor", "_x.value")


def drift(rows: DataFrame, factors: list[str], outcome: str, now: int = 30, before: int = 180) -> DataFrame:
    """Information coefficient of each factor over recent days against a longer base, with an alert status."""
    long = kept(by_factor(rows, factors, "trade_date", outcome))
    a = pooled_ic(recent(long, now), "value", outcome, "factor").select("factor", F.col("n").alias("recent_n"), F.col("ic").alias("ic_recent"))
    b = pooled_ic(recent(long, before), "value", outcome, "factor").select("factor", F.col("n").alias("baseline_n"), F.col("ic").alias("ic_baseline"))
    both = a.join(b, "factor", "full_outer").na.fill(0, ["recent_n", "baseline_n"])
    usable = F.col("ic_recent").isNotNull() & F.col("ic_baseline").isNotNull() & (F.abs("ic_baseline") >= 1e-6)
    both = both.withColumn("delta_ic", F.when(usable, F.col("ic_recent") - F.col("ic_baseline"))).withColumn("delta_pct", F.when(usable, F.col("delta_ic") / F.abs("ic_baseline") * 100))
    fell = F.col("delta_pct") < -DRIFT_PERCENT
    status = (
        F.when(F.col("recent_n") < DRIFT_ROWS, "insufficient_sample")
        .when(~usable, "no_baseline")
        .when(F.col("recent_n") < DRIFT_CRITICAL_ROWS, F.when(fell, "watch").otherwise("ok"))
        .when((F.col("delta_ic") <= -DRIFT_DELTA) & (F.col("ic_baseline") >= DRIFT_BASE), "critical")
        .when(fell, "warning")
        .otherwise("ok")
    )
    return both.withColumn("status", status).withColumn("alert", F.when(F.col("status").isin("warning", "critical"), F.upper("status")).otherwise(""))


def activation(rows: DataFrame, factors: list[str], horizons: tuple[int, ...] = (5, 10, 20), days: int = 180) -> DataFrame:
    """Whether a factor's coefficients over several horizons allow a backtest with a weight."""
    part = recent(rows, days)
    items = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(h).alias("horizon"), F.col(f).alias("value"), F.col(f"fwd_{h}").alias("fwd")) for f in factors for h in horizons])
    ic = pooled_ic(part.select(F.explode(items).alias("_x")).select("_x.*"), "value", "fwd", "factor", "horizon")
    at = lambda c, h: F.max(F.when(F.col("horizon") == h, F.col(c)))
    wide = ic.groupBy("factor").agg(*[F.coalesce(at("n", h), F.lit(0)).alias(f"n_{h}") for h in horizons], *[at("ic", h).alias(f"ic_{h}") for h in horizons])
    good = sum((F.coalesce((F.col(f"ic_{h}") > 0).cast("int"), F.lit(0)) for h in horizons), F.lit(0))
    enough = F.least(*[F.col(f"n_{h}") for h in horizons]) >= ACTIVATION_ROWS
    eligible = enough & (good >= 2) & F.coalesce(F.col(f"ic_{horizons[-1]}") >= ACTIVATION_IC, F.lit(False))
    return wide.withColumns({"positive_horizons": good, "decision": F.when(eligible, "eligible_for_backtest").otherwise("hold_zero_weight")})


def concentration(ranked: DataFrame, days: int = 90) -> DataFrame:
    """Mean outcomes of overlapping rank bands, against the first 200 and the rest, and what the top ten add."""
    bands = F.array_compact(F.array(*[F.when(F.col("k").between(low, high), F.lit(name)) for name, low, high in BANDS]))
    part = recent(ranked, days).select("fwd_5", "fwd_10", "fwd_20", F.explode(bands).alias("cohort"))
    hit = 100 * F.avg(F.when(F.col("fwd_20").isNotNull(), (F.col("fwd_20") > 0).cast("double")))
    out = part.groupBy("cohort").agg(F.count("*").alias("n"), *[F.avg(f"fwd_{h}").alias(f"avg_{h}") for h in (5, 10, 20)], hit.alias("hit_rate_20"))
    every = Window.partitionBy()  # five rows at most
    of = lambda name: F.max(F.when(F.col("cohort") == name, F.col("avg_20"))).over(every)
    edge = of("top-10") - of("top-200")
    signal = F.when(edge.isNull(), "unknown").when(edge < WEAK_DELTA, "weak").when(edge >= STRONG_DELTA, "strong").otherwise("mixed")
    return out.withColumns({"delta_top_200": F.col("avg_20") - of("top-200"), "delta_201_plus": F.col("avg_20") - of("201+"), "signal": signal})


def winner_capture(ranked: DataFrame, bars: DataFrame, top: int = 50, cutoff: int = 50) -> DataFrame:
    """The best symbols of each year: when the ranking first had them, their best rank, and the return before and after.

    ``ranked`` holds symbol, date and rank ``k``.
    """
    year = bars.withColumn("year", F.year("trade_date")).groupBy("year", "symbol_id").agg(F.min_by("close", "trade_date").alias("_a"), F.max_by("close", "trade_date").alias("_z"), F.count("*").alias("_n"))
    gain = year.filter("_n >= 2 and _a > 0").withColumn("year_return", 100 * (F.col("_z") / F.col("_a") - 1))
    best = gain.withColumn("_k", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("year_return"), "symbol_id"))).filter(F.col("_k") <= top)
    held = ranked.select("symbol_id", "trade_date", "close", "k", F.year("trade_date").alias("year")).join(best, ["year", "symbol_id"])
    within = F.col("k") <= cutoff
    seen = held.groupBy("year", "symbol_id").agg(F.min(F.when(within, F.col("trade_date"))).alias("captured_on"), F.min_by("close", F.when(within, F.col("trade_date"))).alias("_c"), F.min("k").alias("best_rank"))
    out = best.join(seen, ["year", "symbol_id"], "left")
    return out.select("year", "symbol_id", "year_return", "captured_on", "best_rank", (100 * (F.col("_c") / F.col("_a") - 1)).alias("return_at_capture"), (100 * (ratio(F.col("_z"), F.col("_c")) - 1)).alias("return_remaining"))


def factor_of_winners(rows: DataFrame, factors: list[str], rally: str = "rally") -> DataFrame:
    """Per factor of one row a symbol: median, median percentile, share in the top quarter, rank correlation with the rally."""
    long = by_factor(rows, factors, rally)
    ranked = spread_rank(long, "value", "_p", "factor")
    base = ranked.groupBy("factor").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.percentile(100 * F.col("_p"), F.lit(0.5)).alias("median_pct"), (100 * F.avg(F.coalesce(100 * F.col("_p") >= 75, F.lit(False)).cast("double"))).alias("top_quarter"))
    return base.join(pooled_ic(long, "value", rally, "factor").select("factor", "ic"), "factor", "left")


def precision_at(rows: DataFrame, score: str, outcome: str, n: int, least: float = 20.0) -> DataFrame:
    """Share of the n best scores whose outcome reaches a limit; unknown outcomes do not."""
    top = rows.filter(F.col(score).isNotNull()).orderBy(F.desc(score), "symbol_id", "trade_date").limit(n)
    return top.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(outcome) >= least, F.lit(False)).cast("double")).alias("precision"))


def cohort_performance(rows: DataFrame, groups: dict[str, list[str]], horizons: list[int]) -> DataFrame:
    """Return metrics of each value of each group (columns, or crossed columns) and horizon, against the mean of all rows.

    Null members are called UNKNOWN. Each row meets as many groups as there are
    names, a fixed number, and is summed before the shuffle.
    """
    member = lambda cols: F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")) for c in cols])
    kinds = F.array(*[F.struct(F.lit(name).alias("group_type"), member(cols).alias("group_value")) for name, cols in groups.items()])
    spans = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("v")) for h in horizons])
    long = rows.withColumn("_h", F.explode(spans)).filter("_h.v is not null").withColumn("_g", F.explode(kinds)).select("_g.*", "_h.*")
    base = rows.select(F.explode(spans).alias("_h")).select("_h.*").groupBy("horizon").agg(F.avg("v").alias("_base"))
    v = F.col("v")
    share = lambda c: 100 * F.avg(c.cast("double"))
    out = long.groupBy("group_type", "group_value", "horizon").agg(
        F.count("*").alias("n"), share(v > 0).alias("win_rate"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), share(v > 2).alias("above_2"), share(v > 5).alias("above_5"),
        F.avg(F.when(v > 0, v)).alias("winner"), F.avg(F.when(v < 0, v)).alias("loser"),
    ).join(F.broadcast(base), "horizon")  # one row a horizon
    win = F.col("win_rate") / 100
    first = F.row_number().over(Window.partitionBy("group_type", "group_value").orderBy(F.desc("mean"), F.desc("n"))) == 1
    return out.withColumns({
        "sample": F.when(F.col("n") >= 50, "HIGH").when(F.col("n") >= 20, "MEDIUM").otherwise("LOW"),
        "payoff": F.col("winner") / F.abs(F.nullif("loser", F.lit(0.0))),
        "expectancy": win * F.col("winner") + (1 - win) * F.col("loser"),
        "edge": F.col("mean") - F.col("_base"),
        "best_horizon": first,
    }).drop("_base")


def mature(cohorts: DataFrame, bars: DataFrame, horizons: list[int]) -> DataFrame:
    """Fill the returns of cohort rows that are still unknown and whose horizon has passed; known ones stay."""
    ahead = bars.select("symbol_id", "trade_date", *[(100 * (ratio(F.lead("close", h).over(along()), F.col("close")) - 1)).alias(f"_f{h}") for h in horizons])
    out = cohorts.join(ahead, ["symbol_id", "trade_date"], "left").withColumns({f"fwd_{h}": F.coalesce(f"fwd_{h}", f"_f{h}") for h in horizons})
    known = sum((F.col(f"fwd_{h}").isNotNull().cast("int") for h in horizons), F.lit(0))
    return out.withColumn("status", F.when(known == len(horizons), "matured").when(known > 0, "partial").otherwise("pending")).drop(*[f"_f{h}" for h in horizons])


def calendar_windows(rows: DataFrame, group: str, value: str, relative: str, size: int = 10) -> DataFrame:
    """Mean outcome of each group in windows of ``size`` sessions; stable where both it and the relative one are above zero."""
    known = rows.filter(F.col(value).isNotNull())
    days = known.select("trade_date").distinct().withColumn("window_index", F.floor((F.row_number().over(Window.orderBy("trade_date")) - 1) / size))
    out = known.join(days, "trade_date").groupBy(group, "window_index").agg(F.min("trade_date").alias("window_start"), F.max("trade_date").alias("window_end"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(relative).alias("relative"))
    sample = F.when(F.col("n") >= 120, "POLICY_ELIGIBLE").when(F.col("n") >= 60, "MODERATE").when(F.col("n") >= 30, "PROVISIONAL").otherwise("EXPLORATORY")
    return out.withColumns({"stable": F.coalesce((F.col("mean") > 0) & (F.col("relative") > 0), F.lit(False)), "sample": sample})


def matured_predictions(predictions: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Realised return, its date and hit of the predictions whose horizon has passed."""
    ahead = bars.select("symbol_id", "trade_date", "close", F.lead("trade_date", horizon).over(along()).alias("future_date"), F.lead("close", horizon).over(along()).alias("_f"))
    out = predictions.join(ahead, ["symbol_id", "trade_date"]).filter("_f is not null").withColumn("realised", F.col("_f") / F.nullif("close", F.lit(0.0)) - 1)
    return out.select(*predictions.columns, "future_date", "realised", (F.col("realised") > 0).alias("hit"))


def shifted(day: Column, months: Column) -> Column:
    """A date some months later, on the 28th at most."""
    first = F.add_months(F.trunc(day, "month"), months)
    return F.date_add(first, F.least(F.dayofmonth(day), F.lit(28)) - 1)


def folds(rows: DataFrame, train: int = 12, validation: int = 3, step: int = 3) -> DataFrame:
    """Rolling training and validation windows that fit the dates of the rows, with the rows in each.

    Rows are counted by date first, so that the range join meets dates and not rows.
    """
    days = rows.groupBy("trade_date").agg(F.count("*").alias("_c"))
    span = days.agg(F.min("trade_date").alias("_s"), F.max("trade_date").alias("_e"))
    i = F.col("fold")
    made = span.withColumn("fold", F.explode(F.sequence(F.lit(0), (F.months_between("_e", "_s") / step).cast("int") + 1)))
    made = made.withColumn("train_start", F.when(i == 0, F.col("_s")).otherwise(shifted(F.col("_s"), i * step))).withColumn("validation_start", shifted(F.col("train_start"), F.lit(train)))
    made = made.withColumns({"train_end": F.date_sub("validation_start", 1), "validation_end": F.date_sub(shifted(F.col("validation_start"), F.lit(validation)), 1)}).filter("validation_end <= _e").drop("_s", "_e")
    inside = F.col("trade_date").between(F.col("train_start"), F.col("validation_end"))
    late = F.col("trade_date") >= F.col("validation_start")
    return days.join(F.broadcast(made), inside).groupBy("fold", "train_start", "train_end", "validation_start", "validation_end").agg(F.sum(F.when(~late, F.col("_c")).otherwise(0)).alias("train_rows"), F.sum(F.when(late, F.col("_c")).otherwise(0)).alias("validation_rows"))


def buy_and_hold(bench: DataFrame, start: Column, end: Column) -> DataFrame:
    """Return of the benchmark from its first to its last date in a range."""
    part = bench.filter(F.col("trade_date").between(start, end)).agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.min_by("bench_close", "trade_date").alias("_a"), F.max_by("bench_close", "trade_date").alias("_z"))
    return part.select("first_day", "last_day", (ratio(F.col("_z"), F.col("_a")) - 1).alias("ret"))


def tenth_spread(rows: DataFrame, score: str, outcome: str, n: int = 10, *keys: str) -> DataFrame:
    """Per date of at least n rows: mean outcome of the best and the worst n-th by score."""
    part = Window.partitionBy("trade_date", *keys)
    k = F.row_number().over(part.orderBy(F.desc(score), "symbol_id"))
    size = F.count(F.lit(1)).over(part)
    known = rows.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumns({"_k": k, "_n": size}).filter(F.col("_n") >= n)
    edge = (F.col("_n") - 1) / n
    top = F.avg(F.when(F.col("_k") - 1 <= edge, F.col(outcome)))
    low = F.avg(F.when(F.col("_k") - 1 > edge * (n - 1), F.col(outcome)))
    return known.groupBy("trade_date", *keys).agg(top.alias("top"), low.alias("bottom")).withColumn("spread", F.col("top") - F.col("bottom"))


def drawdown_of_sum(days: DataFrame, value: str, *keys: str) -> DataFrame:
    """Largest fall of the running sum from its peak (zero at the start) over rows that are one per date and key."""
    so_far = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumn("_s", F.sum(value).over(so_far)).withColumn("_top", F.greatest(F.lit(0.0), F.max("_s").over(so_far)))
    return run.groupBy(*keys).agg(F.count("*").alias("n"), F.greatest(F.lit(0.0), F.max(F.col("_top") - F.col("_s"))).alias("max_drawdown"))


def cell_statistics(rows: DataFrame, score: str, outcome: str, *cell: str) -> DataFrame:
    """Per cell: mean of the best and worst tenth by date, their spread, its hit rate and drawdown, and the rank correlation.

    The interval is that of a normal mean over dates, a closed form in place of resampling.
    """
    days = tenth_spread(rows, score, outcome, 10, *cell)
    spread = F.col("spread")
    error = 1.96 * F.stddev_samp(spread) / F.sqrt(F.count("*"))
    out = days.groupBy(*cell).agg(F.avg("top").alias("top"), F.avg("bottom").alias("bottom"), F.avg(spread).alias("spread"), F.avg((spread > 0).cast("double")).alias("hit_rate"), (F.avg(spread) - error).alias("low"), (F.avg(spread) + error).alias("high"))
    return out.join(drawdown_of_sum(days, "spread", *cell), [*cell]).join(pooled_ic(rows, score, outcome, *cell).select(*cell, "ic"), [*cell], "left")


def return_quality(rows: DataFrame, horizons: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """Rows with an implausible forward return are quarantined, with the reasons in order."""
    size = {h: F.coalesce(F.abs(f"fwd_{h}"), F.lit(0.0)) for h in horizons}
    pairs = [p for h in horizons for p in ((size[h] >= EXTREME[h], f"extreme_fwd_{h}d_return"), (size[h] >= REVIEW, "manual_review_extreme_return"))]
    any_ = F.greatest(*[(size[h] >= EXTREME[h]).cast("int") for h in horizons]) == 1
    return rows.withColumns({"fwd_5_anomaly": size[5] >= EXTREME[5], "quality": F.when(any_, "quarantined").otherwise("trusted"), "reason": F.concat_ws("|", reasons(*pairs))})


# --- model frames -------------------------------------------------------------------------------------------


def structure(bars: DataFrame) -> DataFrame:
    """Back returns, volatility, distances from means and highs, range breakouts: the price part of a training row."""
    c = F.col("close")
    mean = {n: full(F.avg("close").over(trailing(n)), trailing(n), least) for n, least in ((20, 5), (50, 10), (200, 30))}
    before = trailing(20, skip=1)
    rows = bars.withColumns({"_r": ratio(c, F.lag("close").over(along())) - 1, **{f"ret_{n}_back": ratio(c, F.lag("close", n).over(along())) - 1 for n in (5, 20, 60)}, **{f"dist_sma_{n}": ratio(c - m, m) for n, m in mean.items()}})
    rows = rows.withColumns({"_h": full(F.max("high").over(before), before, 5), "_l": full(F.min("low").over(before), before, 5), "_v": full(F.avg("volume").over(before), before, 5), "_y": full(F.max("high").over(trailing(252)), trailing(252), 20)})
    deviation = {f"volatility_{n}": full(F.stddev_samp("_r").over(trailing(n)), trailing(n), least, F.col("_r")) for n, least in ((20, 10), (60, 20))}
    above = sum((F.coalesce((F.col(f"dist_sma_{n}") > 0).cast("int"), F.lit(0)) for n in mean), F.lit(0))
    return rows.withColumns({
        **deviation,
        "volume_ratio_20": ratio(F.col("volume"), F.col("_v")),
        "dist_52w_high": 1 - ratio(c, F.col("_y")),
        "range_width_20": ratio(F.col("_h") - F.col("_l"), F.col("_l")),
        "breakout_20": ratio(c - F.col("_h"), F.col("_h")),
        "is_breakout_20": F.coalesce((c > F.col("_h")).cast("int"), F.lit(0)),
        "trend_alignment": above,
    }).drop("_r", "_h", "_l", "_v", "_y")


def with_breadth(bars: DataFrame) -> DataFrame:
    """Each bar with the breadth of its date: shares above two means and above the close 20 and 50 bars ago, in per cent.

    The shares are windows by date, so the rows are not joined with their own aggregate.
    """
    c, day = F.col("close"), Window.partitionBy("trade_date")
    holds = {"pct_above_50": c > full(F.avg("close").over(trailing(50)), trailing(50), 10), "pct_above_200": c > full(F.avg("close").over(trailing(200)), trailing(200), 30), "pct_up_20": c > F.lag("close", 20).over(along()), "pct_up_50": c > F.lag("close", 50).over(along())}
    rows = bars.withColumns({f"_{k}": F.coalesce(v, F.lit(False)).cast("double") for k, v in holds.items()})
    rows = rows.withColumns({k: 100 * F.avg(f"_{k}").over(day) for k in holds}).drop(*[f"_{k}" for k in holds])
    return rows.withColumn("breadth_score", sum((F.col(k) for k in holds), F.lit(0.0)) / len(holds))


def with_sector(rows: DataFrame, sectors: DataFrame, sector_day: DataFrame, own: DataFrame) -> DataFrame:
    """Attach the strength of a row's sector on its date (0.5 where unknown) and the row's lead over it (0)."""
    named = rows.join(sectors.select("symbol_id", "sector"), "symbol_id", "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))
    out = named.join(sector_day.select("trade_date", "sector", "sector_rs"), ["trade_date", "sector"], "left").join(own.select("trade_date", "symbol_id", "stock_vs_sector"), ["trade_date", "symbol_id"], "left")
    return out.withColumns({"sector_rs": F.coalesce("sector_rs", F.lit(0.5)), "stock_vs_sector": F.coalesce("stock_vs_sector", F.lit(0.0))})


def overlay(rows: DataFrame, technical: float = 0.75, model: float = 0.25) -> DataFrame:
    """Technical and model scores of one date blended, with ranks (1 is best, ties share the least) and top tenths."""
    part = Window.partitionBy("trade_date")
    out = rows
    for h in (5, 20):
        p = F.col(f"prob_{h}")
        place = F.rank().over(part.orderBy(p)) + (F.count(F.lit(1)).over(Window.partitionBy("trade_date", p)) - 1) / 2
        out = out.withColumn(f"blend_{h}", technical * F.col("technical_score") + model * 100 * place / F.count(F.lit(1)).over(part))
    size = F.count(F.lit(1)).over(part)
    ranks = {"technical": "technical_score", "model_5": "prob_5", "model_20": "prob_20", "blended_5": "blend_5", "blended_20": "blend_20"}
    out = out.withColumns({f"{k}_rank": F.rank().over(part.orderBy(F.round(F.col(v), 9).desc())) for k, v in ranks.items()})
    return out.withColumns({f"{k}_top": F.col(f"{k}_rank") <= F.greatest(F.lit(1), F.ceil(size * 0.1)) for k in ranks})


def evaluate(rows: DataFrame, score: str, label: str, outcome: str) -> DataFrame:
    """Area under the curve by ranks, precision and mean outcome of the best tenth of all rows, and the base rate.

    The place of the last row of the tenth is counted from rank pieces, so no window sees all rows.
    """
    ranked = kept(spread_rank(rows.filter(F.col(score).isNotNull()), score, "_p"))
    all_ = ranked.agg(F.count("*").alias("_n"))
    ranked = ranked.join(F.broadcast(all_))  # one row
    y = F.coalesce(F.col(label), F.lit(0))
    pos, n = F.sum(y), F.count("*")
    top = F.col("_p") > 0.9
    return ranked.agg(
        n.alias("n"),
        F.when((pos > 0) & (pos < n), (F.sum(y * F.col("_p") * F.col("_n")) - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("auc"),
        F.avg(F.when(top, y.cast("double"))).alias("precision_10"),
        F.avg(F.when(top, F.col(outcome))).alias("mean_top_10"),
        F.avg(F.col(label).cast("double")).alias("base_rate"),
    )


# --- ranks, regimes and stages ------------------------------------------------------------------------------


def rank_day(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Composite of percentiles by date under given weights (made to sum to one); sector strength is 60 % the sector's and 40 % the lead over it."""
    given = {k: max((weights or WEIGHTS).get(k, 0.0), 0.0) for k in WEIGHTS}
    total = sum(given.values())
    given = {k: v / total for k, v in given.items()} if total > 0 else dict(WEIGHTS)
    from barloom.functions.stats import pct_rank

    columns = [k for k in WEIGHTS if k != "sector_strength"] + ["sector_rs", "stock_vs_sector"]
    out = rows.withColumns({f"{c}_pct": 100 * pct_rank(c, "trade_date") for c in columns})
    out = out.withColumn("sector_strength_pct", 0.6 * F.col("sector_rs_pct") + 0.4 * F.col("stock_vs_sector_pct"))
    return out.withColumn("composite_score", sum((F.col(f"{k}_pct") * w for k, w in given.items()), F.lit(0.0)))


def rank_movers(now: DataFrame, before: DataFrame, n: int = 15) -> DataFrame:
    """The largest rises and falls in rank between two runs; of equal moves, those of the score decide."""
    place = lambda df, name: df.withColumn(name, F.rank().over(Window.partitionBy("trade_date").orderBy(F.desc("composite_score"))))
    a = place(now, "rank").select("symbol_id", "rank", F.col("composite_score").alias("score"))
    b = place(before, "previous_rank").select("symbol_id", "previous_rank", F.col("composite_score").alias("previous_score"))
    both = a.join(b, "symbol_id").withColumns({"rank_change": F.col("previous_rank") - F.col("rank"), "score_change": F.col("score") - F.col("previous_score")})
    up = both.filter("rank_change > 0").orderBy(F.desc("rank_change"), F.desc("score_change"), "symbol_id").limit(n).withColumn("side", F.lit("improver"))
    down = both.filter("rank_change < 0").orderBy("rank_change", "score_change", "symbol_id").limit(n).withColumn("side", F.lit("decliner"))
    return up.unionByName(down)


def sector_movers(now: DataFrame, before: DataFrame, n: int = 10) -> DataFrame:
    """Change of each sector's strength and rank between two runs, the largest rises first."""
    old = before.select("sector", F.col("rs").alias("previous_rs"), F.col("rs_rank").alias("previous_rank"))
    out = now.select("sector", "rs", "rs_rank").join(old, "sector", "left").withColumns({"rank_change": F.col("previous_rank") - F.col("rs_rank"), "rs_change": F.col("rs") - F.col("previous_rs")})
    return out.orderBy(F.desc_nulls_last("rank_change"), "sector").limit(n)


def regime_confidence(rows: DataFrame) -> DataFrame:
    """Distance of the share above the 200-bar mean from the nearer edge of its label's band: 1 in the middle, 0 at an edge."""
    edge = lambda i: F.create_map(*[x for k, v in REGIME_BANDS.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("label")]
    p = F.coalesce("pct200", F.lit(0.0))
    inner = F.least(p - edge(0), edge(1) - p) / ((edge(1) - edge(0)) / 2)
    return rows.withColumn("confidence", F.coalesce(clip(inner, 0, 1), F.lit(0.0)))


def regime_phase(rows: DataFrame, transition: float = 0.30) -> DataFrame:
    """Phase of the market from its stage, regime, breadth velocity, share in stage 2 and share above the 200-bar mean."""
    stage, label, speed = F.upper(F.trim(F.coalesce("market_stage", F.lit("")))), F.lower(F.trim(F.coalesce("label", F.lit("")))), F.lower(F.trim(F.coalesce("velocity_bucket", F.lit(""))))
    p, s2, rising = F.col("pct200"), F.coalesce("s2_pct", F.lit(0.0)), None
    rising = speed.isin("positive", "very_positive")
    unknown = p.isNull()
    low = F.coalesce(p < 0.20, F.lit(False))
    phase = (
        F.when((stage == "S4") | (label == "risk_off") | low, "bear_stage4")
        .when(label.isin("bull", "strong_bull") & (stage == "S2") & (unknown | (p > 0.55)), "confirmed_stage2_bull")
        .when(((unknown & (label == "neutral")) | ((p >= 0.20) & (p < 0.50))) & rising & (s2 < transition), "base_forming_stage1")
        .when(((unknown & label.isin("neutral", "cautious_bull")) | (p >= 0.30)) & rising & (s2 >= transition), "transition_stage1_to_stage2")
        .otherwise("mixed_wait")
    )
    zone = F.when(p < 0.20, "capitulation").when(p < 0.30, "bear_bottom_zone").when(p < 0.50, "base_recovery_zone").when(p < 0.75, "risk_on_zone").when(p < 0.90, "broad_bull_zone").when(p.isNotNull(), "overheated_breadth")
    return rows.withColumns({"phase": phase, "level_zone": zone})


def breadth_history(bars: DataFrame, weeks: int = 26) -> DataFrame:
    """Advances against declines and new highs against lows of the last weeks, with their means, sums and a z-score."""
    spec = trailing(252)
    year = F.count(F.lit(1)).over(spec) >= 252
    p = F.lag("close").over(along())
    rows = bars.select("trade_date", F.when(F.col("close") > p, 1).otherwise(0).alias("_up"), F.when(F.col("close") < p, 1).otherwise(0).alias("_down"), F.when(year, 1).otherwise(0).alias("_y"), F.when(year & (F.col("close") >= F.max("close").over(spec)), 1).otherwise(0).alias("_h"), F.when(year & (F.col("close") <= F.min("close").over(spec)), 1).otherwise(0).alias("_l"))
    day = rows.groupBy("trade_date").agg(*[F.sum(c).alias(c) for c in ("_up", "_down", "_y", "_h", "_l")])
    part = lambda n: Window.orderBy("trade_date").rowsBetween(-(n - 1), 0)  # noqa: E731  one row a date
    day = day.withColumns({"ad_net": F.col("_up") - F.col("_down"), "ad_pct": F.coalesce((F.col("_up") - F.col("_down")) / F.nullif(F.col("_up") + F.col("_down"), F.lit(0)), F.lit(0.0)), "net_highs": F.col("_h") - F.col("_l")})
    day = day.withColumns({"_m": F.avg("ad_pct").over(part(252)), "_s": F.when(F.count(F.lit(1)).over(part(252)) >= 2, F.stddev_pop("ad_pct").over(part(252)))})
    day = day.withColumns({
        "ad_10": F.avg("ad_pct").over(part(10)), "ad_20": F.avg("ad_pct").over(part(20)), "ad_sum_63": F.sum("ad_pct").over(part(63)),
        "ad_z": F.when(F.col("_s") > 1e-9, (F.col("ad_pct") - F.col("_m")) / F.col("_s")).otherwise(0.0),
        "net_highs_pct": F.coalesce(F.col("net_highs") / F.nullif("_y", F.lit(0)), F.lit(0.0)),
        "high_low_10": F.avg(F.col("_h") / F.greatest("_l", F.lit(1))).over(part(10)),
    })
    return recent(day, 7 * weeks).select("trade_date", F.col("_up").alias("advancers"), F.col("_down").alias("decliners"), "ad_net", "ad_pct", "ad_10", "ad_20", "ad_sum_63", "ad_z", "net_highs", "net_highs_pct", "high_low_10")


def stage_confidence(rows: DataFrame) -> DataFrame:
    """Weighted components (0 to 100) less the penalty of a failed breakout, and its band."""
    score = clip(sum((w * F.col(c) for c, w in CONFIDENCE.items()), F.lit(0.0)) - F.coalesce("penalty", F.lit(0.0)), 0, 100)
    band = F.when(F.col("confidence") < 50, "LOW").when(F.col("confidence") < 65, "MEDIUM").when(F.col("confidence") < 80, "HIGH").when(F.col("confidence").isNotNull(), "VERY_HIGH")
    return rows.withColumn("confidence", score).withColumn("band", band)


def catalyst_universe(*sources: DataFrame) -> DataFrame:
    """Symbols of several lists in their order; a symbol counts where it comes first."""
    parts = [s.select("symbol_id").withColumn("priority", F.lit(i)) for i, s in enumerate(sources, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("symbol_id").agg(F.min("priority").alias("priority"))


def prioritise(rows: DataFrame) -> DataFrame:
    """Candidates by composite, confidence and decay, the highest first."""
    return rows.orderBy(F.desc_nulls_last("composite_score"), F.desc_nulls_last("rank_confidence"), F.desc_nulls_last("decay_score"), "symbol_id")
