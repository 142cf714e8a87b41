"""Cross-sectional ranking: factors of the latest bars, scores, gates, penalties and rank changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.stats import along, clip, full, pct_rank, ratio, reasons, trailing
from barloom.operators.asof import as_of_join
from barloom.operators.scans import stage2_structure


def close_() -> Column:
    return F.col("close")


def volume_() -> Column:
    return F.col("volume")


def by_symbol() -> WindowSpec:
    return along()

DATE = ("trade_date",)

#: Fixed weights of the composite and of the relative-strength blend.
WEIGHTS = {"rel_strength": 0.38, "trend": 0.22, "proximity": 0.18, "sector_strength": 0.22}
RS_BLEND = {"ret_20": 0.2, "ret_60": 0.5, "ret_120": 0.3}
DEMEANED = ("rel_strength", "trend")


def latest(rows: DataFrame, *keys: str, order: str = "trade_date") -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*(keys or ("symbol_id",))).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each symbol: enough history for frames that add up to n."""
    back = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date")))
    return rows.withColumn("_n", back).filter(F.col("_n") <= n).drop("_n")


def returns(bars: DataFrame, *lags: int) -> DataFrame:
    """Returns over several lags, in per cent."""
    return bars.withColumns({f"ret_{n}": 100 * (ratio(close_(), F.lag("close", n).over(by_symbol())) - 1) for n in (lags or (5, 10, 20, 60, 120))})


def volume_stats(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean and maximum over the last n + 1 bars, and the z-score against the n bars before (sample deviation)."""
    here, before = trailing(n + 1), trailing(n, skip=1)
    return bars.withColumns({"vol_mean": F.avg("volume").over(here), "vol_max": F.max("volume").over(here), "vol_z": ratio(volume_() - F.avg("volume").over(before), F.stddev_samp("volume").over(before))})


def averages(bars: DataFrame) -> DataFrame:
    return bars.withColumns({f"sma_{n}": F.avg("close").over(trailing(n)) for n in (20, 50, 200)} | {"bar_count": F.count(F.lit(1)).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))})


def year_high(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"high_52w": F.max("high").over(trailing(252)), "lookback": F.count(F.lit(1)).over(trailing(252))})


def relative_strength(rows: DataFrame, *keys: str) -> DataFrame:
    """Blend of the percentiles of the 20-, 60- and 120-bar returns; a missing return counts as the middle."""
    parts = [w * 100 * F.coalesce(pct_rank(c, *(keys or DATE)), F.lit(0.5)) for c, w in RS_BLEND.items()]
    return rows.withColumn("rel_strength", sum(parts[1:], parts[0]))


def excess_strength(rows: DataFrame, bench: DataFrame, mix: float = 0.3) -> DataFrame:
    """Mean return in excess of the benchmark's, as a percentile, mixed into the relative strength."""
    names = [c for c in bench.columns if c.startswith("ret_")]
    renamed = bench.select("trade_date", *[F.col(c).alias(f"_b_{c}") for c in names])
    joined = rows.join(renamed, "trade_date", "left")
    parts = [F.col(c) - F.col(f"_b_{c}") for c in names]
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    excess = ratio(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), n.cast("double"))
    out = joined.withColumn("excess", excess)
    return out.withColumn("rel_strength_x", (1 - mix) * F.col("rel_strength") + mix * 100 * F.coalesce(pct_rank("excess", "trade_date"), F.lit(0.5))).drop(*[f"_b_{c}" for c in names])


def acceleration(rows: DataFrame, rs_delta: str | None = None) -> DataFrame:
    delta = F.coalesce(F.col(rs_delta), F.lit(0.0)) if rs_delta else F.lit(0.0)
    return rows.withColumn("acceleration", 0.6 * (F.col("ret_5") - F.col("ret_20")) + 0.4 * (F.col("ret_10") - F.col("ret_20")) + 0.25 * delta)


def volume_intensity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("volume_intensity", 0.6 * clip(ratio(volume_(), F.col("vol_mean")), 0, 5) + 0.4 * clip(F.col("vol_z"), -3, 5))


def trend_score(rows: DataFrame) -> DataFrame:
    above = F.when(close_() > F.col("sma_20"), 40.0).otherwise(0.0) + F.when(close_() > F.col("sma_50"), 60.0).otherwise(0.0)
    return rows.withColumn("trend", 0.7 * F.least(F.coalesce(F.col("adx"), F.lit(0.0)) / 50 * 100, F.lit(100.0)) + 0.3 * above)


def above_long_average(rows: DataFrame) -> DataFrame:
    return rows.withColumn("above_sma200_pct", F.when(F.col("bar_count") >= 200, 100 * (ratio(close_(), F.col("sma_200")) - 1)).otherwise(0.0))


def proximity(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"proximity": clip(100 * ratio(close_(), F.col("high_52w")), 0, 100), "short_history": F.col("lookback") < 252})


def fill_by_sector(rows: DataFrame, column: str, default: float = 20.0) -> DataFrame:
    """Fill a missing value with its sector's median, the universe's, then the default; says which rows were filled."""
    own = F.percentile(column, F.lit(0.5))
    by_sector, by_all = own.over(Window.partitionBy("trade_date", "sector")), own.over(Window.partitionBy("trade_date"))
    return rows.withColumns({f"{column}_imputed": F.col(column).isNull(), column: F.coalesce(F.col(column), by_sector, by_all, F.lit(default))})


def sector_scores(rows: DataFrame) -> DataFrame:
    """Percentile of the sector's strength and of the stock's margin over it."""
    out = rows.withColumn("vs_sector", F.round(F.col("rel_strength") - F.col("sector_rs"), 9))
    return out.withColumn("sector_strength", 60 * F.coalesce(pct_rank("sector_rs", "trade_date"), F.lit(0.5)) + 40 * F.coalesce(pct_rank("vs_sector", "trade_date"), F.lit(0.5)))


def attach_sector(rows: DataFrame, sector_rs: DataFrame) -> DataFrame:
    """The latest known sector strength (carried forward) and its percentile and the stock's margin over it."""
    filled = sector_rs.withColumn("sector_rs", F.round(F.last("sector_rs", ignorenulls=True).over(Window.partitionBy("sector").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)), 9))
    return sector_scores(rows.join(filled.select("sector", "trade_date", "sector_rs"), ["sector", "trade_date"], "left"))


def own_sector(rows: DataFrame) -> DataFrame:
    """The same for sector strengths that are means of the rows themselves: a window instead of a join."""
    return sector_scores(rows.withColumn("sector_rs", F.round(F.avg("rel_strength").over(Window.partitionBy("trade_date", "sector")), 9)))


def clipped(column: str, *keys: str, low: float = 0.05, high: float = 0.95) -> Column:
    """A column clipped at two quantiles of the date; quantiles interpolate."""
    edges = F.percentile(column, [low, high]).over(Window.partitionBy(*(keys or DATE)))
    return F.when(F.col(column).isNotNull(), F.greatest(edges[0], F.least(edges[1], F.col(column))))


def winsorise(rows: DataFrame, column: str, low: float = 0.05, high: float = 0.95, *keys: str) -> DataFrame:
    return rows.withColumn(column, clipped(column, *keys, low=low, high=high))


def centred(column: str, *keys: str) -> Column:
    return F.col(column) - F.percentile(column, F.lit(0.5)).over(Window.partitionBy(*(keys or DATE), "sector"))


def demean(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    return rows.withColumn(column, centred(column, *keys))


def composite(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Winsorise, de-mean by sector where due, turn into percentiles and weigh; rank overall and within the sector.

    All factors go through each step together, so that one window by date clips
    them and one by sector centres them. Factors are rounded first, so that ties
    do not hang on the last digit.
    """
    weights = weights or WEIGHTS
    out = rows.withColumns({f"f_{c}": F.round(c, 6) for c in weights})
    out = out.withColumns({f"f_{c}": clipped(f"f_{c}") for c in weights})
    out = out.withColumns({f"f_{c}": F.round(centred(f"f_{c}"), 9) for c in weights if c in DEMEANED})
    scores = [w * 100 * F.coalesce(pct_rank(f"f_{c}", "trade_date"), F.lit(0.5)) for c, w in weights.items()]
    out = out.withColumn("composite", sum(scores[1:], scores[0])).drop(*[f"f_{c}" for c in weights])
    # ties by symbol after rounding, so that order does not hang on the last digit
    best = [F.round("composite", 6).desc(), F.col("symbol_id")]
    return out.withColumns(
        {
            "rank": F.row_number().over(Window.partitionBy("trade_date").orderBy(*best)),
            "sector_rank": F.row_number().over(Window.partitionBy("trade_date", "sector").orderBy(*best)),
            "sector_size": F.count(F.lit(1)).over(Window.partitionBy("trade_date", "sector")),
        }
    )


def top(rows: DataFrame, n: int, minimum: float | None = None) -> DataFrame:
    kept = rows if minimum is None else rows.filter(F.col("composite") >= minimum)
    return kept.orderBy(F.round("composite", 6).desc(), "symbol_id").limit(n)


def confidence(rows: DataFrame) -> DataFrame:
    ready = F.least(F.col("bar_count") / 252.0, F.lit(1.0))
    return rows.withColumn("confidence", ready * F.when(F.col("eligible"), 1.0).otherwise(0.5) * (1 - clip(F.col("penalty"), 0, 100) / 100))


def rank_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rank and score of now with those of before and the differences; a fall in rank number is a rise."""
    old = before.select("symbol_id", F.col("rank").alias("previous_rank"), F.col("composite").alias("_c"))
    return now.join(old, "symbol_id", "left").withColumns({"rank_delta": F.col("previous_rank") - F.col("rank"), "score_delta": F.col("composite") - F.col("_c")}).drop("_c")


def churn(now: DataFrame, before: DataFrame) -> DataFrame:
    old = before.select("symbol_id", F.col("rank").alias("_r"))
    return now.join(old, "symbol_id").agg(F.avg((F.col("rank") != F.col("_r")).cast("double")).alias("churn"), F.count("*").alias("compared"))


def factor_correlation(rows: DataFrame, factors: list[str], limit: float = 0.7) -> DataFrame:
    """Correlation of each pair of factors and whether it exceeds the limit."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    wide = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])
    return wide.select(F.explode(items).alias("x")).select("x.left", "x.right", F.col("x.r").alias("correlation"), (F.abs("x.r") > limit).alias("violation"))


def eligibility(rows: DataFrame, price: float = 20.0, liquidity: float = 0.2, history: int = 60) -> DataFrame:
    gates = reasons((close_() < price, "price"), (F.col("bar_count") < history, "history"), (F.coalesce(F.col("liquidity_pct"), F.lit(0.0)) < liquidity, "liquidity"))
    return rows.withColumn("_why", gates).withColumns({"rejection": F.concat_ws(",", "_why"), "eligible": F.size("_why") == 0}).drop("_why")


def penalties(rows: DataFrame) -> DataFrame:
    """Points off: below the long average, illiquid, a wide range, exhaustion, far above the pivot.

    Signs of exhaustion are a volume z-score (vol_z20, else vol_z) above 3, a band
    width above the 95th percentile (bb_width_percentile, as a share) and a close
    more than 12 % above its short average; one is mild, two are strong, and so is
    a z-score above 4 or a close 20 % above. The pivot is the first known of
    pivot_price, breakout_level and resistance_level. Unknown values cost nothing.
    """
    is_ = lambda c: F.coalesce(c, F.lit(False))
    one = lambda *names: F.coalesce(*[F.col(c) for c in names if c in rows.columns], F.lit(None).cast("double"))
    stretched, z = ratio(close_(), F.col("sma_20")) - 1, one("vol_z20") if "vol_z20" in rows.columns else one("vol_z")
    signs = sum((is_(c).cast("int") for c in (z > 3, one("bb_width_percentile") > 0.95, stretched > 0.12)), F.lit(0))
    strong = is_(z > 4) | is_(stretched > 0.20) | (signs >= 2)
    pivot, atr = one("pivot_price", "breakout_level", "resistance_level"), F.col("atr_14")
    away = F.when((pivot > 0) & (atr > 0), (close_() - pivot) / atr)
    parts = [
        F.when((F.col("bar_count") >= 200) & (close_() < F.col("sma_200")), 10.0).otherwise(0.0),
        F.when(F.col("liquidity_pct") < 0.2, 10.0).otherwise(0.0),
        F.when(ratio(atr, close_()) > 0.08, 5.0).otherwise(0.0),
        F.when(strong, 8.0).when(signs >= 1, 3.0).otherwise(0.0),
        F.when(away > 2.5, 6.0).when(away > 1.5, 3.0).otherwise(0.0),
    ]
    flag = F.when(strong, "strong_exhaustion").when(signs >= 1, "mild_exhaustion").otherwise("")
    return rows.withColumns({"penalty": sum(parts[1:], parts[0]), "exhaustion_flag": flag, "distance_from_pivot_atr": away})


def decay(rows: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    age = F.datediff(as_of, F.col("trade_date"))
    return rows.withColumns({"age_days": age, "decay": F.greatest(F.lit(0.0), 1 - age / float(days))})


def freshness(rows: DataFrame) -> DataFrame:
    """Points for a young stage 2 (8 and 15 weeks) and for one that came from stage 1; a week without a stage has none."""
    w = F.col("weeks_in_stage")
    fresh = F.when(F.col("stage") == "S2", F.when(w <= 8, 4.0).when(w <= 15, 2.0).otherwise(0.0)).otherwise(0.0)
    turned = F.when((F.col("previous_stage") == "S1") & (F.col("stage") == "S2") & (w <= 8), 5.0).otherwise(0.0)
    return rows.withColumns({"freshness_bonus": fresh, "transition_bonus": turned, "bonus": fresh + turned})


def structured(bars: DataFrame) -> DataFrame:
    """Bars with their stage-2 score as far as it follows from the symbol alone (``_stage2``)."""
    high, volume = full(F.max("high").over(trailing(252)), trailing(252), 20), full(F.avg("volume").over(trailing(20, skip=1)), trailing(20, skip=1), 10)
    rows = bars.select("symbol_id", "trade_date", "open", "high", "low", "close", "volume", clip(100 * (1 - ratio(close_(), high)), 0, 100).alias("near_52w_high_pct"), ratio(volume_(), volume).alias("volume_ratio_20"))
    return stage2_structure(rows).select("symbol_id", "trade_date", "open", "high", "low", "close", "volume", F.col("stage2_score").alias("_stage2"), "is_stage2_structural")


def adjusted(rows: DataFrame) -> DataFrame:
    """The composite with points for the stage-2 score, a young stage 2 and the turn to it, less the penalties, within 0 to 100."""
    strength = F.coalesce("rel_strength", F.lit(0.0))
    score = clip(F.col("_stage2") + F.when(strength >= 70, 10.0).otherwise(0.0) + F.when(strength >= 85, 10.0).otherwise(0.0), 0, 100)
    rows = rows.withColumn("stage2_score", score).drop("_stage2")
    total = F.col("composite") + 5 * F.coalesce("stage2_score", F.lit(0.0)) / 100 + F.col("freshness_bonus") + F.col("transition_bonus") - F.col("penalty")
    return rows.withColumn("adjusted", clip(total, 0, 100))


STAGE = ["stage", "weeks_in_stage", "previous_stage"]


def _no_stages(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"stage": F.lit(None).cast("string"), "weeks_in_stage": F.lit(None).cast("int"), "previous_stage": F.lit(None).cast("string")})


def factors(bars: DataFrame, master: DataFrame) -> DataFrame:
    """All factors of all bars, one shuffle by symbol and one by date."""
    from barloom.operators.indicators import adx, atr, liquidity, volume_zscore

    rows = year_high(averages(volume_stats(returns(atr(adx(volume_zscore(structured(bars), 20)))))))
    rows = liquidity(rows).join(master, "symbol_id", "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))
    return proximity(above_long_average(trend_score(volume_intensity(acceleration(relative_strength(rows))))))


def rank_all_days(bars: DataFrame, master: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """The ranking of every day; a day knows the last weekly stage (symbol_id, week_end and STAGE) at or before it."""
    rows = factors(bars, master)
    rows = as_of_join(rows, stages, "symbol_id", "trade_date", "week_end", STAGE).drop("matched_at") if stages is not None else _no_stages(rows)
    return adjusted(freshness(confidence(penalties(eligibility(composite(own_sector(rows)))))))


def rank_latest(bars: DataFrame, master: DataFrame, n: int = 25, history: int = 300, stages: DataFrame | None = None) -> DataFrame:
    """The top n of the last session: only the tail of each symbol enters the windows.

    Each symbol's last bar is its row of the cross-section, whatever its date.
    Stages are the latest of each symbol (symbol_id and STAGE).
    """
    from barloom.operators.indicators import adx, atr, volume_zscore

    near = structured(tail(bars, history))
    rows = latest(year_high(averages(volume_stats(returns(atr(adx(volume_zscore(near, 20))))))))
    rows = rows.withColumn("session", F.col("trade_date"))
    # one row a symbol is left, and all of them are one cross-section: the last session of all, one row
    end = rows.agg(F.max("trade_date").alias("_end"))
    rows = rows.join(F.broadcast(end)).withColumn("trade_date", F.col("_end")).drop("_end")
    rows = rows.join(stages.select("symbol_id", *STAGE), "symbol_id", "left") if stages is not None else _no_stages(rows)
    rows = rows.withColumn("liquidity_pct", pct_rank(close_() * volume_(), "trade_date")).join(master, "symbol_id", "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))
    rows = proximity(above_long_average(trend_score(volume_intensity(acceleration(relative_strength(rows))))))
    judged = adjusted(freshness(confidence(penalties(eligibility(composite(own_sector(rows)))))))
    return top(judged.filter("eligible"), n)


def information(panel: DataFrame, score: str, outcome: str, n: int = 20) -> DataFrame:
    """Per date: Spearman correlation, share of the top n by score among the top n by outcome, and lift of the top tenth."""
    rows = panel.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    part = Window.partitionBy("trade_date")
    ranked = rows.withColumns({"_s": pct_rank(score, "trade_date"), "_o": pct_rank(outcome, "trade_date"), "_a": F.row_number().over(part.orderBy(F.desc(score), "symbol_id")), "_b": F.row_number().over(part.orderBy(F.desc(outcome), "symbol_id")), "_d": F.ntile(10).over(part.orderBy(F.desc(score), "symbol_id"))})
    hit = F.avg(F.when(F.col("_a") <= n, (F.col("_b") <= n).cast("double")))
    return ranked.groupBy("trade_date").agg(F.count("*").alias("n"), F.corr("_s", "_o").alias("ic"), hit.alias("hit_rate"), (F.avg(F.when(F.col("_d") == 1, F.col(outcome))) - F.avg(outcome)).alias("lift"))


def history_upsert(stored: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """Stored rows without those that fresh rows replace, and the fresh rows."""
    return stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)
