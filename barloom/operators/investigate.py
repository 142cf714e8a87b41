"""Evidence behind a move: volume, price structure, buyers, sector support, catalysts, crosses of averages, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import along, clip, nearest, ratio, trailing
from barloom.operators.indicators import volume_zscore

# Limits, points and labels that results are compared by.
POINTS = {"EARNINGS_RERATING": 20, "ORDER_WIN": 18, "SECTOR_ROTATION": 15, "SMART_MONEY_EVENT": 16, "WEEKLY_MOMENTUM": 14, "STEALTH_ACCUMULATION": 13, "SHORT_COVERING": 10, "OPERATOR_SPIKE": 3, "RANDOM_NOISE": 5}
COMPONENTS = ("price_structure_score", "volume_delivery_score", "fundamental_score", "trigger_quality_score", "sector_support_score", "buyer_fingerprint_score", "ranking_overlay_score")
FAR_BELOW, IMMINENT, DEATH_DELTA, RECENT = -10.0, -3.0, -0.5, 20
EXTREME = (-30.0, 50.0)


def _is(condition: Column) -> Column:
    """False where the condition is unknown."""
    return F.coalesce(condition, F.lit(False))


def _points(*rules: tuple[Column, int]) -> Column:
    parts = [F.when(_is(c), p).otherwise(0) for c, p in rules]
    return sum(parts[1:], parts[0])


def evidence(bars: DataFrame) -> DataFrame:
    """What the last bar of each symbol shows: returns, volume ratios and trend, tightness of the base, breakout."""
    day, before = F.col("close"), trailing(20, skip=1)
    rows = bars.withColumns(
        {
            "daily_return_pct": 100 * (ratio(day, F.lag("close").over(along())) - 1),
            "volume_ratio_20": ratio(F.col("volume"), F.avg("volume").over(before)),
            "volume_ratio_5d": ratio(F.avg("volume").over(trailing(5)), F.avg("volume").over(before)),
            "volume_trend_10d": 100 * (ratio(F.avg("volume").over(trailing(5)), F.avg("volume").over(trailing(5, skip=5))) - 1),
            "base_tightness_pct": 100 * ratio(F.max("high").over(trailing(10, skip=1)) - F.min("low").over(trailing(10, skip=1)), day),
            "is_breakout": day > F.max("high").over(before),
            "_n": F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date"))),
        }
    )
    return rows.filter("_n = 1").drop("_n")


def volume_anatomy(rows: DataFrame) -> DataFrame:
    """Up to 20 points for volume, delivery and their trend, and marks of low delivery and fading volume."""
    most = F.coalesce(F.greatest("volume_ratio_20", "volume_ratio_5d"), F.lit(0.0))
    low = _is(F.col("delivery_pct") < 20)
    score = _points((most > 2, 6), (most > 5, 4), (F.col("delivery_pct") > 50, 6), (F.col("volume_trend_10d") > 0, 4), (low, -6))
    return rows.withColumns({"volume_delivery_score": clip(score, 0, 20), "volume_unusual": most > 5, "low_delivery_flag": low, "volume_ratio_declining": _is(F.col("volume_trend_10d") < 0)})


def price_structure(rows: DataFrame) -> DataFrame:
    """Up to 15 points for the shape of the bar and its base, and whether the bar is a trap."""
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    parts = {"body_pct_of_range": 100 * F.abs(F.col("close") - F.col("open")) / span, "close_position_pct": 100 * (F.col("close") - F.col("low")) / span, "upper_wick_pct": 100 * (F.col("high") - F.col("close")) / span}
    shaped = rows.withColumns(parts)
    wick = _is((F.col("upper_wick_pct") >= 45) & (F.col("close_position_pct") < 50))
    score = _points((F.col("body_pct_of_range") > 70, 4), (F.col("close_position_pct") >= 75, 4), (F.col("is_breakout"), 4), (F.col("base_tightness_pct") <= 6, 3))
    return shaped.withColumns({"price_structure_score": F.least(score, F.lit(15)), "long_upper_wick_trap": wick, "hard_trap_flag": wick | _is(F.col("close_position_pct") < 35)})


def classify_move(rows: DataFrame) -> DataFrame:
    """Tag of what may have moved the price and its points. Rows have event_text, trigger_reason, sector_rotation and low_delivery_flag."""
    text = F.lower(F.coalesce("event_text", F.lit("")))
    said = lambda words: text.rlike(words)
    found = (
        F.when(said("bulk|block|insider|promoter"), "SMART_MONEY_EVENT")
        .when(_is(F.col("sector_rotation")), "SECTOR_ROTATION")
        .when(said("order|contract|tender"), "ORDER_WIN")
        .when(said("earn|result|profit|revenue"), "EARNINGS_RERATING")
        .when(F.upper("trigger_reason") == "STEALTH_ACCUMULATION", "STEALTH_ACCUMULATION")
        .when(F.upper("trigger_reason") == "WEEKLY_GAINER", "WEEKLY_MOMENTUM")
        .when(_is(F.col("low_delivery_flag")), "OPERATOR_SPIKE")
        .otherwise("RANDOM_NOISE")
    )
    points = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    tagged = rows.withColumn("move_tag", found)
    credible = ~F.col("move_tag").isin("RANDOM_NOISE", "OPERATOR_SPIKE") | (F.trim(text) != "")
    return tagged.withColumns({"trigger_quality_score": points[F.col("move_tag")].cast("double"), "credible_trigger": credible})


def sector_support(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """Up to 10 points for a strong or rotating sector. Sectors have sector, sector_rs, rs_rank_pct, quadrant and peer_gainers, one row each."""
    known = sectors.select(F.upper("sector").alias("_key"), F.col("sector_rs").alias("_rs"), F.col("rs_rank_pct").alias("_pct"), F.lower("quadrant").alias("_q"), F.col("peer_gainers").alias("_peers"))
    # one row a sector, whose number the check below bounds
    joined = rows.withColumn("_key", F.upper("sector")).join(known.dropDuplicates(["_key"]), "_key", "left")
    rotating = _is(F.col("_peers") >= 5) | _is(F.col("_q") == "leading")
    positive = _is(F.col("_rs") > 0) | _is(F.col("_pct") >= 60) | _is(F.col("_q").isin("leading", "improving"))
    score = _points((positive, 4), (rotating, 3), (F.col("stock_vs_sector_rs") > 0, 3))
    return joined.withColumns({"sector_support_score": F.least(score, F.lit(10)), "sector_rotation": rotating, "sector_clustering": rotating | _is(F.col("_peers") >= 3)}).drop("_key", "_rs", "_pct", "_q", "_peers")


def buyer_fingerprint(rows: DataFrame) -> DataFrame:
    """Up to 15 points for delivery on a rise and large buyers. Rows have move_tag, bulk_buyer and oi_rising."""
    up, delivery = _is(F.col("daily_return_pct") > 0), F.col("delivery_pct")
    large = _is(F.col("bulk_buyer")) | _is(F.col("move_tag") == "SMART_MONEY_EVENT")
    score = _points(((delivery > 50) & up, 7), (large, 4), (F.col("oi_rising") & up, 4), ((delivery < 20) & up, -5))
    return rows.withColumn("buyer_fingerprint_score", clip(score, 0, 15))


def verdict(rows: DataFrame) -> DataFrame:
    """Sum of the components (absent ones count 0) with the rank's overlay, and the verdict with its overrides."""
    rank = F.col("composite")
    overlay = F.when(rank >= 75, 15).when(rank >= 60, 8).when(rank >= 45, 3).when(rank < 35, -10).otherwise(0)
    scored = rows.withColumn("ranking_overlay_score", overlay)
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in COMPONENTS if c in scored.columns]
    scored = scored.withColumn("final_score", clip(sum(parts[1:], parts[0]), 0, 100))
    score = F.col("final_score")
    plain = F.when(score >= 80, "HIGH_CONVICTION").when(score >= 55, "MEDIUM_CONVICTION").when(score >= 35, "WATCH_ONLY").otherwise("NOISE_TRAP")
    said = F.when(_is(F.col("hard_trap_flag")), "NOISE_TRAP").when(_is(rank < 35) & ~_is(F.col("credible_trigger")), "NOISE_TRAP").when(_is(rank < 45) & (plain != "NOISE_TRAP"), "WATCH_ONLY").otherwise(plain)
    missing = _is(F.col("fa_missing")) if "fa_missing" in rows.columns else F.lit(False)
    return scored.withColumn("verdict", F.when(missing & (said == "HIGH_CONVICTION"), "MEDIUM_CONVICTION").otherwise(said))


def trap_category(rows: DataFrame) -> DataFrame:
    """Why a dropped row was a trap. Rows have reason (text), price_progression_pct, rank_change_20d and the volume marks."""
    said = F.upper(F.coalesce("reason", F.lit("")))
    kind = (
        F.when(_is(F.col("low_delivery_flag")) | said.rlike("LOW_DELIVERY|ILLIQUID|LIQUIDITY"), "Low delivery / liquidity")
        .when(_is(F.col("volume_ratio_declining")), "Volume not sustaining")
        .when(_is(F.col("rank_change_20d") > 25), "Rank collapse")
        .when(_is(F.col("price_progression_pct") < 0), "Price fade")
        .when(said.rlike("ONE_CANDLE|OPERATOR|SPIKE"), "One-day spike")
        .otherwise("Trap evidence")
    )
    return rows.withColumn("trap_category", kind)


def cross_inputs(bars: DataFrame) -> DataFrame:
    """Averages of the last bar of each symbol with their slopes, the change of their gap and the sessions since the 50 passed the 200."""
    w = along()
    rows = bars.withColumns({f"sma_{n}": F.avg("close").over(trailing(n)) for n in (20, 50, 150, 200)} | {"_k": F.row_number().over(w)})
    rows = rows.withColumns({"_gap": 100 * (ratio(F.col("sma_50"), F.col("sma_200")) - 1), "_up": F.col("sma_50") > F.col("sma_200")})
    crossed = F.col("_up") & ~F.lag("_up").over(w)
    rows = rows.withColumns({"_crossed": F.when(crossed, F.col("_k")), "gap_delta_20d": F.col("_gap") - F.lag("_gap", 20).over(w), "slope_50": 100 * (ratio(F.col("sma_50"), F.lag("sma_50", 20).over(w)) - 1), "slope_200": 100 * (ratio(F.col("sma_200"), F.lag("sma_200", 20).over(w)) - 1)})
    since = F.col("_k") - F.last("_crossed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"days_since": since, "_n": F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date")))})
    rows = rows.filter("_n = 1").withColumn("failed", _is(~F.col("_up") & (F.col("days_since") <= RECENT)))
    return rows.drop("_k", "_gap", "_up", "_crossed", "_n")


def golden_cross(rows: DataFrame) -> DataFrame:
    """Status, quality and plausibility of the 50-bar average against the 200-bar one."""
    a20, a50, a150, a200 = (F.col(f"sma_{n}") for n in (20, 50, 150, 200))
    gap, delta = 100 * (ratio(a50, a200) - 1), F.col("gap_delta_20d")
    known = _is((a50 > 0) & (a200 > 0))
    up, steeper = _is(a50 > a200), F.col("slope_50") > F.col("slope_200")
    closing = ~up & _is(delta > 0)
    status = (
        F.when(~known, "UNKNOWN")
        .when(F.col("failed"), "FAILED_CROSS")
        .when(up & _is((delta < DEATH_DELTA) & ~steeper & (F.col("slope_50") != F.col("slope_200"))), "DEATH_CROSS_RISK")
        .when(up & _is(F.col("days_since").between(0, RECENT)), "CROSSED_RECENTLY")
        .when(up, "CROSSED_ESTABLISHED")
        .when(closing & _is((gap >= IMMINENT) & (gap < 0) & steeper), "IMMINENT")
        .when(closing & _is((gap >= FAR_BELOW) & (gap < IMMINENT)), "APPROACHING")
        .otherwise("FAR_BELOW")
    )
    share = lambda c: F.when(c, 100.0).otherwise(0.0)
    quality = 0.45 * clip((delta + 2) / 5 * 100, 0, 100) + 0.35 * share(up) + 0.20 * share(_is(a20 > a50))
    flag = F.when(~known, "INSUFFICIENT_HISTORY").when(gap > EXTREME[1], "EXTREME_POSITIVE_GAP").when(gap < EXTREME[0], "EXTREME_NEGATIVE_GAP").otherwise("NORMAL")
    long_term = F.when(up & _is(a150 > a200), "CONFIRMED").when(_is(a150 > a200), "CONSTRUCTIVE").otherwise("UNCONFIRMED")
    return rows.withColumns({"gap_pct": gap, "cross_status": status, "cross_quality": F.when(F.col("failed"), 0.0).otherwise(quality), "gap_flag": flag, "alignment": long_term})


def liquid_universe(bars: DataFrame, n: int = 800, least_days: int = 180, lookback: int = 365) -> DataFrame:
    """The n symbols of the largest median traded value over the look-back before the last session, with enough days of it."""
    # a single row
    end = bars.agg(F.max("trade_date").alias("_end"))
    recent = bars.filter("close is not null and volume > 0").join(F.broadcast(end), F.col("trade_date") >= F.date_sub("_end", lookback))
    value = F.col("close") * F.col("volume")
    kept = recent.groupBy("symbol_id").agg(F.percentile(value, F.lit(0.5)).alias("median_turnover"), F.avg(value).alias("avg_turnover"), F.count("*").alias("recent_days")).filter(F.col("recent_days") >= least_days)
    return kept.orderBy(F.round("median_turnover", 6).desc(), F.round("avg_turnover", 6).desc(), "symbol_id").limit(n)


def momentum_over(rows: DataFrame, days: DataFrame, n: int = 20) -> DataFrame:
    """Change of each sector's strength over n sessions, the older value carried forward. Days have trade_date and day_no."""
    older = Window.partitionBy("sector").orderBy("day_no").rangeBetween(Window.unboundedPreceding, -n)
    return rows.join(days, "trade_date").withColumn("momentum", F.col("sector_rs") - F.last("sector_rs", ignorenulls=True).over(older))


def scan(rows: DataFrame, sectors: DataFrame, strong: int = 3) -> DataFrame:
    """Class and score of the stocks of strong or turning sectors. Rows have rs, rs_20, rs_50 and momentum; sectors have sector_rs and momentum."""
    place = F.rank().over(Window.orderBy(F.round("sector_rs", 9).desc()))
    chosen = sectors.withColumn("_place", place).filter((F.col("_place") <= strong) | (F.round("momentum", 9) < 0)).select("sector")
    own = F.col("rs") - F.avg("rs").over(Window.partitionBy("sector"))
    judged = rows.filter("rs is not null").withColumn("rs_vs_sector", F.round(own, 9)).join(chosen, "sector", "left_semi").withColumn("acceleration", F.round(F.col("rs_20") - F.col("rs_50"), 9))
    kind = (
        F.when((F.col("rs") > 0.9) & (F.col("rs_vs_sector") > 0.2) & (F.round("momentum", 9) > 0), "BUY")
        .when((F.col("acceleration") > 0.2) & (F.col("rs_vs_sector") > 0), "EARLY")
        .when(F.col("rs") > 0.7, "WATCH")
        .otherwise("REJECT")
    )
    return judged.withColumns({"category": kind, "score": 0.5 * F.col("rs") + 0.3 * F.col("rs_20") + 0.2 * (F.col("rs_vs_sector") + 0.5)})


def confirmations(bars: DataFrame, levels: DataFrame, wait: int = 15, least_ratio: float = 1.5, least_z: float = 2.0) -> DataFrame:
    """The first of the ``wait`` bars after a level (symbol_id, trade_date, resistance) that closes above it with its volume confirmed."""
    rows = volume_zscore(bars).withColumns({"_v": ratio(F.col("volume"), F.avg("volume").over(trailing(20, skip=1))), "_n": F.row_number().over(along())})
    loud = _is(F.col("_v") >= least_ratio) & (_is(nearest(F.col("vol_z20")) >= least_z) | _is(nearest(F.col("vol_z50")) >= least_z))
    numbered = rows.select("symbol_id", "trade_date", "close", "_n", loud.alias("_loud"))
    ahead = levels.join(numbered.select("symbol_id", "trade_date", "_n"), ["symbol_id", "trade_date"]).select("symbol_id", F.col("trade_date").alias("pattern_end"), "resistance", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + wait)).alias("_n"))
    met = ahead.join(numbered, ["symbol_id", "_n"]).filter(F.col("_loud") & (F.col("close") > F.col("resistance")))
    return met.groupBy("symbol_id", "pattern_end", "resistance").agg(F.min("trade_date").alias("confirmed_on"), F.min_by("close", "_n").alias("confirmed_close"))
