"""Weekly stages, breakouts, market breadth and sector rotation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.stats import along, clip, deviation, full, pct_rank, ratio, reasons, trailing


def close_() -> Column:
    return F.col("close")


def high_() -> Column:
    return F.col("high")


def low_() -> Column:
    return F.col("low")


def open_() -> Column:
    return F.col("open")


def volume_() -> Column:
    return F.col("volume")


def by_symbol() -> WindowSpec:
    return along()


def by_week() -> WindowSpec:
    return along(order="week_end")


def by_day() -> WindowSpec:
    """Over rows that are one per date."""
    return Window.orderBy("trade_date")



# --- weekly bars and stages -------------------------------------------------------------------------------


def weekly(bars: DataFrame) -> DataFrame:
    """Bars of weeks that end on Friday, with averages, slope, range of the closes of 52 weeks, true range and volume ratio.

    Averages need full windows, the range ten weeks.
    """
    week = F.next_day(F.date_sub("trade_date", 1), "Fri")
    rows = bars.groupBy("symbol_id", week.alias("week_end")).agg(F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"), F.sum("volume").alias("volume"))
    t = lambda n: trailing(n, order="week_end")
    mean = lambda c, n: full(F.avg(c).over(t(n)), t(n), n, F.col(c))
    rows = rows.withColumns({f"ma{n}w": mean("close", n) for n in (10, 30, 40)} | {"_v20": mean("volume", 20), "_tr": F.greatest(high_(), F.lag("close").over(by_week())) - F.least(low_(), F.lag("close").over(by_week()))})
    before = F.lag("ma30w", 4).over(by_week())
    return rows.withColumns({"ma30w_slope_4w": ratio(F.col("ma30w") - before, before), "high_52w": full(F.max("close").over(t(52)), t(52), 10, close_()), "low_52w": full(F.min("close").over(t(52)), t(52), 10, close_()), "atr10": mean("_tr", 10), "atr30": mean("_tr", 30), "volume_ratio": ratio(volume_(), F.col("_v20")), "weeks": F.row_number().over(by_week())}).drop("_tr", "_v20")


#: Fixed thresholds of the stage rules; a stage 2 goes on at a slope that would not begin one.
FLAT, ENTER, REMAIN, MIN_CONFIDENCE, MIN_WEEKS = 0.005, 0.005, 0.002, 0.40, 30
HIGH, LOW, BAND, NEAR_MA, APART, EXPANSION = 20.0, 30.0, 0.05, 0.03, 1.03, 1.1
TIE_ORDER = ("S2", "S4", "S3", "S1")


def classify(weeks: DataFrame) -> DataFrame:
    """Score four stages by the share of their checks that pass and take the best (ties S2, S4, S3, S1).

    Below the least confidence, or with too few weeks, the label is UNDEFINED. The
    slope that stage 2 asks for depends on whether the week before was stage 2;
    since the lower one passes wherever the higher does, a week is stage 2 when it
    began at or before it and every week since passed the lower one, which two
    running maxima tell: no week waits for the one before.
    """
    c, ma, ma10, slope = close_(), F.col("ma30w"), F.col("ma10w"), F.col("ma30w_slope_4w")
    from_high = F.coalesce(100 * ratio(F.col("high_52w") - c, F.col("high_52w")), F.lit(100.0))
    from_low = F.coalesce(100 * ratio(c - F.col("low_52w"), F.col("low_52w")), F.lit(100.0))
    clean = F.coalesce((ma10 > APART * ma) & (slope > ENTER), F.lit(False))
    stage2 = lambda least: [c > ma, slope > least, ma10 > ma, c > F.col("ma40w"), from_high <= 0.75 * HIGH]
    checks = {
        "S2": stage2(ENTER),
        "S2 on": stage2(REMAIN),
        "S4": [c < ma, slope < -ENTER, ma10 < ma, c < F.col("ma40w"), from_low <= 20],
        "S3": [from_high <= HIGH, F.abs(slope) <= FLAT, F.col("atr10") > EXPANSION * F.col("atr30"), ~clean],
        "S1": [F.abs(ratio(c, ma) - 1) < BAND, F.abs(slope) < FLAT, from_low <= LOW, F.col("volume_ratio") < 1, F.abs(ratio(ma10, ma) - 1) < NEAR_MA],
    }
    score = {k: sum((F.when(x, 1.0).otherwise(0.0) for x in v), F.lit(0.0)) / len(v) for k, v in checks.items()}

    def best(two: str) -> Column:
        of = lambda k: F.col("_s")[two if k == "S2" else k]
        top = F.greatest(*[of(k) for k in TIE_ORDER])
        label = F.lit("S1")
        for k in reversed(TIE_ORDER[:-1]):
            label = F.when(of(k) == top, k).otherwise(label)
        known = F.col("weeks") >= MIN_WEEKS
        return F.struct(F.when(known & (top >= MIN_CONFIDENCE), label).otherwise("UNDEFINED").alias("stage"), F.when(known, top).otherwise(0.0).alias("confidence"))

    rows = weeks.withColumn("_s", F.struct(*[v.alias(k) for k, v in score.items()])).withColumns({"_new": best("S2"), "_on": best("S2 on")})
    so_far = by_week().rowsBetween(Window.unboundedPreceding, 0)
    begun, broken = (F.max(F.when(x, F.col("weeks"))).over(so_far) for x in (F.col("_new.stage") == "S2", F.col("_on.stage") != "S2"))
    rows = rows.withColumn("_two", F.coalesce(begun > F.coalesce(broken, F.lit(0)), F.lit(False)))
    rows = rows.withColumn("_b", F.when(F.lag("_two").over(by_week()), F.col("_on")).otherwise(F.col("_new")))
    return rows.withColumns({"confidence": F.round("_b.confidence", 3), "stage": F.col("_b.stage")}).drop("_s", "_new", "_on", "_two", "_b")


def stage_age(rows: DataFrame) -> DataFrame:
    """Weeks in the current stage, since when, and the change that led to it."""
    before = F.lag("stage").over(by_week())
    change = F.when(before.eqNullSafe(F.col("stage")), 0).otherwise(1)
    run = rows.withColumns({"_run": F.sum(change).over(by_week().rowsBetween(Window.unboundedPreceding, 0)), "previous": before})
    island = Window.partitionBy("symbol_id", "_run").orderBy("week_end")
    return run.withColumns({"bars_in_stage": F.row_number().over(island), "entry_date": F.first("week_end").over(island), "transition": F.concat_ws("->", F.first("previous").over(island), F.col("stage"))}).drop("_run", "previous")


def support_resistance(weeks: DataFrame) -> DataFrame:
    spec = by_week().rowsBetween(-11, -2)
    return weeks.withColumns({"support_level": F.min("low").over(spec), "resistance_level": F.max("high").over(spec)})


def market_stage(latest: DataFrame) -> DataFrame:
    """Share of symbols in each stage and the stage of the market."""
    share = lambda s: F.avg((F.col("stage") == s).cast("double")).alias(f"{s.lower()}_share")
    out = latest.agg(*[share(s) for s in ("S1", "S2", "S3", "S4")])
    return out.withColumn("market_stage", F.when(F.col("s4_share") >= 0.4, "S4").when(F.col("s2_share") >= 0.4, "S2").when(F.col("s3_share") >= 0.3, "S3").otherwise("MIXED"))


def sector_health(latest: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("stage") == s)
    out = latest.groupBy("sector").agg(F.count("*").alias("n"), n("S2").alias("s2"), n("S4").alias("s4"), F.count_if(F.col("transition") == "S1->S2").alias("turned"))
    return out.withColumn("verdict", F.when(F.col("s2") >= 0.5 * F.col("n"), "healthy").when(F.col("s4") >= 0.5 * F.col("n"), "weak").when(F.col("turned") > 0, "turning").otherwise("mixed"))


#: Parameters of each market stage.
STRATEGY = (("S1", 0.3, 5), ("S2", 1.0, 10), ("S3", 0.5, 5), ("S4", 0.0, 0), ("MIXED", 0.4, 5))


def route(market: DataFrame) -> DataFrame:
    table = market.sparkSession.createDataFrame(STRATEGY, "market_stage string, exposure double, positions int")
    return market.join(F.broadcast(table), "market_stage", "left")


def observation_age(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Latest observation of each symbol and its age in sessions; the calendar is one row per session."""
    n = sessions.select("trade_date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("trade_date")))
    last = rows.groupBy("symbol_id").agg(F.max_by("stage", "week_end").alias("stage"), F.max("week_end").alias("week_end"))
    tail = n.agg(F.max("_n").alias("_end"))
    at = last.join(n, last["week_end"] >= n["trade_date"]).groupBy("symbol_id", "stage", "week_end").agg(F.max("_n").alias("_n"))
    return at.join(F.broadcast(tail)).select("symbol_id", "stage", "week_end", (F.col("_end") - F.col("_n")).alias("age"))


# --- breakouts ----------------------------------------------------------------------------------------------


def breakouts(bars: DataFrame) -> DataFrame:
    """Breakout flags against frames before each bar, contraction, volume figures and a conviction score of 0-100."""
    prior = lambda n: trailing(n, skip=1)
    rows = bars.withColumns({"_tr": F.greatest(high_(), F.lag("close").over(by_symbol())) - F.least(low_(), F.lag("close").over(by_symbol()))})
    rows = rows.withColumns(
        {
            "range_breakout": F.coalesce(full(close_() > F.max("high").over(prior(20)), prior(20), 20), F.lit(False)),
            "base_breakout": F.coalesce(full(close_() > F.max("high").over(prior(60)), prior(60), 60), F.lit(False)),
            "high_52w_breakout": F.coalesce(full(close_() > F.max("high").over(prior(252)), prior(252), 252), F.lit(False)),
            "contraction": ratio(F.avg(ratio(high_() - low_(), close_())).over(prior(5)), F.avg(ratio(high_() - low_(), close_())).over(prior(20))),
            "volume_ratio": ratio(volume_(), F.avg("volume").over(prior(20))),
            "vol_z20": full(deviation(volume_(), prior(20)), prior(20), 20),
            "_atr": F.avg("_tr").over(prior(14)),
            "_d20": F.avg("delivery_pct").over(prior(20)),
        }
    )
    points = [
        F.when(F.col("range_breakout"), 35.0).otherwise(0.0),
        F.when(F.col("volume_ratio") >= 1.5, 25.0).otherwise(0.0),
        F.when(F.col("delivery_pct") > F.col("_d20"), 20.0).otherwise(0.0),
        F.when(high_() - low_() >= 1.5 * F.col("_atr"), 10.0).otherwise(0.0),
        F.when(close_() >= low_() + 0.75 * (high_() - low_()), 10.0).otherwise(0.0),
    ]
    family = F.when(F.col("high_52w_breakout"), "high_52w").when(F.col("base_breakout"), "base").when(F.col("range_breakout"), "range")
    return rows.withColumns({"conviction": sum(points[1:], points[0]), "setup_family": family}).drop("_tr", "_atr", "_d20")


def tiers(rows: DataFrame) -> DataFrame:
    """Tier A-D of breakout rows from conviction and contraction, with the reasons for a low one."""
    why = reasons((F.coalesce("volume_ratio", F.lit(0.0)) < 1.5, "volume"), (F.coalesce("contraction", F.lit(9.0)) > 1, "no_contraction"), (F.col("conviction") < 60, "conviction"))
    tier = F.when((F.col("conviction") >= 80) & (F.col("contraction") <= 1), "A").when(F.col("conviction") >= 70, "B").when(F.col("conviction") >= 55, "C").otherwise("D")
    return rows.filter(F.col("setup_family").isNotNull()).withColumns({"tier": tier, "why": F.concat_ws(",", why)})


def volume_confirmations(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"ratio_ok": F.coalesce(F.col("volume_ratio") >= 1.5, F.lit(False)), "z20_ok": F.coalesce(F.col("vol_z20") >= 2, F.lit(False))})


def volume_shocks(rows: DataFrame, universe: DataFrame, z: float = 3.0, turnover: float = 1e5) -> DataFrame:
    hit = rows.filter((F.col("vol_z20") >= z) & (close_() * volume_() >= turnover)).join(universe.select("symbol_id").distinct(), "symbol_id", "left_semi")
    return hit.withColumn("intensity", F.when(F.col("vol_z20") >= 2 * z, "extreme").otherwise("high"))


def failed_breakouts(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """Symbols whose latest close is below the close of their first breakout."""
    first = rows.filter(F.col("setup_family").isNotNull()).groupBy("symbol_id").agg(F.min("trade_date").alias("first_day"), F.min_by("close", "trade_date").alias("trigger"))
    return first.join(latest.select("symbol_id", close_().alias("last_close")), "symbol_id").filter(F.col("last_close") < F.col("trigger"))


def daily_gainers(bars: DataFrame, percent: float) -> DataFrame:
    moved = bars.withColumn("gain", 100 * (ratio(close_(), F.lag("close").over(by_symbol())) - 1))
    n = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date")))
    return moved.withColumn("_n", n).filter((F.col("_n") == 1) & (F.col("gain") > percent)).select("symbol_id", "trade_date", "close", "gain")


def top_gainers(bars: DataFrame, lag: int, n: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date")))
    rows = bars.withColumns({"gain": F.round(100 * (ratio(close_(), F.lag("close", lag).over(by_symbol())) - 1), 6), "_n": k}).filter("_n = 1 and gain is not null")
    return rows.orderBy(F.desc("gain"), "symbol_id").limit(n).select("symbol_id", "gain")


def unusual_activity(rows: DataFrame, n: int) -> DataFrame:
    """Five-bar gain and delivery of at least 5 % and 40 %, with volume that stands out."""
    gained = rows.withColumn("gain", F.round(100 * (ratio(close_(), F.lag("close", 5).over(by_symbol())) - 1), 6))
    hit = gained.filter((F.col("gain") >= 5) & (F.col("delivery_pct") >= 40) & ((F.col("vol_z20") >= 1) | (F.col("volume_ratio") >= 1.25)))
    return hit.orderBy(F.desc("gain"), "symbol_id", "trade_date").limit(n).select("symbol_id", "trade_date", "gain")


def forward(bars: DataFrame, *horizons: int) -> DataFrame:
    """Returns over the next bars and the date on which each is known; null until then."""
    out = {}
    for n in horizons:
        out[f"fwd_{n}"] = ratio(F.lead("close", n).over(by_symbol()), close_()) - 1
        out[f"matured_{n}"] = F.lead("trade_date", n).over(by_symbol())
    return bars.withColumns(out)


def setup_statistics(rows: DataFrame) -> DataFrame:
    """Signals per month and family with hit rate and returns."""
    f5, f20 = F.col("fwd_5"), F.col("fwd_20")
    return rows.filter(F.col("setup_family").isNotNull()).groupBy("setup_family", F.trunc("trade_date", "MM").alias("month")).agg(F.count("*").alias("signals"), F.avg((f5 > 0).cast("double")).alias("hit_rate"), F.avg(f5).alias("mean_5"), F.percentile(f20, F.lit(0.5)).alias("median_20"))


def cross_events(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """Crossings of two moving averages, with their direction."""
    above = F.avg("close").over(trailing(fast)) > F.avg("close").over(trailing(slow))
    rows = bars.withColumn("_a", F.when(F.row_number().over(by_symbol()) >= slow, above)).withColumn("_b", F.lag("_a").over(by_symbol()))
    return rows.filter(F.col("_a") != F.col("_b")).select("symbol_id", "trade_date", "close", F.when(F.col("_a"), "up").otherwise("down").alias("direction"))


def high_volume_breaks(bars: DataFrame, n: int = 20, k: float = 1.5) -> DataFrame:
    prior = trailing(n, skip=1)
    rows = bars.withColumns({"_h": F.max("high").over(prior), "_v": F.avg("volume").over(prior), "_n": F.count(F.lit(1)).over(prior)})
    return rows.filter((F.col("_n") >= n) & (close_() > F.col("_h")) & (volume_() > k * F.col("_v"))).select("symbol_id", "trade_date", "close")


def average_touches(bars: DataFrame, n: int = 50, percent: float = 2.0) -> DataFrame:
    """Bars within some per cent of a rising average on more than mean volume."""
    rows = bars.withColumns({"_m": full(F.avg("close").over(trailing(n)), trailing(n), n), "_v": F.avg("volume").over(trailing(20))})
    rows = rows.withColumn("_p", F.lag("_m", 5).over(by_symbol()))
    return rows.filter((F.abs(ratio(close_(), F.col("_m")) - 1) <= percent / 100) & (F.col("_m") > F.col("_p")) & (volume_() > F.col("_v"))).select("symbol_id", "trade_date", "close")


# --- breadth ------------------------------------------------------------------------------------------------


def breadth(bars: DataFrame) -> DataFrame:
    """One row per date: shares above the 50- and 200-bar means and near the high, new highs and lows, advances and declines."""
    rows = bars.withColumns({"_s50": full(F.avg("close").over(trailing(50)), trailing(50), 50), "_s200": full(F.avg("close").over(trailing(200)), trailing(200), 200), "_hi": F.max("high").over(trailing(252)), "_lo": F.min("low").over(trailing(252)), "_p": F.lag("close").over(by_symbol())})
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("trade_date").agg(
        F.count("*").alias("n"),
        share(close_() > F.col("_s50")).alias("pct50"),
        share(close_() > F.col("_s200")).alias("pct200"),
        share(close_() >= 0.95 * F.col("_hi")).alias("pct_high"),
        F.count_if(high_() >= F.col("_hi")).alias("new_highs"),
        F.count_if(low_() <= F.col("_lo")).alias("new_lows"),
        F.count_if(close_() > F.col("_p")).alias("advances"),
        F.count_if(close_() < F.col("_p")).alias("declines"),
    )


def breadth_score(rows: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return rows.withColumn("score", 100 * (0.5 * F.coalesce("pct200", zero) + 0.3 * F.coalesce("pct_high", zero) + 0.2 * F.coalesce("pct50", zero)))


LABELS = ("risk_off", "neutral", "cautious_bull", "bull", "strong_bull")


def regime(rows: DataFrame) -> DataFrame:
    """The ladder of labels, without memory."""
    p200, p50, high = (F.coalesce(c, F.lit(0.0)) for c in ("pct200", "pct50", "pct_high"))
    return rows.withColumn("label", F.when((p200 < 0.30) & (high < 0.05), "risk_off").when(p200 < 0.55, "neutral").when((p200 >= 0.75) & (p50 >= 0.60) & (high >= 0.15), "strong_bull").when((p50 >= 0.55) & (high >= 0.12), "bull").otherwise("cautious_bull"))


def regime_with_hysteresis(rows: DataFrame, margin: float = 3.0) -> DataFrame:
    """Labels from score bands that must be left by a margin before they change.

    The fold runs over one row per date (a few thousand in all), so one group holds it.
    """
    bands = (0.0, 20.0, 40.0, 60.0, 80.0)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part, out, at = part.sort_values("trade_date"), [], None
        for score in part["score"].fillna(0.0):
            raw = sum(score >= b for b in bands) - 1
            if at is None or raw > at and score >= bands[raw] + margin or raw < at and score < bands[at] - margin:
                at = raw
            out.append(LABELS[at])
        return pd.DataFrame({"trade_date": part["trade_date"], "score": part["score"], "held_label": out})

    return rows.withColumn("_all", F.lit(1)).select("_all", "trade_date", "score").groupBy("_all").applyInPandas(lambda p: fold(p), "trade_date date, score double, held_label string")




def confirmed(rows: DataFrame, n: int = 3) -> DataFrame:
    """A label is confirmed when at least two of the last n days are at or above it."""
    spec = by_day().rowsBetween(-(n - 1), 0)
    rank = sum((F.when(F.col("label") == x, float(i)).otherwise(0.0) for i, x in enumerate(LABELS)), F.lit(0.0))
    rows = rows.withColumn("_r", rank)
    at_least = lambda k: F.sum((F.col("_r") >= k).cast("int")).over(spec) >= 2
    off = F.sum((F.col("label") == "risk_off").cast("int")).over(spec) >= 2
    return rows.withColumn("confirmed", F.when(at_least(4), "strong_bull").when(at_least(3), "bull").when(at_least(2), "cautious_bull").when(off, "risk_off").otherwise("neutral")).drop("_r")


def regime_age(rows: DataFrame) -> DataFrame:
    change = F.when(F.lag("label").over(by_day()).eqNullSafe(F.col("label")), 0).otherwise(1)
    run = rows.withColumn("_run", F.sum(change).over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("days_in_label", F.row_number().over(Window.partitionBy("_run").orderBy("trade_date"))).drop("_run")


def velocity(rows: DataFrame, n: int = 60) -> DataFrame:
    """Five-day change of the score and its place among the changes of the last n days, in fifths."""
    rows = rows.withColumn("velocity", F.col("score") - F.lag("score", 5).over(by_day()))
    spec = by_day().rowsBetween(-(n - 1), 0)
    edges = {q: F.percentile("velocity", F.lit(q / 5)).over(spec) for q in (1, 2, 3, 4)}
    v = F.round("velocity", 6)
    bucket = sum((F.when(v > F.round(e, 6), 1).otherwise(0) for e in edges.values()), F.lit(1))
    return rows.withColumn("bucket", F.when(F.col("velocity").isNotNull(), bucket))


def exposure(rows: DataFrame) -> DataFrame:
    """Exposure of a regime and a velocity bucket, from a fixed 5 x 5 matrix."""
    cells = [(label, b, round(0.1 + 0.2 * i + 0.025 * (b - 3), 3)) for i, label in enumerate(LABELS) for b in range(1, 6)]
    table = rows.sparkSession.createDataFrame(cells, "label string, bucket int, exposure double")
    return rows.join(F.broadcast(table), ["label", "bucket"], "left")


def members(bars: DataFrame, n: int = 20, lookback: int = 180) -> DataFrame:
    """Monthly top n by median traded value in the days strictly before the month's first session."""
    days = bars.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.min("trade_date").alias("rebalance"))
    # a bar can count towards the months of its look-back only, so it is given those, not compared with all
    reach = lookback // 28 + 2
    near = bars.select("symbol_id", "trade_date", (close_() * volume_()).alias("_v")).withColumn("month", F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: F.add_months(F.trunc("trade_date", "MM"), k))))
    held = near.join(days, "month").filter((F.col("trade_date") < F.col("rebalance")) & (F.datediff("rebalance", "trade_date") <= lookback))
    value = held.groupBy("rebalance", "symbol_id").agg(F.percentile("_v", F.lit(0.5)).alias("median_value"))
    k = F.row_number().over(Window.partitionBy("rebalance").orderBy(F.round("median_value", 6).desc(), "symbol_id"))
    return value.withColumn("rank", k).filter(F.col("rank") <= n)


def equal_weight_index(bars: DataFrame, base: float = 100.0) -> DataFrame:
    """Level of the mean return of all symbols with a bar before, over one row per date."""
    moved = bars.withColumn("_r", ratio(close_(), F.lag("close").over(by_symbol())) - 1)
    day = moved.groupBy("trade_date").agg(F.avg(clip(F.col("_r"), -0.5, 0.5)).alias("ret"), F.count("_r").alias("n"))
    return day.withColumn("level", base * F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(by_day())))


# --- sectors ------------------------------------------------------------------------------------------------


def sector_breadth(bars: DataFrame, master: DataFrame) -> DataFrame:
    rows = bars.join(master.select("symbol_id", "sector"), "symbol_id").withColumns({"_a": full(close_() > F.avg("close").over(trailing(50)), trailing(50), 30), "_b": full(close_() > F.avg("close").over(trailing(200)), trailing(200), 120)})
    return rows.groupBy("trade_date", "sector").agg((0.6 * F.avg(F.col("_a").cast("double")) + 0.4 * F.avg(F.col("_b").cast("double"))).alias("breadth"), F.count("*").alias("n"))


def against_benchmark(bars: DataFrame, bench: DataFrame) -> DataFrame:
    return bars.join(bench, "trade_date", "left").withColumn("rs", ratio(close_(), F.col("bench_close")) - 1)


def sector_returns(bars: DataFrame, master: DataFrame, n: int = 20) -> DataFrame:
    """Mean n-bar return of each sector and date with its percentile."""
    rows = bars.withColumn("_r", ratio(close_(), F.lag("close", n).over(by_symbol())) - 1).join(master.select("symbol_id", "sector"), "symbol_id")
    day = rows.groupBy("trade_date", "sector").agg(F.round(F.avg("_r"), 9).alias("sector_return"))
    return day.withColumn("sector_pct", pct_rank("sector_return", "trade_date"))


def rotation(day: DataFrame, n: int = 20) -> DataFrame:
    """Strength now and n dates ago, momentum, ranks and quadrant of each sector."""
    w = along("sector")
    rows = day.withColumns({"rs_before": F.lag("sector_pct", n).over(w)}).withColumn("momentum", F.col("sector_pct") - F.col("rs_before"))
    return rows.withColumns({"rs_rank": F.rank().over(Window.partitionBy("trade_date").orderBy(F.desc("sector_pct"))), "quadrant": quadrant(F.col("sector_pct"), F.coalesce("momentum", F.lit(0.0)), 0.5, 0.0)})


def quadrant(strength: Column, momentum: Column, a: float = 100.0, b: float = 100.0) -> Column:
    return F.when((strength >= a) & (momentum >= b), "Leading").when((strength >= a) & (momentum < b), "Weakening").when((strength < a) & (momentum < b), "Lagging").when((strength < a) & (momentum >= b), "Improving")


def top_per_sector(rows: DataFrame, value: str, n: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("sector").orderBy(F.round(value, 6).desc_nulls_last(), "symbol_id"))
    return rows.withColumn("place", k).filter(F.col("place") <= n)


def rrg(day: DataFrame) -> DataFrame:
    """Relative rotation of groups: ratio of the line to its 63-mean and of that to its 20-mean, with the quadrant.

    ``day`` has sector, trade_date and line.
    """
    w = lambda n: trailing(n, "sector")
    rows = day.withColumn("rs_ratio", full(100 * ratio(F.col("line"), F.avg("line").over(w(63))), w(63), 20))
    rows = rows.withColumn("rs_momentum", full(100 * ratio(F.col("rs_ratio"), F.avg("rs_ratio").over(w(20))), w(20), 5, F.col("rs_ratio")))
    return rows.withColumn("quadrant", quadrant(F.round("rs_ratio", 6), F.round("rs_momentum", 6)))


#: Fixed edges of the alpha buckets, in per cent.
ALPHA = ((-20, "deep_negative"), (-10, "negative"), (-2, "slightly_negative"), (2, "flat"), (10, "slightly_positive"), (20, "positive"))


def alpha_bucket(alpha: Column) -> Column:
    out = F.when(alpha < ALPHA[0][0], ALPHA[0][1])
    for edge, name in ALPHA[1:]:
        out = out.when(alpha < edge, name)
    return out.when(alpha.isNotNull(), "deep_positive")


def group_index(bars: DataFrame, master: DataFrame, base: float = 100.0) -> DataFrame:
    """Cap-weighted level of each sector on a base, over forward-filled closes of its members' sessions."""
    rows = bars.join(master.select("symbol_id", "sector", "market_cap"), "symbol_id")
    day = rows.groupBy("sector", "trade_date").agg((F.sum(close_() * F.col("market_cap")) / F.nullif(F.sum("market_cap"), F.lit(0.0))).alias("_v"))
    first = F.first("_v").over(along("sector").rowsBetween(Window.unboundedPreceding, 0))
    return day.select("sector", "trade_date", (base * ratio(F.col("_v"), first)).alias("line"))


def accumulation(bars: DataFrame) -> DataFrame:
    """Delivery and volume z-scores over 20 bars (sample deviation), a score by date and a label."""
    z = lambda c: ratio(F.col(c) - F.avg(c).over(trailing(20)), F.stddev_samp(c).over(trailing(20)))
    rows = bars.withColumns({"delivery_z": F.round(z("delivery_pct"), 6), "volume_z": F.round(z("volume"), 6)})
    rows = rows.withColumn("score", 60 * F.coalesce(pct_rank("delivery_z", "trade_date"), F.lit(0.5)) + 40 * F.coalesce(pct_rank("volume_z", "trade_date"), F.lit(0.5)))
    up = close_() >= F.lag("close").over(by_symbol())
    return rows.withColumn("_up", up).withColumn("label", F.when((F.col("score") >= 70) & F.col("_up"), "ACCUMULATION").when((F.col("score") >= 70) & ~F.col("_up"), "DISTRIBUTION").otherwise("NEUTRAL")).drop("_up")
