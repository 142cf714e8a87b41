"""Scans of the universe for chart shapes: structure and context at a date, lanes, scores, and the life of a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.shared import kept, numbered
from barloom.functions.stats import along, clip, full, pct_rank, ratio, reasons, trailing
from barloom.operators import shapes as sh

#: Families by rank of their tier; a broken top only suppresses.
FIRST_TIER = ("cup_handle", "flat_base", "vcp", "stage2_reclaim", "3wt", "ascending_triangle", "darvas_box", "pocket_pivot", "ascending_base", "ipo_base", "inside_week_breakout")
SUPPRESSING = ("head_shoulders",)
#: Bars after which a watched and a confirmed signal expire, and for which an invalidated one stays.
WATCHED, CONFIRMED, INVALIDATED = 10, 20, 5


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def steps(value: Column, *pairs: tuple[float, float]) -> Column:
    """The points of the first limit that a value reaches, else 0."""
    out = F.lit(0.0)
    for limit, points in reversed(pairs):
        out = F.when(value >= limit, float(points)).otherwise(out)
    return out


# --- structure -----------------------------------------------------------------------------------------------


def stage2_structure(bars: DataFrame) -> DataFrame:
    """Averages, their slopes and gaps, crosses, a score of nine conditions and a gate of five, with what fails.

    Bars may have near_52w_high_pct, rel_strength_score and volume_ratio_20; where
    one is missing or null it counts as far away, 0 and 1. Averages of 150 and 200
    bars exist from 100 bars on, but the gate asks for full ones.
    """
    w = along()
    has = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in bars.columns else F.lit(other)
    mean = lambda n, least: full(F.avg("close").over(trailing(n)), trailing(n), least, F.col("close"))
    ready = lambda n: F.count("close").over(trailing(n)) >= n
    rows = bars.withColumns({"sma_20": mean(20, 20), "sma_50": mean(50, 50), "sma_150": mean(150, 100), "sma_200": mean(200, 100), "_r150": ready(150), "_r200": ready(200)})
    slope = lambda c: 100 * (ratio(F.col(c), F.lag(c, 20).over(w)) - 1)
    rows = rows.withColumns({f"sma{n}_slope_20d_pct": slope(f"sma_{n}") for n in (50, 150, 200)} | {"sma50_sma200_gap_pct": 100 * (ratio(F.col("sma_50"), F.col("sma_200")) - 1), "sma20_sma50_gap_pct": 100 * (ratio(F.col("sma_20"), F.col("sma_50")) - 1)})
    gap = F.col("sma50_sma200_gap_pct")
    deltas = {f"sma50_sma200_gap_delta_{n}d": gap - F.lag(gap, n).over(w) for n in (5, 20, 60)} | {"sma20_sma50_gap_delta_10d": F.col("sma20_sma50_gap_pct") - F.lag("sma20_sma50_gap_pct", 10).over(w)}
    rows = rows.withColumns(deltas | {"_up": _is((gap >= 0) & (F.lag(gap).over(w) < 0)), "_down": _is((gap < 0) & (F.lag(gap).over(w) >= 0)), "_n": F.row_number().over(w)})
    last_up = F.last(F.when(F.col("_up"), F.col("_n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("golden_cross_days_since", F.when(gap >= 0, F.col("_n") - last_up))
    rows = rows.withColumn("golden_cross_failed", _is(F.col("_down") & (F.lag("golden_cross_days_since").over(w) <= 20)))
    out = judged(rows, has("near_52w_high_pct", 999.0), has("rel_strength_score", 0.0), has("volume_ratio_20", 1.0))
    return out.withColumns({"stage2_hard_fail_reason": F.array_join("_hard", ","), "stage2_fail_reason": F.array_join(F.concat("_hard", "_soft"), ",")}).drop("_r150", "_r200", "_up", "_down", "_n", "_hard", "_soft")


def judged(rows: DataFrame, far: Column, strength: Column, volume: Column) -> DataFrame:
    """The score, the gate and the label of rows that have averages, their slopes and whether these are full (_r150, _r200)."""
    c = F.col("close")
    points = [(c > F.col("sma_150"), 15), (c > F.col("sma_200"), 15), (F.col("sma_150") > F.col("sma_200"), 15), (F.col("sma200_slope_20d_pct") > 0, 15), (far <= 25, 10), (far <= 15, 10), (strength >= 70, 10), (strength >= 85, 10), (volume > 1.2, 10)]
    score = sum((F.when(_is(k), float(p)).otherwise(0.0) for k, p in points), F.lit(0.0))
    gate = {
        "below_sma150": _is(F.col("_r150") & (c > F.col("sma_150"))),
        "below_sma200": _is(F.col("_r200") & (c > F.col("sma_200"))),
        "sma150_below_sma200": _is(F.col("_r150") & F.col("_r200") & (F.col("sma_150") > F.col("sma_200"))),
        "sma200_slope_negative": _is(F.col("_r200") & (F.col("sma200_slope_20d_pct") > 0)),
        "far_from_52w_high": far <= 25,
    }
    hard = reasons(*[(~held, name) for name, held in gate.items()])
    soft = reasons((strength < 70, "rs_below_70th_pctile"), ((strength >= 70) & (strength < 85), "rs_below_85th_pctile"), (volume <= 1.2, "weak_volume"), (far > 15, "not_near_breakout_zone"))
    out = rows.withColumns({"stage2_score": clip(score, 0, 100), "_hard": hard, "_soft": soft}).withColumn("is_stage2_structural", F.size("_hard") == 0)
    label = F.when(F.col("is_stage2_structural") & (F.col("stage2_score") >= 85), "strong_stage2").when(F.col("is_stage2_structural") & (F.col("stage2_score") >= 70), "stage2").when(~F.col("is_stage2_structural") & (F.col("stage2_score") >= 50), "stage1_to_stage2")
    return out.withColumn("stage2_label", label.otherwise("non_stage2"))


#: Fixed limits of the gates (standard, early), of the structure of a base and of the age of a weekly stage.
STANDARD = {"bars": 50, "close": 20.0, "percentile": 0.20}
EARLY = {"bars": (35, 49), "missing": 0.20, "turnover": 5_000_000.0, "volume": 50_000.0, "close": 20.0, "sessions": 20, "continuity": 0.80, "valid": 1.0}
BASE = {"band": 0.15, "slope": 2.0, "bars": 65, "depth": 0.35, "window": 20, "range": 0.90, "pivot": 0.10, "volume": 0.90, "long": 0.85, "long_slope": -1.0}
WEEKLY_AGE, MATURE, STAGE2 = 10, 200, 70.0


def context(bars: DataFrame, as_of: str, stages: DataFrame | None = None, excluded: DataFrame | None = None, standard: dict = STANDARD, early: dict = EARLY) -> DataFrame:
    """One row per symbol with what was known of it at a date: history, continuity, gates, structure and weekly stage.

    Nothing after ``as_of`` is read. Continuity is the share of the market's
    sessions since the symbol's first bar on which it has one: sessions are
    numbered once, one row each, and a symbol's first session is looked up, so no
    calendar is multiplied by symbols. Weekly stages have symbol_id, week_end,
    stage and transition; their age is in sessions. Excluded symbols have
    symbol_id, effective_from and effective_to (null: still). Bars with a null or
    impossible price count as invalid; no bars at or before the date, no rows.
    """
    day = F.lit(as_of).cast("date")
    past = bars.filter(F.col("trade_date") <= day)
    # one row: the sessions of the market, a few thousand dates
    calendar = past.agg(F.array_sort(F.collect_set("trade_date")).alias("_sessions"))
    c, w = F.col("close"), along()
    before = F.lag("trade_date").over(w)
    rows = past.withColumns({"_back": F.count("*").over(Window.partitionBy("symbol_id")) - F.row_number().over(w) + 1, "_new": before.isNull() | (before != F.col("trade_date"))})
    at = lambda k, value: F.max(F.when(F.col("_back") == k, value))
    among = lambda value, first, last: F.percentile(F.when(F.col("_back").between(first, last), value), F.lit(0.5))
    prices = [F.col(p) for p in ("open", "high", "low", "close")]
    valid = F.least(*prices) > 0
    for p in prices:
        valid = valid & p.isNotNull()
    valid = _is(valid & (F.col("volume") >= 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high")))
    width, now = F.col("high") - F.col("low"), BASE["window"]
    # averages at the last bar and 20 bars before it are those of the bars that lie so far back: no frame slides over all bars
    span = lambda n, skip=0: F.col("_back").between(1 + skip, n + skip)
    mean = lambda n, least, skip=0: F.when(F.count(F.when(span(n, skip), c)) >= least, F.avg(F.when(span(n, skip), c)))
    slope = lambda n, least: 100 * (ratio(mean(n, least), mean(n, least, 20)) - 1)
    bars_in = lambda n, skip=0: F.count_if(span(n, skip))
    moved = lambda h: F.coalesce(F.when(at(h + 1, c) > 0, at(1, c) / at(h + 1, c) - 1), F.lit(0.0))
    known = rows.groupBy("symbol_id").agg(
        F.count("*").alias("bar_count"),
        F.count_if("_new").alias("_observed"),
        F.min("trade_date").alias("_first"),
        F.max("trade_date").alias("_last"),
        at(1, c).alias("close"),
        F.avg(valid.cast("double")).alias("ohlcv_valid_ratio"),
        among(c * F.col("volume"), 1, early["sessions"]).alias("median_turnover"),
        among(F.col("volume"), 1, early["sessions"]).alias("median_volume"),
        F.max(F.when(F.col("_back") <= BASE["bars"], F.col("high"))).alias("_high"),
        F.min(F.when(F.col("_back") <= BASE["bars"], F.col("low"))).alias("_low"),
        ratio(among(width, 1, now), among(width, now + 1, 2 * now)).alias("range_contraction_ratio"),
        ratio(among(F.col("volume"), 1, now), among(F.col("volume"), now + 1, 2 * now)).alias("volume_dry_up_ratio"),
        (at(1, c) / at(21, c) - 1).alias("_short"),
        (at(1, c) / at(61, c) - 1).alias("_long"),
        *[mean(n, least).alias(f"sma_{n}") for n, least in ((50, 50), (150, 100), (200, 100))],
        *[slope(n, 100).alias(f"sma{n}_slope_20d_pct") for n in (150, 200)],
        *[(F.count(F.when(span(n), c)) >= n).alias(f"_r{n}") for n in (150, 200)],
        clip(100 * (1 - ratio(at(1, c), F.when(bars_in(252) >= 20, F.max(F.when(span(252), F.col("high")))))), 0, 100).alias("near_52w_high_pct"),
        ratio(at(1, F.col("volume")), F.when(bars_in(20, 1) >= 10, F.avg(F.when(span(20, 1), F.col("volume"))))).alias("_volume"),
        *[moved(h).alias(f"_ret{h}") for h in (20, 60, 120)],
        at(1, c * F.col("volume")).alias("_turnover"),
    )
    # one row a symbol, written once; ranks over them, at one date
    known = kept(known).withColumns({"rel_strength_score": 20 * pct_rank("_ret20", F.lit(1)) + 50 * pct_rank("_ret60", F.lit(1)) + 30 * pct_rank("_ret120", F.lit(1)), "liquidity_percentile": pct_rank("_turnover", F.lit(1))})
    known = judged(known, F.coalesce("near_52w_high_pct", F.lit(999.0)), F.coalesce("rel_strength_score", F.lit(0.0)), F.coalesce("_volume", F.lit(1.0))).drop("_r150", "_r200", "_volume", "_ret20", "_ret60", "_ret120", "_turnover", "_hard", "_soft")
    known = known.crossJoin(F.broadcast(calendar))  # one row
    after = lambda d, strict: F.size(F.filter("_sessions", lambda s: (s > d) if strict else (s >= d)))
    known = known.withColumn("continuity_ratio", F.col("_observed") / after(F.col("_first"), False)).withColumns({"base_depth_pct": 100 * ratio(F.col("_high") - F.col("_low"), F.col("_high")), "pivot_distance_pct": 100 * F.greatest(F.lit(0.0), F.col("_high") - F.col("close")) / F.nullif(F.col("_high"), F.lit(0.0)), "rs_trend_delta_pct": 100 * (F.col("_short") - F.col("_long"))})
    if excluded is not None:
        out = excluded.filter((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day))).select("symbol_id").distinct()
        known = known.join(out.withColumn("_bad", F.lit(True)), "symbol_id", "left").withColumn("_bad", _is(F.col("_bad")))
    else:
        known = known.withColumn("_bad", F.lit(False))
    if stages is not None:
        weekly = stages.filter(F.col("week_end") <= day).groupBy("symbol_id").agg(F.max(F.struct("week_end", "stage", "transition")).alias("_w"))
        known = known.join(weekly, "symbol_id", "left")
    else:
        known = known.withColumn("_w", F.lit(None).cast("struct<week_end: date, stage: string, transition: string>"))
    known = known.withColumns({"weekly_stage": F.col("_w.stage"), "weekly_stage_transition": F.coalesce(F.col("_w.transition"), F.lit("NONE")), "weekly_stage_age": F.when(F.col("_w").isNotNull(), after(F.col("_w.week_end"), True))})
    pct, price = F.coalesce(F.col("liquidity_percentile"), F.lit(0.0)), F.col("close")
    standard_pass = (F.col("bar_count") >= standard["bars"]) & (price >= standard["close"]) & (pct >= standard["percentile"]) & ~F.col("_bad")
    checks = {
        "bar_band": F.col("bar_count").between(*early["bars"]),
        "missing_sessions": 1 - F.col("continuity_ratio") <= early["missing"],
        "median_turnover": F.col("median_turnover") >= early["turnover"],
        "median_volume": F.col("median_volume") >= early["volume"],
        "minimum_close": price >= early["close"],
        "estimation_sessions": F.col("bar_count") >= early["sessions"],
        "continuity": F.col("continuity_ratio") >= early["continuity"],
        "ohlcv_quality": F.col("ohlcv_valid_ratio") >= early["valid"],
        "latest_session": F.col("_last") == F.element_at("_sessions", -1),
        "no_exclusion": ~F.col("_bad"),
    }
    failed = reasons(*[(~_is(ok), name) for name, ok in checks.items()])
    long_ = F.col("close") / F.col("sma_200")
    base = {
        "sma150_band": F.abs(price / F.col("sma_150") - 1) <= BASE["band"],
        "sma150_flat": F.abs("sma150_slope_20d_pct") <= BASE["slope"],
        "base_depth": F.col("base_depth_pct") <= 100 * BASE["depth"],
        "range_contraction": F.col("range_contraction_ratio") <= BASE["range"],
        "pivot_proximity": F.col("pivot_distance_pct") <= 100 * BASE["pivot"],
        "rs_trend": F.col("rs_trend_delta_pct") >= 0,
        "volume_dry_up": F.col("volume_dry_up_ratio") <= BASE["volume"],
        "long_term_not_deteriorating": (long_ >= BASE["long"]) & (F.col("sma200_slope_20d_pct") >= BASE["long_slope"]),
    }
    lacking = reasons(*[(~_is(ok), name) for name, ok in base.items()])
    out = known.withColumns({"as_of_date": day, "standard_gate": _is(standard_pass), "early_failed": failed, "early_gate": F.size(failed) == 0, "base_failed": lacking, "base_structure": F.size(lacking) == 0, "weekly_fresh": _is(F.col("weekly_stage_age") <= WEEKLY_AGE)})
    out = out.withColumns({"liquidity_gate": F.when(F.col("bar_count") < standard["bars"], F.col("early_gate")).otherwise(F.col("standard_gate")), "stage2_valid": _is((F.col("bar_count") >= MATURE) & F.col("is_stage2_structural") & F.col("sma_150").isNotNull() & F.col("sma200_slope_20d_pct").isNotNull())})
    return out.drop("_observed", "_first", "_last", "_high", "_low", "_short", "_long", "_sessions", "_bad", "_w")


def lanes(rows: DataFrame) -> DataFrame:
    """Exactly one lane for each row of ``context``, with its band of history and the reasons."""
    n, standard = F.col("bar_count"), F.col("standard_gate")
    stage2 = F.col("stage2_valid") & (F.col("stage2_score") >= STAGE2)
    first, turning = _is(F.col("weekly_stage") == "S1"), _is(F.col("weekly_stage_transition") == "S1_TO_S2")
    stage1 = F.col("weekly_fresh") & (first | turning) & F.col("base_structure")
    ladder = [
        (n < 35, "no_lane", ["INSUFFICIENT_HISTORY"]),
        ((n < 50) & F.col("early_gate"), "ipo_early_base", ["AGE_35_49_EARLY_IPO_LIQUIDITY_PASS"]),
        (n < 50, "no_lane", ["EARLY_IPO_LIQUIDITY_FAIL"]),
        (~standard, "no_lane", ["STANDARD_LIQUIDITY_FAIL"]),
        (n < 180, "young_listing_base", ["AGE_50_179_STANDARD_LIQUIDITY_PASS"]),
        (stage2, "stage2_continuation", ["MATURE_STAGE2_INPUTS_VALID", "STAGE2_SCORE_THRESHOLD_PASS"]),
        (stage1 & first, "stage1_base", ["FRESH_WEEKLY_STAGE1", "STAGE1_STRUCTURE_PASS"]),
        (stage1, "stage1_base", ["FRESH_WEEKLY_STAGE1_TRANSITION", "STAGE1_STRUCTURE_PASS"]),
        (F.lit(True), "no_lane", ["MATURE_STRUCTURE_NOT_ELIGIBLE"]),
    ]
    lane, why = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for condition, name, codes in reversed(ladder):
        lane, why = F.when(condition, name).otherwise(lane), F.when(condition, F.array(*map(F.lit, codes))).otherwise(why)
    band = F.when(n < 35, "under_35").when(n < 50, "35_49").when(n < 120, "50_119").when(n < 180, "120_179").otherwise("180_plus")
    return rows.withColumns({"lane": lane, "history_band": band, "lane_reasons": why})


# --- signals -------------------------------------------------------------------------------------------------


def scan(bars: DataFrame, *families: str, latest: bool = True, least_stage2: float | None = None) -> DataFrame:
    """Signals of all shapes, but for a symbol whose top is broken only that, as one bearish row.

    With ``least_stage2`` and a column stage2_score in the bars, symbols whose last
    score is lower are left out before any shape is searched.
    """
    rows = bars
    if least_stage2 is not None and "stage2_score" in bars.columns:
        last = bars.groupBy("symbol_id").agg(F.max_by("stage2_score", "trade_date").alias("_s")).filter(F.col("_s") >= least_stage2)
        rows = bars.join(last.select("symbol_id"), "symbol_id", "left_semi")
    return sh.shapes_or_top(rows, *families, latest=latest).withColumn("direction", F.when(F.col("family") == "head_shoulders", "bearish").otherwise("bullish"))


def signal_scores(signals: DataFrame) -> DataFrame:
    """Signals with tier, pattern and priority score, and both ranks over all of them.

    Signals have symbol_id, family, state, signal_date, quality, volume_ratio, dry
    and the measures of their shape; vol_z20, vol_z50, rel_strength_score,
    sector_rs_percentile and stage2_score count where they are there and known.
    Bearish signals of a broken top have score 0. Ranks follow the scores, then
    quality, then symbol; alike ones family and date.
    """
    known = lambda c: F.col(c) if c in signals.columns else F.lit(None).cast("double")
    family, confirmed = F.col("family"), F.col("state") == "confirmed"
    spike20, spike50 = _is(known("vol_z20") >= 2), _is(known("vol_z50") >= 2)
    loud = _is(known("volume_ratio") >= 1.5) & (spike20 | spike50)
    strong = loud & spike20
    stage2 = F.coalesce(known("stage2_score"), F.lit(0.0))
    rs, sector = known("rel_strength_score"), known("sector_rs_percentile")
    symmetry, similar, handle = known("symmetry"), known("similarity_pct"), known("handle_pct")
    back, pole, tight = known("retraced_pct"), known("pole_pct"), known("range_pct")
    of = lambda name, condition: (family == name) & _is(condition)
    tall = lambda rise, width: (pole >= rise) & (tight <= width)
    clear = of("cup_handle", handle <= 8) | of("round_bottom", symmetry.between(0.75, 1.35)) | of("double_bottom", similar <= 3) | of("flag", back <= 25) | of("high_tight_flag", tall(90, 15))
    score = F.when(confirmed, 40.0).otherwise(20.0) + F.when(strong, 20.0).when(loud, 18.0).otherwise(0.0) + steps(rs, (80, 15), (60, 8)) + steps(sector, (70, 10), (60, 5))
    score = score + F.when(_is(known("dry").cast("boolean")), 10.0).otherwise(0.0) + F.when(clear, 10.0).otherwise(0.0) + steps(stage2, (85, 15), (70, 10), (50, 5))
    tier = F.when(family.isin(*SUPPRESSING), "suppression_only").when(family.isin(*FIRST_TIER), "tier_1").otherwise("tier_2")
    clarity = (
        F.when(of("cup_handle", handle <= 8) | of("round_bottom", symmetry.between(0.85, 1.15)) | of("double_bottom", similar <= 3) | of("flag", back <= 25), 8.0)
        .when(of("high_tight_flag", tall(90, 15)), 10.0)
        .when(of("high_tight_flag", tall(75, 20)), 5.0)
        .when(of("round_bottom", symmetry.between(0.75, 1.35)) | of("double_bottom", similar <= 5) | of("flag", back <= 35), 4.0)
        .otherwise(0.0)
    )
    breakout = F.when(confirmed & strong, 10.0).when(confirmed & loud, 8.0).when(confirmed | loud, 4.0).otherwise(0.0)
    quality = F.coalesce(F.col("quality"), F.lit(0.0))
    bearish = family.isin(*SUPPRESSING)
    rows = signals.withColumn("tier", tier).withColumn("pattern_score", F.when(bearish, 0.0).otherwise(F.least(F.lit(100.0), score)))
    priority = 0.35 * F.col("pattern_score") + F.when(F.col("tier") == "tier_1", 22.0).otherwise(12.0) + steps(stage2, (85, 14), (70, 9), (50, 4)) + steps(rs, (80, 10), (60, 5)) + steps(sector, (70, 6), (60, 3)) + breakout + clip(0.12 * quality, 0, 12) + clarity
    rows = rows.withColumn("priority_score", F.when(bearish, 0.0).otherwise(F.least(F.lit(100.0), priority)))
    # scores are rounded for their order alone, so that equal ones tie whatever the order of additions
    place = lambda *scores: [*[F.round(s, 9).desc_nulls_last() for s in scores], F.round("quality", 9).desc_nulls_last(), F.col("symbol_id"), F.col("family"), F.col("state"), F.col("signal_date")]
    ranked = numbered(rows, "pattern_rank", *place("pattern_score"))
    return numbered(ranked, "priority_rank", *place("priority_score", "pattern_score"))


# --- the life of a signal ------------------------------------------------------------------------------------


def _weekdays_before(day: Column) -> Column:
    """Monday to Friday days before a date, counted from a Monday."""
    n = F.date_diff(day, F.lit("1969-12-29").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_bars(start: Column, end: Column) -> Column:
    """Weekdays from a date to a later one, both counted, less one; 0 if it is not later, many if one is unknown."""
    n = _weekdays_before(F.date_add(end, 1)) - _weekdays_before(start) - 1
    return F.coalesce(F.when(end <= start, F.lit(0)).otherwise(F.greatest(F.lit(0), n)), F.lit(10_000)).cast("int")


LIFE = ["symbol_id", "family", "state", "signal_date", "level", "invalidation", "pattern_score", "lifecycle", "as_of_date", "first_seen_date", "last_seen_date", "invalidated_date", "expired_date", "carried_bars"]


def snapshot(fresh: DataFrame, previous: DataFrame, closes: DataFrame, as_of: str) -> DataFrame:
    """One row per symbol and family: the day's signals merged into the snapshot before it.

    Fresh signals have symbol_id, family, state, signal_date, level, invalidation
    and pattern_score; the best by score, then date, replaces what was known. Other
    rows of the previous snapshot are carried: invalidated when the close (symbol_id,
    close) is at or below the invalidation price, expired when not seen for WATCHED
    or CONFIRMED bars, or INVALIDATED bars after invalidation; expired ones go.
    """
    day = F.lit(as_of).cast("date")
    key = Window.partitionBy("symbol_id", "family")
    best = F.row_number().over(key.orderBy(F.round("pattern_score", 9).desc_nulls_last(), F.desc("signal_date"), "state"))
    now = fresh.withColumn("_n", best).filter("_n = 1").select("symbol_id", "family", F.struct("state", "signal_date", "level", "invalidation", "pattern_score").alias("f"))
    then = previous.select("symbol_id", "family", F.struct(*[c for c in LIFE if c not in ("symbol_id", "family")]).alias("p"))
    both = now.join(then, ["symbol_id", "family"], "full_outer").join(closes.groupBy("symbol_id").agg(F.max("close").alias("_close")), "symbol_id", "left")
    was, new = F.lower(F.coalesce("p.lifecycle", "p.state")), F.col("f").isNotNull()
    seen = F.coalesce("p.last_seen_date", "p.as_of_date", "p.signal_date")
    broken = was.isin("watchlist", "confirmed") & _is(F.col("_close") <= F.col("p.invalidation"))
    old = F.when(was == "watchlist", business_bars(seen, day) >= WATCHED).when(was == "confirmed", business_bars(seen, day) >= CONFIRMED).when(was == "invalidated", business_bars(F.coalesce("p.invalidated_date", "p.as_of_date"), day) >= INVALIDATED)
    life = F.when(new, F.lower("f.state")).when(was == "expired", F.lit(None)).when(broken, "invalidated").when(_is(old), "expired").when(was.isin("watchlist", "confirmed", "invalidated"), was)
    pick = lambda c: F.when(new, F.col(f"f.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
    rows = both.withColumn("lifecycle", life).filter("lifecycle is not null")
    first = F.when(new, F.coalesce("p.first_seen_date", "f.signal_date")).otherwise(F.col("p.first_seen_date"))
    invalid = F.when(new, F.lit(None)).when(broken, F.coalesce("p.invalidated_date", day)).otherwise(F.col("p.invalidated_date"))
    expired = F.when(~new & (F.col("lifecycle") == "expired"), day)
    carried = F.when(new, 0).otherwise(F.coalesce("p.carried_bars", F.lit(0)) + 1)
    return rows.select("symbol_id", "family", *[pick(c) for c in ("state", "signal_date", "level", "invalidation", "pattern_score")], "lifecycle", day.alias("as_of_date"), first.alias("first_seen_date"), F.when(new, day).otherwise(seen).alias("last_seen_date"), invalid.alias("invalidated_date"), expired.alias("expired_date"), carried.cast("int").alias("carried_bars"))


def advance(history: DataFrame, fresh: DataFrame, closes: DataFrame, as_of: str) -> DataFrame:
    """All snapshots with that of a day written anew from the last one before it, so that a day can be run again.

    Snapshots after the day go, since they were built on what is replaced.
    """
    day = F.lit(as_of).cast("date")
    before = history.filter(F.col("as_of_date") < day)
    last = before.agg(F.max("as_of_date").alias("as_of_date"))  # one row
    return before.select(*LIFE).unionByName(snapshot(fresh, before.join(F.broadcast(last), "as_of_date", "left_semi"), closes, as_of))
