"""Pattern signals with their confirmation, and cohorts of signals: calibration, controls, freshness, baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import along, clip, full, nearest, ratio, trailing
from barloom.operators.indicators import volume_zscore

#: Fixed limits of a confirming volume and of the wait for a breakout.
LEAST_RATIO, LEAST_Z, WAIT, RECENT, BUFFER = 1.5, 2.0, 15, 5, 0.03


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def ahead(bars: DataFrame) -> DataFrame:
    """Bars with their volume ratio, whether that is confirmed, the WAIT bars after them and how many bars are left."""
    w = along()
    rows = volume_zscore(bars).withColumn("volume_ratio", ratio(F.col("volume"), F.avg("volume").over(trailing(20, skip=1))))
    loud = (F.col("volume_ratio") >= LEAST_RATIO) & (_is(nearest(F.col("vol_z20")) >= LEAST_Z) | _is(nearest(F.col("vol_z50")) >= LEAST_Z))
    rows = rows.withColumn("loud", _is(loud))
    back = Window.partitionBy("symbol_id").orderBy(F.desc("trade_date"))
    return rows.withColumns({"_next": F.collect_list(F.struct("trade_date", "close", "loud")).over(w.rowsBetween(1, WAIT)), "_left": F.row_number().over(back) - 1, "_last": F.first("close").over(back)})


def resolve(rows: DataFrame, pivot: str) -> DataFrame:
    """Confirmed signals, with the first loud close above the pivot, and those of the last bars that are still near it."""
    hit = F.get(F.filter("_next", lambda x: x["loud"] & (x["close"] > F.col(pivot))), F.lit(0))
    rows = rows.withColumns({"signal_date": hit["trade_date"], "signal_close": hit["close"]})
    near = (F.col("_left") <= RECENT) & F.col("_last").between((1 - BUFFER) * F.col(pivot), F.col(pivot))
    state = F.when(F.col("signal_date").isNotNull(), "confirmed").when(near, "watchlist")
    return rows.withColumn("state", state).filter("state is not null").drop("_next", "_left", "_last")


def contractions(bars: DataFrame, window: int = 40, price: float = 0.85, volume: float = 0.90, least: float = 0.08) -> DataFrame:
    """Three thirds of a window, each with a narrower range of closes and less volume than the one before, and what became of it."""
    third, w = window // 3, along()
    rows = ahead(bars)
    for i in range(3):
        spec = w.rowsBetween(-window + third * i, -window + third * (i + 1) - 1)
        low = F.min("close").over(spec)
        rows = rows.withColumns({f"_r{i}": full(ratio(F.max("close").over(spec) - low, low), spec, third), f"_v{i}": full(F.avg("volume_ratio").over(spec), spec, third, F.col("volume_ratio"))})
    whole = w.rowsBetween(-window, 0)
    rows = rows.withColumns({"ceiling": F.max("high").over(whole), "invalidation": F.min("low").over(whole)})
    found = (F.col("_r0") >= least) & (F.col("_r1") < price * F.col("_r0")) & (F.col("_r2") < price * F.col("_r1")) & (F.col("_v1") < volume * F.col("_v0")) & (F.col("_v2") < volume * F.col("_v1"))
    quality = clip(55 + F.least(80 * (F.col("_r0") - F.col("_r1")), F.lit(15.0)) + F.least(60 * (1 - ratio(F.col("_v0"), F.col("_v1"))), F.lit(10.0)), 0, 100)
    out = resolve(rows.filter(found).withColumn("quality", quality), "ceiling")
    return out.withColumn("quality", F.when(F.col("state") == "watchlist", F.col("quality") - 10).otherwise(F.col("quality"))).select("symbol_id", "trade_date", "ceiling", "invalidation", "quality", "state", "signal_date")


def reclaims(bars: DataFrame, n: int = 150, lookback: int = 20, extension: float = 0.08, slope: float = 0.0) -> DataFrame:
    """Closes that cross a rising long average from below on confirmed volume and stay near it."""
    w, spec = along(), trailing(n)
    rows = ahead(bars).withColumn("level", full(F.avg("close").over(spec), spec, n))
    rows = rows.withColumns({"slope": 100 * (ratio(F.col("level"), F.lag("level", lookback).over(w)) - 1), "_pc": F.lag("close").over(w), "_pl": F.lag("level").over(w), "_x": ratio(F.col("close"), F.col("level")) - 1})
    found = (F.col("_pc") <= F.col("_pl")) & (F.col("close") > F.col("level")) & (F.col("slope") >= slope) & F.col("_x").between(0, extension) & F.col("loud")
    bonus = F.least(F.lit(12.0), 2 * F.greatest(F.lit(0.0), F.col("slope"))) + F.least(F.lit(12.0), 8 * F.greatest(F.lit(0.0), F.col("volume_ratio") - LEAST_RATIO)) + F.greatest(F.lit(0.0), 12 - 100 * F.col("_x"))
    return rows.filter(found).select("symbol_id", "trade_date", "close", "level", "slope", (0.97 * F.col("level")).alias("invalidation"), clip(52 + bonus, 0, 100).alias("quality"))


def tight_closes(bars: DataFrame, tight: float = 0.015, advance: float = 0.20, step: int = 5, prior: int = 20) -> DataFrame:
    """Three closes a week (``step`` bars) apart within some per cent after an advance, and what became of it."""
    w, base = along(), 3 * step
    rows = ahead(bars)
    closes = [F.col("close"), F.lag("close", step).over(w), F.lag("close", 2 * step).over(w)]
    top, n = F.greatest(*closes), F.row_number().over(w)
    start = F.coalesce(F.lag("close", base + prior).over(w), F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own, earlier = w.rowsBetween(-base, 0), w.rowsBetween(-base - prior, -base - 1)
    rows = rows.withColumns({"_n": n, "_count": F.col("_left") + n, "tightness": ratio(top - F.least(*closes), top), "advance": ratio(F.lag("close", base).over(w) - start, start), "ceiling": F.max("high").over(own), "invalidation": 0.97 * closes[2], "dry": _is(F.avg("volume_ratio").over(own) < F.avg("volume_ratio").over(earlier))})
    found = (F.col("_n") > base) & (F.col("_count") >= base + prior) & (F.col("tightness") <= tight) & (F.col("advance") >= advance)
    quality = clip(52 + F.least(2000 * (tight - F.col("tightness")), F.lit(15.0)) + F.least(50 * (F.col("advance") - advance), F.lit(10.0)) + F.when(F.col("dry"), 8.0).otherwise(0.0), 0, 100)
    out = resolve(rows.filter(found).withColumn("quality", quality), "ceiling")
    return out.withColumn("quality", F.when(F.col("state") == "watchlist", F.col("quality") - 10).otherwise(F.col("quality"))).select("symbol_id", "trade_date", "ceiling", "invalidation", "dry", "quality", "state", "signal_date")


def inside_weeks(bars: DataFrame) -> DataFrame:
    """Weeks to Friday within the range of the week of bars before, and the first loud close above their high within WAIT bars."""
    week = F.next_day(F.date_sub("trade_date", 1), "Fri")
    weeks = ahead(bars).groupBy("symbol_id", week.alias("week_end")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by(F.struct("_next", "_left", "_last"), "trade_date").alias("_e"))
    w = along(order="week_end")
    rows = weeks.withColumns({"_h": F.lag("high").over(w), "_l": F.lag("low").over(w)}).filter((F.col("high") < F.col("_h")) & (F.col("low") > F.col("_l")))
    quality = clip(55 + F.least(F.lit(15.0), 300 * ratio(F.col("_h") - F.col("high"), F.col("_h"))), 0, 100)
    rows = rows.withColumn("quality", quality).select("symbol_id", "week_end", "high", "low", "quality", "_e.*")
    return resolve(rows, "high").filter("state = 'confirmed'").select("symbol_id", "week_end", F.col("high").alias("ceiling"), F.col("low").alias("invalidation"), "quality", "signal_date")


# --- cohorts ------------------------------------------------------------------------------------------------

#: Fixed edges of the bins of setup quality.
QUALITY = ((50, "0-50"), (65, "50-65"), (80, "65-80"), (90, "80-90"))


def quality_calibration(signals: DataFrame, *horizons: int) -> DataFrame:
    """Returns after signals by family and bin of setup quality. Signals have family, quality and fwd_<horizon>."""
    q, name = F.col("quality"), F.lit("90-100")
    for edge, label in reversed(QUALITY):
        name = F.when(q < edge, label).otherwise(name)
    out = [F.count("*").alias("signals"), F.avg("quality").alias("avg_quality")]
    for h in horizons:
        v = F.col(f"fwd_{h}")
        out += [F.count(v).alias(f"n_{h}"), F.avg((v > 0).cast("double")).alias(f"hit_rate_{h}"), F.avg(v).alias(f"mean_{h}"), F.percentile(v, F.lit(0.5)).alias(f"median_{h}")]
    return signals.filter(q.isNotNull()).groupBy("family", name.alias("quality_bin")).agg(*out)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    p = hits / n
    centre, margin = p + z * z / (2 * n), z * F.sqrt(F.greatest((p * (1 - p) + z * z / (4 * n)) / n, F.lit(0.0)))
    scale = 1 + z * z / n
    return F.greatest(F.lit(0.0), (centre - margin) / scale), F.least(F.lit(1.0), (centre + margin) / scale)


def calibration(outcomes: DataFrame, dimensions: list[str], least: int = 30) -> DataFrame:
    """Complete outcomes by any dimensions: returns, confirmed and failed shares with intervals, days to the breakout.

    Outcomes have complete, confirmed, failed, fwd, relative, mfe, mae and
    days_to_breakout.
    """
    median = lambda c: F.percentile(c, F.lit(0.5)).alias(f"median_{c}")
    rows = outcomes.filter("complete").groupBy(*dimensions).agg(F.count("*").alias("n"), F.count_if(F.col("confirmed")).alias("_c"), F.count_if(F.col("failed")).alias("_f"), F.avg("fwd").alias("mean_fwd"), F.avg("relative").alias("mean_relative"), *[median(c) for c in ("fwd", "mfe", "mae", "days_to_breakout")])
    (c0, c1), (f0, f1) = wilson(F.col("_c"), F.col("n")), wilson(F.col("_f"), F.col("n"))
    return rows.withColumns({"confirmed_share": F.col("_c") / F.col("n"), "confirmed_low": c0, "confirmed_high": c1, "failed_share": F.col("_f") / F.col("n"), "failed_low": f0, "failed_high": f1, "enough": F.col("n") >= least}).drop("_c", "_f")


def matched_controls(signals: DataFrame, classified: DataFrame, *cell: str) -> DataFrame:
    """For each signal the row without a signal of its cell whose liquidity is nearest; ties go to the smaller symbol.

    Cells (keys) contain the date. Signals have signal_id, symbol_id and the
    keys; classified rows have symbol_id, the keys and liquidity. Both are put in
    one order of liquidity, in which the nearest control is the last before or
    the first after, so no pairs are made.
    """
    targets = signals.join(classified, ["symbol_id", *cell])
    free = classified.join(signals.select("symbol_id", *cell).distinct(), ["symbol_id", *cell], "left_anti")
    controls = free.groupBy(*cell, "liquidity").agg(F.min("symbol_id").alias("_c")).withColumn("_pair", F.struct(F.col("liquidity").alias("at"), F.col("_c").alias("who"))).drop("_c")
    rows = targets.unionByName(controls, allowMissingColumns=True)
    # growing frames from either end; one that shrinks would be worked out anew for each row
    order = lambda c: Window.partitionBy(*cell).orderBy(c)
    below, above = F.last("_pair", ignorenulls=True).over(order(F.asc("liquidity"))), F.last("_pair", ignorenulls=True).over(order(F.desc("liquidity")))
    rows = rows.withColumns({"_b": below, "_a": above}).filter("signal_id is not null")
    gap = lambda c: F.round(F.abs(F.col(f"{c}.at") - F.col("liquidity")), 12)
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(gap(c).alias("gap"), F.col(f"{c}.who").alias("who"), F.col(f"{c}.at").alias("at")))
    best = F.array_min(F.array_compact(F.array(option("_b"), option("_a"))))
    return rows.withColumn("_m", best).filter("_m is not null").select("signal_id", "symbol_id", *cell, "liquidity", F.col("_m.who").alias("control_symbol"), F.col("_m.at").alias("control_liquidity"))


def signal_minus_control(signals: DataFrame, controls: DataFrame, *keys: str) -> DataFrame:
    """Return of each signal less that of its control where both windows are complete; a key with two controls is an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    one = controls.filter("complete").select(*keys, F.col("fwd").alias("control_fwd"), n.alias("_n")).filter(F.assert_true(F.col("_n") == 1, "a key has two controls").isNull()).drop("_n")
    return signals.filter("complete").join(one, list(keys)).withColumn("difference", F.col("fwd") - F.col("control_fwd"))


def session_returns(bars: DataFrame, **horizons: int) -> DataFrame:
    """Returns in per cent over so many sessions of the market; null where the symbol has no bar on that very session.

    Sessions are numbered in a window over the distinct dates, one row each.
    """
    days = bars.select("trade_date").distinct().withColumn("session", F.row_number().over(Window.orderBy("trade_date")))
    rows = bars.join(days, "trade_date")
    then = lambda n: F.max("close").over(along(order="session").rangeBetween(n, n))
    return rows.withColumns({f"ret_{k}": F.when((F.col("close") > 0) & (then(n) > 0), 100 * (then(n) / F.col("close") - 1)) for k, n in horizons.items()})


def freshness_bucket(fresh: int = 8) -> Column:
    return F.when(F.col("transition") == "S1->S2", "S1_TO_S2").when(F.col("stage") == "S2", F.when(F.col("bars_in_stage") <= fresh, "fresh_s2").otherwise("mature_s2")).otherwise("non_s2")


def stage_entries(stages: DataFrame, returns: DataFrame) -> DataFrame:
    """Weekly stages with the returns from the first session of the market at or after the week's end, where the symbol has a bar."""
    ends, days = stages.select(F.col("week_end").alias("d")).distinct(), returns.select(F.col("trade_date").alias("d")).distinct()
    both = ends.join(days.withColumn("session_date", F.col("d")), "d", "full_outer")
    entry = both.withColumn("trade_date", F.last("session_date", ignorenulls=True).over(Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)))
    calendar = ends.join(entry.select("d", "trade_date"), "d").withColumnRenamed("d", "week_end")
    return stages.join(calendar, "week_end").join(returns, ["symbol_id", "trade_date"])


def spread_of(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Number, mean, median, share above zero in per cent and quartiles of the known values."""
    v, at = F.col(value), lambda p: F.percentile(value, F.lit(p))
    return rows.filter(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), at(0.5).alias("median"), (100 * F.avg((v > 0).cast("double"))).alias("win_rate"), at(0.25).alias("p25"), at(0.75).alias("p75"))


def gate_baskets(rows: DataFrame, n: int, *values: str) -> DataFrame:
    """Mean returns of the top n by score of each date, and of the top n among gated rows. Rows have trade_date, score and gated."""
    place = lambda *keys: F.row_number().over(Window.partitionBy("trade_date", *keys).orderBy(F.desc_nulls_last("score"), "symbol_id")) <= n
    modes = F.array_compact(F.array(F.when(place(), "baseline"), F.when(F.col("gated") & place("gated"), "gated")))
    picked = rows.withColumn("_m", modes).withColumn("mode", F.explode("_m"))
    return picked.groupBy("trade_date", "mode").agg(F.count("*").alias("basket"), *[F.avg(v).alias(v) for v in values])
