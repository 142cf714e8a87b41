"""Technical indicators: columns added to bars, all over one partitioning by symbol.

Bars have symbol_id, trade_date, open, high, low, close and volume. Null prices
give null results, frames that are not full give null where an indicator needs
a full one, and no indicator looks ahead.
"""

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


def volume_() -> Column:
    return F.col("volume")


def by_symbol() -> WindowSpec:
    return along()


def so_far() -> WindowSpec:
    return along().rowsBetween(Window.unboundedPreceding, 0)



def lag(col: str | Column, n: int = 1) -> Column:
    return F.lag(col, n).over(by_symbol())


def mean(col: str | Column, n: int) -> Column:
    return F.avg(col).over(trailing(n))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength from plain rolling means of gains and losses; 100 without losses, null until n moves."""
    step = bars.withColumn("_d", close_() - lag("close"))
    up, down = mean(F.greatest(F.col("_d"), F.lit(0.0)), n), mean(F.greatest(-F.col("_d"), F.lit(0.0)), n)
    out = F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
    return step.withColumn(f"rsi_{n}", full(out, trailing(n), n, F.col("_d"))).drop("_d")


def sma(bars: DataFrame, *windows: int) -> DataFrame:
    return bars.withColumns({f"sma_{n}": mean("close", n) for n in windows})


def one_step_ema(bars: DataFrame, *spans: int) -> DataFrame:
    """The previous close moved once towards the current one; not recursive."""
    return bars.withColumns({f"ema1_{n}": F.coalesce(lag("close") + 2.0 / (n + 1) * (close_() - lag("close")), close_()) for n in spans})


def _fold(values: Column, alpha: float) -> Column:
    """Recursive smoothing of an array, as an array of the same length; nulls carry the last value on."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        last = F.when(a["last"].isNull(), x).when(x.isNull(), a["last"]).otherwise(alpha * x + (1 - alpha) * a["last"])
        return F.struct(last.alias("last"), F.concat(a["out"], F.array(last)).alias("out"))

    return F.aggregate(values, start, step, lambda a: a["out"])


def recursive_ema(bars: DataFrame, *spans: int) -> DataFrame:
    """``ewm(span, adjust=False)`` of the close, one pandas pass per symbol (a symbol has a few thousand bars)."""
    fields = ", ".join(f"ema_{n} double" for n in spans)

    def smooth(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("trade_date")
        for n in spans:
            part[f"ema_{n}"] = part["close"].ewm(span=n, adjust=False).mean()
        return part

    names = [f.simpleString().replace(":", " ", 1) for f in bars.schema]
    return bars.groupBy("symbol_id").applyInPandas(smooth, ", ".join([*names, fields]))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, signal and histogram from recursive averages."""
    fields = ", ".join([*[f.simpleString().replace(":", " ", 1) for f in bars.schema], "macd double", "macd_signal double", "macd_hist double"])

    def lines(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("trade_date")
        ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
        part["macd"] = ema(part["close"], fast) - ema(part["close"], slow)
        part["macd_signal"] = ema(part["macd"], signal)
        part["macd_hist"] = part["macd"] - part["macd_signal"]
        return part

    return bars.groupBy("symbol_id").applyInPandas(lines, fields)


def true_range() -> Column:
    return F.greatest(high_(), lag("close")) - F.least(low_(), lag("close"))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    tr = bars.withColumn("_tr", true_range())
    return tr.withColumn(f"atr_{n}", mean("_tr", n)).drop("_tr")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """+DI, -DI and ADX with plain means at each level and the usual directional moves."""
    up, down = high_() - lag("high"), lag("low") - low_()
    moved = bars.withColumns({"_tr": true_range(), "_up": F.when((up > down) & (up > 0), up).otherwise(0.0), "_dn": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    lines = moved.withColumns({"plus_di": 100 * ratio(mean("_up", n), mean("_tr", n)), "minus_di": 100 * ratio(mean("_dn", n), mean("_tr", n))})
    dx = lines.withColumn("_dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return dx.withColumn("adx", mean("_dx", n)).drop("_tr", "_up", "_dn", "_dx")


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mid, dev = mean("close", n), F.stddev_samp("close").over(trailing(n))
    return bars.withColumns({"bb_mid": mid, "bb_up": mid + width * dev, "bb_low": mid - width * dev})


def roc(bars: DataFrame, *lags: int) -> DataFrame:
    return bars.withColumns({f"roc_{n}": 100 * (ratio(close_(), lag("close", n)) - 1) for n in lags})


def batch_supertrend(bars: DataFrame, n: int = 10, mult: float = 3.0) -> DataFrame:
    """Bands around the middle price from the mean range; the trend is up at or above the lower band's line."""
    rng = bars.withColumn("_r", mean(high_() - low_(), n))
    mid = (high_() + low_()) / 2
    out = rng.withColumns({"st_upper": mid + mult * F.col("_r"), "st_lower": mid - mult * F.col("_r")})
    return out.withColumn("st_direction", F.when(close_() > lag("st_upper"), 1).when(close_() < lag("st_lower"), -1).otherwise(0)).drop("_r")


def stateful_supertrend(bars: DataFrame, n: int = 10, mult: float = 3.0) -> DataFrame:
    """Supertrend with carried bands and flips, one pass per symbol."""
    fields = ", ".join([*[f.simpleString().replace(":", " ", 1) for f in bars.schema], "supertrend double", "trend int"])

    def carry(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("trade_date").reset_index(drop=True)
        before = part["close"].shift()
        tr = pd.concat([part["high"], before], axis=1).max(axis=1) - pd.concat([part["low"], before], axis=1).min(axis=1)
        reach, mid = mult * tr.rolling(n, min_periods=1).mean(), (part["high"] + part["low"]) / 2
        upper, lower, trend, line, state = None, None, [], [], 1
        for up, low, close, last in zip(mid + reach, mid - reach, part["close"], before, strict=True):
            upper = up if upper is None or up < upper or last > upper else upper
            lower = low if lower is None or low > lower or last < lower else lower
            state = -1 if state == 1 and close < lower else 1 if state == -1 and close > upper else state
            trend.append(state)
            line.append(lower if state == 1 else upper)
        part["supertrend"], part["trend"] = line, pd.array(trend, dtype="int32")
        return part

    return bars.groupBy("symbol_id").applyInPandas(carry, fields)


def swing_low(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn(f"swing_low_{n}", F.min("low").over(trailing(n)))


def trailing_returns(bars: DataFrame, *lags: int) -> DataFrame:
    return bars.withColumns({f"ret_{n}": ratio(close_(), lag("close", n)) - 1 for n in (lags or (5, 20, 60, 120, 252))})


def volume_zscore(bars: DataFrame, *windows: int) -> DataFrame:
    """Volume against the mean and population deviation of the bars before it; full frames only."""
    out = {}
    for n in windows or (20, 50):
        spec = trailing(n, skip=1)
        out[f"vol_z{n}"] = full(deviation(volume_(), spec), spec, n)
    return bars.withColumns(out)


def custom(bars: DataFrame, n: int = 20) -> DataFrame:
    """Returns, log returns, volatility, volume ratio and spike, range and highs and lows."""
    moved = bars.withColumns({"ret_1": ratio(close_(), lag("close")) - 1, "log_ret": F.log(ratio(close_(), lag("close")))})
    vol = ratio(volume_(), mean("volume", n))
    return moved.withColumns(
        {"volatility": F.stddev_samp("ret_1").over(trailing(n)), "volume_ratio": vol, "volume_spike": F.coalesce(vol > 2, F.lit(False)), "range_pct": 100 * ratio(high_() - low_(), close_()), "high_n": F.max("high").over(trailing(n)), "low_n": F.min("low").over(trailing(n))}
    )


def volume_lines(bars: DataFrame) -> DataFrame:
    """On-balance volume and cumulative volume-weighted price."""
    signed = bars.withColumn("_s", F.coalesce(F.signum(close_() - lag("close")), F.lit(0.0)) * volume_())
    return signed.withColumns({"obv": F.sum("_s").over(so_far()), "vwap": ratio(F.sum((high_() + low_() + close_()) / 3 * volume_()).over(so_far()), F.sum("volume").over(so_far()))}).drop("_s")


def trend_strength(bars: DataFrame) -> DataFrame:
    smooth = recursive_ema(bars, 20, 50)
    return smooth.withColumns({"ema_spread_pct": 100 * ratio(F.col("ema_20") - F.col("ema_50"), F.col("ema_50")), "sma200_distance_pct": 100 * (ratio(close_(), mean("close", 200)) - 1)})


def momentum(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"mom_10": close_() - lag("close", 10), "mom_20": close_() - lag("close", 20), "roc_12": 100 * (ratio(close_(), lag("close", 12)) - 1), "roc_26": 100 * (ratio(close_(), lag("close", 26)) - 1)})


STAGE2_WEIGHTS = {"above_150": 15, "above_200": 15, "stacked": 15, "rising_200": 15, "above_50": 10, "off_low": 10, "near_high": 10, "golden": 10}


def stage2(bars: DataFrame) -> DataFrame:
    """A 0-100 score of trend conditions, its label, bars since the averages last crossed upwards, and what fails."""
    lined = bars.withColumns({f"_s{n}": full(mean("close", n), trailing(n), n) for n in (50, 150, 200)})
    lined = lined.withColumns({"_slope": F.col("_s200") - F.lag("_s200", 20).over(by_symbol()), "_hi": F.max("high").over(trailing(252)), "_lo": F.min("low").over(trailing(252)), "_above": F.col("_s50") > F.col("_s200")})
    conditions = {
        "above_150": close_() > F.col("_s150"),
        "above_200": close_() > F.col("_s200"),
        "stacked": F.col("_s150") > F.col("_s200"),
        "rising_200": F.col("_slope") > 0,
        "above_50": close_() > F.col("_s50"),
        "off_low": close_() >= 1.25 * F.col("_lo"),
        "near_high": close_() >= 0.75 * F.col("_hi"),
        "golden": F.col("_above"),
    }
    held = {k: F.coalesce(v, F.lit(False)) for k, v in conditions.items()}
    score = sum((F.when(v, float(STAGE2_WEIGHTS[k])).otherwise(0.0) for k, v in held.items()), F.lit(0.0))
    crossed = F.coalesce(F.col("_above") & ~F.lag("_above").over(by_symbol()), F.lit(False))
    out = lined.withColumns({"stage2_score": score, "stage2_fails": F.concat_ws(",", reasons(*[(~v, k) for k, v in held.items()])), "_cross": F.sum(F.when(crossed, 1).otherwise(0)).over(so_far())})
    since = F.row_number().over(Window.partitionBy("symbol_id", "_cross").orderBy("trade_date")) - 1
    label = F.when(F.col("stage2_score") >= 85, "strong").when(F.col("stage2_score") >= 70, "stage2").when(F.col("stage2_score") >= 50, "early").otherwise("none")
    return out.withColumns({"bars_since_cross": F.when(F.col("_cross") > 0, since), "stage2_label": label}).drop("_s50", "_s150", "_s200", "_slope", "_hi", "_lo", "_above", "_cross")


def preconditions(bars: DataFrame) -> DataFrame:
    """Consolidation range, base tightness, volatility contraction, pullback depth and slope of the resistance."""
    hi, lo = F.max("high").over(trailing(20)), F.min("low").over(trailing(20))
    ranged = bars.withColumns({"_r": ratio(high_() - low_(), close_()), "consolidation_range": ratio(hi - lo, lo), "pullback_depth": 1 - ratio(close_(), hi), "_hi": hi})
    return ranged.withColumns({"base_tightness": F.stddev_samp("close").over(trailing(10)) / F.nullif(mean("close", 10), F.lit(0.0)), "volatility_contraction": ratio(mean("_r", 5), mean("_r", 20)), "resistance_slope": ratio(F.col("_hi") - F.lag("_hi", 5).over(by_symbol()), F.lag("_hi", 5).over(by_symbol()))}).drop("_r", "_hi")


def risk_profile(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Per symbol at its last bar: volatility, beta, drawdowns, range and traded value, with a liquidity percentile."""
    moved = bars.join(bench, "trade_date", "left").withColumns({"_r": ratio(close_(), lag("close")) - 1})
    moved = moved.withColumn("_b", ratio(F.col("bench_close"), F.lag("bench_close").over(by_symbol())) - 1)
    back = moved.withColumns({"_n": F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date"))), "_value": close_() * volume_()})
    tail = back.filter("_n <= 126").withColumns({f"_top{n}": F.max(F.when(F.col("_n") <= n, close_())).over(so_far()) for n in (63, 126)})
    within = lambda n, c: F.when(F.col("_n") <= n, c)
    out = tail.groupBy("symbol_id").agg(
        F.stddev_samp(within(20, F.col("_r"))).alias("vol_20"),
        F.stddev_samp(within(60, F.col("_r"))).alias("vol_60"),
        (F.covar_samp(within(60, F.col("_r")), within(60, F.col("_b"))) / F.nullif(F.var_samp(within(60, F.when(F.col("_r").isNotNull(), F.col("_b")))), F.lit(0.0))).alias("beta_60"),
        F.min(within(63, ratio(close_(), F.col("_top63")) - 1)).alias("max_drawdown_63"),
        F.min(ratio(close_(), F.col("_top126")) - 1).alias("max_drawdown_126"),
        F.avg(within(20, F.col("_value"))).alias("avg_value_20"),
    )
    return out.withColumn("liquidity_pct", pct_rank("avg_value_20"))


def delivery_trend(bars: DataFrame) -> DataFrame:
    """Per symbol: latest delivery share, its means over 5 and 20 observations, and changes against them."""
    n = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date")))
    back = bars.filter("delivery_pct is not null").withColumn("_n", n).filter("_n <= 20")
    d = F.col("delivery_pct")
    out = back.groupBy("symbol_id").agg(F.max(F.when(F.col("_n") == 1, d)).alias("latest"), F.avg(F.when(F.col("_n") <= 5, d)).alias("mean_5"), F.avg(d).alias("mean_20"), F.max(F.when(F.col("_n") == 6, d)).alias("_old"))
    return out.withColumns({"change_5": F.col("latest") - F.col("_old"), "vs_mean_20": F.col("latest") - F.col("mean_20"), "trend_score": clip(50 + (F.col("mean_5") - F.col("mean_20")) * 2, 0, 100)}).drop("_old")


def delivery_features(bars: DataFrame) -> DataFrame:
    out = bars.withColumns({"delivery_5": mean("delivery_pct", 5), "delivery_20": mean("delivery_pct", 20)})
    return out.withColumn("delivery_pctile", pct_rank("delivery_pct", "trade_date"))


def liquidity(bars: DataFrame) -> DataFrame:
    return bars.withColumn("traded_value", close_() * volume_()).withColumn("liquidity_pct", pct_rank("traded_value", "trade_date"))


def cross_section(bars: DataFrame, master: DataFrame, metric: str) -> DataFrame:
    """Dense rank, percentile and dense rank within the sector of a metric, for each date; null metrics rank last."""
    joined = bars.join(master.select("symbol_id", "sector"), "symbol_id", "left")
    order = F.col(metric).desc_nulls_last()
    return joined.withColumns({"rank_all": F.dense_rank().over(Window.partitionBy("trade_date").orderBy(order)), "pctile": pct_rank(metric, "trade_date"), "rank_sector": F.dense_rank().over(Window.partitionBy("trade_date", "sector").orderBy(order))})


def all_technicals(bars: DataFrame) -> DataFrame:
    """Many indicators in one plan over one shuffle."""
    return volume_zscore(trailing_returns(bollinger(adx(atr(sma(rsi(bars), 20, 50, 200))))))


def one_step_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD from one-step smoothing at three levels, after a warm-up of ``slow`` bars."""
    step = lambda c, n: F.coalesce(F.lag(c).over(by_symbol()) + 2.0 / (n + 1) * (F.col(c) - F.lag(c).over(by_symbol())), F.col(c))
    line = bars.withColumn("macd1", F.when(F.row_number().over(by_symbol()) >= slow, step("close", fast) - step("close", slow)))
    return line.withColumn("macd1_signal", step("macd1", signal)).withColumn("macd1_hist", F.col("macd1") - F.col("macd1_signal"))
