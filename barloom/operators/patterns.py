"""Chart patterns and signals that windows express, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import along, full, ratio, trailing
from barloom.operators.indicators import volume_zscore


def smooth(bars: DataFrame, k: int = 2) -> DataFrame:
    """Centred mean of the close over 2k + 1 bars; it looks ahead k bars and is for shapes of the past only."""
    return bars.withColumn("smooth", F.avg("close").over(along().rowsBetween(-k, k)))


def turning_points(bars: DataFrame) -> DataFrame:
    """Bars whose close is above (peak) or below (trough) both neighbours."""
    c, before, after = F.col("close"), F.lag("close").over(along()), F.lead("close").over(along())
    kind = F.when((c > before) & (c > after), "peak").when((c < before) & (c < after), "trough")
    return bars.withColumn("kind", kind).filter("kind is not null").select("symbol_id", "trade_date", "close", "kind")


def flat_base(bars: DataFrame, n: int = 25, depth: float = 0.15) -> DataFrame:
    """Bars whose n bars before span at most a share of their high, and that close above it."""
    spec = trailing(n, skip=1)
    rows = bars.withColumns({"_h": full(F.max("high").over(spec), spec, n), "_l": F.min("low").over(spec)})
    return rows.filter((1 - F.col("_l") / F.col("_h") <= depth) & (F.col("close") > F.col("_h"))).select("symbol_id", "trade_date", "close")


def pocket_pivot(bars: DataFrame, n: int = 10) -> DataFrame:
    """Up days whose volume is above that of every down day of the n bars before."""
    down = bars.withColumn("_p", F.lag("close").over(along())).withColumn("_dv", F.when(F.col("close") < F.col("_p"), F.col("volume")))
    rows = down.withColumn("_m", F.max("_dv").over(trailing(n, skip=1)))
    return rows.filter((F.col("close") > F.col("_p")) & (F.col("volume") > F.col("_m"))).select("symbol_id", "trade_date", "close")


def inside_bar_breaks(bars: DataFrame) -> DataFrame:
    """A bar inside the one before, and a close above that one's high on the next."""
    h, low = F.col("high"), F.col("low")
    w = along()
    rows = bars.withColumns({"_inside": (F.lag(h, 1).over(w) <= F.lag(h, 2).over(w)) & (F.lag(low, 1).over(w) >= F.lag(low, 2).over(w)), "_mother": F.lag(h, 2).over(w)})
    return rows.filter(F.col("_inside") & (F.col("close") > F.col("_mother"))).select("symbol_id", "trade_date", "close")


def inside_run_breaks(bars: DataFrame, most: int = 3, least_ratio: float = 1.5, least_z: float = 2.0) -> DataFrame:
    """Closes above the mother bar of the one to ``most`` inside bars just before, with the volume confirmed.

    A bar is inside when it passes neither end of the bar before it; the mother
    precedes the first of the run, of which the last ``most`` bars count. Volume
    is confirmed by its ratio and one of its z-scores. The first most + 1 bars
    of a symbol give no signal.
    """
    w = along()
    h, low = F.col("high"), F.col("low")
    rows = volume_zscore(bars).withColumns({"_inside": F.coalesce((h <= F.lag(h).over(w)) & (low >= F.lag(low).over(w)), F.lit(False)), "_v": ratio(F.col("volume"), F.avg("volume").over(trailing(20, skip=1))), "_n": F.row_number().over(w)})
    rows = rows.withColumns({f"_i{k}": F.coalesce(F.lag("_inside", k).over(w), F.lit(False)) for k in range(1, most + 1)})
    run = F.lit(most)
    for k in range(most, 0, -1):
        run = F.when(~F.col(f"_i{k}"), k - 1).otherwise(run)
    rows = rows.withColumn("inside_bars", run)
    of = lambda c: F.coalesce(*[F.when(F.col("inside_bars") == k, F.lag(c, k + 1).over(w)) for k in range(1, most + 1)])
    rows = rows.withColumns({"mother_date": of("trade_date"), "mother_high": of("high"), "mother_low": of("low")})
    confirmed = (F.col("_v") >= least_ratio) & (F.coalesce(F.col("vol_z20") >= least_z, F.lit(False)) | F.coalesce(F.col("vol_z50") >= least_z, F.lit(False)))
    return rows.filter((F.col("_n") >= most + 2) & (F.col("close") > F.col("mother_high")) & confirmed).select("symbol_id", "trade_date", "close", "inside_bars", "mother_date", "mother_high", "mother_low")


def tight_weeks(weeks: DataFrame, percent: float = 1.5) -> DataFrame:
    """Weeks that close within some per cent of both weeks before."""
    c, w = F.col("close"), along(order="week_end")
    a, b = F.lag("close", 1).over(w), F.lag("close", 2).over(w)
    near = lambda x, y: F.abs(ratio(x, y) - 1) <= percent / 100
    return weeks.withColumn("_ok", near(c, a) & near(a, b)).filter("_ok").select("symbol_id", "week_end", "close")


def changed_symbols(bars: DataFrame, move: float = 0.01, volume: float = 1.3) -> DataFrame:
    """Last bars with a move or a volume that calls for a new scan."""
    rows = bars.withColumns({"_m": F.abs(ratio(F.col("close"), F.lag("close").over(along())) - 1), "_v": ratio(F.col("volume"), F.avg("volume").over(trailing(20, skip=1))), "_n": F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trade_date")))})
    return rows.filter((F.col("_n") == 1) & ((F.col("_m") >= move) | (F.col("_v") >= volume))).select("symbol_id", "trade_date")


def movers(rows: DataFrame) -> DataFrame:
    """Score of large moves, volume and range; rows with two points or more. Rows have move_pct, atr_pct, vol_z20, volume_ratio and range_atr."""
    score = F.when(F.abs("move_pct") >= F.greatest(F.lit(1.5), 1.2 * F.col("atr_pct")), 1).otherwise(0) + F.when(F.col("vol_z20") >= 2, 2).when(F.col("volume_ratio") >= 1.5, 1).otherwise(0) + F.when(F.col("range_atr") >= 1.5, 1).otherwise(0)
    return rows.withColumn("mover_score", score).filter("mover_score >= 2")


def best_per_symbol(signals: DataFrame, score: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc(score), F.desc("trade_date")))
    return signals.withColumn("_n", n).filter("_n = 1").drop("_n")


def family_statistics(signals: DataFrame) -> DataFrame:
    """Signals, hit rate and returns per family, and over all (null family). Signals have family and fwd_20."""
    v = F.col("fwd_20")
    return signals.rollup("family").agg(F.count("*").alias("signals"), F.avg((v > 0).cast("double")).alias("hit_rate"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"))


def by_year(signals: DataFrame) -> DataFrame:
    return signals.groupBy(F.year("trade_date").alias("year"), "family").agg(F.count("*").alias("signals"), F.avg("fwd_20").alias("mean"))
