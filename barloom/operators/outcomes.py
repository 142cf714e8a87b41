"""Forward outcomes: returns after events, cohorts, factor efficacy and model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.stats import along, pct_rank, rank_pairs, ratio, reasons


def close_() -> Column:
    return F.col("close")


def by_symbol() -> WindowSpec:
    return along()

BANDS = ((1, 10, "top_10"), (11, 50, "11_50"), (51, 200, "51_200"), (201, 10**9, "201_plus"))


def band(rank: Column) -> Column:
    out = F.when(rank.between(*BANDS[0][:2]), BANDS[0][2])
    for low, high, name in BANDS[1:]:
        out = out.when(rank.between(low, high), name)
    return out


def summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, median and share above zero of the known values of each group."""
    v = F.col(value)
    return rows.filter(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.avg((v > 0).cast("double")).alias("win_rate"))


def long_horizons(rows: DataFrame, horizons: list[int], *keep: str) -> DataFrame:
    """One row per horizon instead of one column."""
    items = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("ret")) for h in horizons])
    return rows.select(*keep, F.explode(items).alias("x")).select(*keep, "x.horizon", "x.ret")


def against_control(rows: DataFrame, value: str) -> DataFrame:
    """Mean of each bucket minus the control bucket's mean over the dates that have both."""
    days = rows.filter((F.col("bucket") == "control") & F.col(value).isNotNull()).groupBy("trade_date").agg(F.avg(value).alias("_c"))
    both = rows.filter((F.col("bucket") != "control") & F.col(value).isNotNull()).join(days, "trade_date")
    return both.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.col(value) - F.col("_c")).alias("edge"))


def spearman(rows: DataFrame, a: str, b: str, *keys: str, least: int = 3, few: bool = False) -> DataFrame:
    """Rank correlation of two columns in each group; null below ``least`` pairs.

    Without keys, or with ``few`` large groups (bands of ranks), values are ranked
    in pieces; otherwise a window sees all rows of a group.
    """
    if keys and not few:
        both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        ranked = both.withColumns({"_a": pct_rank(a, *keys), "_b": pct_rank(b, *keys)})
    else:
        ranked = rank_pairs(rows, a, b, *keys)
    grouped = ranked.groupBy(*keys) if keys else ranked
    return grouped.agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.nanvl(F.corr("_a", "_b"), F.lit(None))).alias("ic"))


def rolling_ic(rows: DataFrame, a: str, b: str, n: int = 20) -> DataFrame:
    day = spearman(rows, a, b, "trade_date")
    return day.withColumn("rolling_ic", F.avg("ic").over(Window.orderBy("trade_date").rowsBetween(-(n - 1), 0)))


def factor_coverage(rows: DataFrame, factors: list[str]) -> DataFrame:
    """Known values, coverage and first and last date of each factor."""
    items = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in factors])
    out = rows.select("trade_date", F.explode(items).alias("x")).groupBy("x.factor").agg(F.count("x.value").alias("known"), F.avg(F.col("x.value").isNotNull().cast("double")).alias("coverage"), F.min(F.when(F.col("x.value").isNotNull(), F.col("trade_date"))).alias("first_date"), F.max(F.when(F.col("x.value").isNotNull(), F.col("trade_date"))).alias("last_date"))
    return out.withColumn("status", F.when(F.col("known") == 0, "missing").when(F.col("coverage") < 0.8, "partial").otherwise("ok"))


def anomalies(rows: DataFrame, column: str, limit: float) -> DataFrame:
    return rows.agg(F.count(column).alias("n"), F.count_if(F.abs(column) > limit).alias("anomalous"))


def buckets(rows: DataFrame, score: str, n: int, *keys: str) -> DataFrame:
    """Equal-count buckets of a score within the keys, as rank-based cuts make them (1 is the lowest)."""
    part = Window.partitionBy(*keys)
    k = F.row_number().over(part.orderBy(score, "symbol_id"))
    size = F.count(F.lit(1)).over(part)
    return rows.filter(F.col(score).isNotNull()).withColumn("bucket", F.when(size == 1, 1).otherwise(F.greatest(F.ceil((k - 1) * n / F.nullif(size - 1, F.lit(0))) - 1, F.lit(0)) + 1).cast("int"))


def quintile_returns(rows: DataFrame, score: str, value: str) -> DataFrame:
    """Mean outcome by quintile of the date, and whether it rises from the one before."""
    out = summary(rows.withColumn("quintile", F.ntile(5).over(Window.partitionBy("trade_date").orderBy(score, "symbol_id"))).filter(F.col(score).isNotNull()), value, "quintile")
    return out.withColumn("rises", F.round("mean", 9) > F.lag(F.round("mean", 9)).over(Window.orderBy("quintile")))


def rallies(bars: DataFrame, low: Column, high: Column, n: int) -> DataFrame:
    """Per symbol in a window of dates: return, lowest and highest close, and rally from low to high; the n largest."""
    part = bars.filter(F.col("trade_date").between(low, high)).groupBy("symbol_id").agg(F.min_by("close", "trade_date").alias("_a"), F.max_by("close", "trade_date").alias("_z"), F.min("close").alias("low_close"), F.max("close").alias("high_close"), F.count("*").alias("n"))
    out = part.filter("n >= 10").select("symbol_id", F.round(ratio(F.col("_z"), F.col("_a")) - 1, 6).alias("ret"), "low_close", "high_close", F.round(ratio(F.col("high_close"), F.col("low_close")) - 1, 6).alias("rally"))
    return out.orderBy(F.desc("rally"), "symbol_id").limit(n)


def excursions(bars: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """After each event: return, best and worst move and sessions to the best, within the next bars.

    Bars and events meet by symbol and session number, each bar with the events at most ``horizon`` sessions before.
    """
    numbered = bars.withColumn("_n", F.row_number().over(by_symbol())).select("symbol_id", "trade_date", "close", "high", "low", "_n")
    entry = events.select("symbol_id", "trade_date").join(numbered, ["symbol_id", "trade_date"]).select("symbol_id", F.col("trade_date").alias("event_date"), close_().alias("_c"), F.col("_n").alias("_e"))
    reach = entry.withColumn("_n", F.explode(F.sequence(F.col("_e") + 1, F.col("_e") + horizon)))
    met = reach.join(numbered.drop("trade_date"), ["symbol_id", "_n"])
    return met.groupBy("symbol_id", "event_date").agg((F.max_by("close", "_n") / F.first("_c") - 1).alias("ret"), (F.max("high") / F.first("_c") - 1).alias("mfe"), (F.min("low") / F.first("_c") - 1).alias("mae"), F.count("*").alias("sessions"))


def cohorts(rows: DataFrame, value: str, *dims: str) -> DataFrame:
    """Win rate, payoff and expectancy over every combination of the dimensions (null: all)."""
    v = F.col(value)
    return rows.filter(v.isNotNull()).cube(*dims).agg(F.count("*").alias("n"), F.avg((v > 0).cast("double")).alias("win_rate"), ratio(F.avg(F.when(v > 0, v)), -F.avg(F.when(v <= 0, v))).alias("payoff"), F.avg(v).alias("expectancy"))


def exclusion_reasons(rows: DataFrame) -> DataFrame:
    why = reasons((F.col("matured_5").isNull(), "not_matured"), (F.abs("fwd_5") > 1, "anomalous"), (F.col("volume") <= 10, "thin"))
    return rows.withColumn("excluded", F.concat_ws(",", why))


def basket(rows: DataFrame, score: str, n: int) -> DataFrame:
    """Equal-weight outcome of the top n of each date, with coverage and overlap with the basket before."""
    k = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc(score), "symbol_id"))
    top = rows.filter(F.col(score).isNotNull()).withColumn("_k", k).filter(F.col("_k") <= n)
    days = rows.select("trade_date").distinct().withColumn("_day", F.row_number().over(Window.orderBy("trade_date")))
    held = top.join(days, "trade_date")
    before = held.select("symbol_id", (F.col("_day") + 1).alias("_day"), F.lit(1).alias("_kept"))
    return held.join(before, ["symbol_id", "_day"], "left").groupBy("trade_date").agg(F.count("*").alias("n"), F.avg("fwd_5").alias("ret"), F.count("_kept").alias("overlap"))


def performance(series: DataFrame, per_year: float = 252.0) -> DataFrame:
    """Total and yearly return, volatility (population), Sharpe ratio, drawdown and win rate of one return per date."""
    order = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = series.filter("ret is not null").withColumn("_l", F.exp(F.sum(F.log1p("ret")).over(order))).withColumn("_top", F.greatest(F.lit(1.0), F.max("_l").over(order)))
    total = F.exp(F.sum(F.log1p("ret"))) - 1
    return rows.agg(F.count("*").alias("n"), total.alias("total"), (F.pow(1 + total, per_year / F.count("*")) - 1).alias("cagr"), (F.stddev_pop("ret") * F.sqrt(F.lit(per_year))).alias("volatility"), (ratio(F.avg("ret"), F.stddev_pop("ret")) * F.sqrt(F.lit(per_year))).alias("sharpe"), F.min(F.col("_l") / F.col("_top") - 1).alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def best_and_worst(rows: DataFrame, value: str, least: int, n: int) -> DataFrame:
    mean = rows.filter(F.col(value).isNotNull()).groupBy("symbol_id").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).filter(F.col("n") >= least)
    return mean.orderBy(F.desc("mean"), "symbol_id").limit(n).withColumn("side", F.lit("best")).unionByName(mean.orderBy("mean", "symbol_id").limit(n).withColumn("side", F.lit("worst")))


def first_opposite_run(rows: DataFrame, state: str, n: int) -> DataFrame:
    """First run of at least n consecutive rows in a state, per symbol."""
    w = along(order="week_end")
    run = rows.withColumn("_k", F.row_number().over(w) - F.row_number().over(Window.partitionBy("symbol_id", "stage").orderBy("week_end")))
    runs = run.filter(F.col("stage") == state).groupBy("symbol_id", "_k").agg(F.count("*").alias("length"), F.min("week_end").alias("since")).filter(F.col("length") >= n)
    return runs.groupBy("symbol_id").agg(F.min("since").alias("since"), F.min_by("length", "since").alias("length"))


def psi(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Population stability index over the reference's tenths, as one row."""
    edges = reference.agg(F.percentile(value, F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("_e"))
    share = lambda df, name: df.filter(F.col(value).isNotNull()).join(F.broadcast(edges)).select(F.aggregate("_e", F.lit(0), lambda a, e: a + (F.col(value) > e).cast("int")).alias("bin")).groupBy("bin").agg(F.count("*").alias(name))
    both = share(reference, "_r").join(share(current, "_c"), "bin", "full_outer").na.fill(0, ["_r", "_c"])
    total = both.agg(F.sum("_r").alias("_tr"), F.sum("_c").alias("_tc"))
    a, b = F.greatest(F.col("_c") / F.col("_tc"), F.lit(1e-6)), F.greatest(F.col("_r") / F.col("_tr"), F.lit(1e-6))
    return both.join(F.broadcast(total)).agg(F.sum((a - b) * F.log(a / b)).alias("psi"))


def top_labels(rows: DataFrame, value: str, share: float = 0.4) -> DataFrame:
    """Label 1 for the outcomes in the top share of their date."""
    edge = F.percentile(value, F.lit(1 - share)).over(Window.partitionBy("trade_date"))
    return rows.filter(F.col(value).isNotNull()).withColumn("label", (F.col(value) >= edge).cast("int"))


def top_decile_precision(rows: DataFrame, score: str, label: str, value: str) -> DataFrame:
    part = Window.partitionBy("trade_date")
    k = F.row_number().over(part.orderBy(F.desc(score), "symbol_id"))
    top = rows.withColumns({"_k": k, "_n": F.count(F.lit(1)).over(part)}).filter(F.col("_k") <= F.ceil(0.1 * F.col("_n")))
    return top.groupBy("trade_date").agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("precision"), F.avg(value).alias("mean_return"))


def wilson(rows: DataFrame, hits: str, total: str, z: float = 1.96) -> DataFrame:
    """Rate with its Wilson interval; null without trials."""
    n, p = F.nullif(F.col(total).cast("double"), F.lit(0.0)), F.col(hits) / F.nullif(F.col(total).cast("double"), F.lit(0.0))
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return rows.withColumns({"rate": p, "low": (mid - half) / scale, "high": (mid + half) / scale})
