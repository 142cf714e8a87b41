"""Fundamentals, valuation, candidate lists, events and trade ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.stats import along, clip, full, pct_rank, ratio, reasons


def by_quarter() -> WindowSpec:
    return along(order="report_date")



# --- fundamentals -------------------------------------------------------------------------------------------


def trailing_year(rows: DataFrame, *metrics: str) -> DataFrame:
    """Sums over four quarters, only where four are known."""
    spec = by_quarter().rowsBetween(-3, 0)
    return rows.withColumns({f"ttm_{m}": full(F.sum(m).over(spec), spec, 4, F.col(m)) for m in metrics})


def pivot_metrics(long: DataFrame, metrics: list[str]) -> DataFrame:
    """Long metric rows to columns; the value that became available last counts."""
    return long.groupBy("symbol_id", "report_date").pivot("metric", metrics).agg(F.max_by("value", "available_at"))


def growth(rows: DataFrame) -> DataFrame:
    """Quarter and year growth, yearly growth rate over eight quarters and the number of growing quarters of four."""
    s = F.col("sales")
    rows = rows.withColumns({"qoq": ratio(s, F.lag("sales", 1).over(by_quarter())) - 1, "yoy": ratio(s, F.lag("sales", 4).over(by_quarter())) - 1, "cagr_8": F.when((F.lag("sales", 8).over(by_quarter()) > 0) & (s > 0), F.sqrt(s / F.lag("sales", 8).over(by_quarter())) - 1)})
    return rows.withColumn("positive_4", F.sum((F.coalesce(F.col("qoq"), F.lit(0.0)) > 0).cast("int")).over(by_quarter().rowsBetween(-3, 0)))


def insight_tags(rows: DataFrame) -> DataFrame:
    """Zero or more tags per company and quarter, with the evidence as JSON."""
    evidence = F.to_json(F.struct(F.round("qoq", 4).alias("qoq"), F.round("yoy", 4).alias("yoy")))
    tags = reasons((F.col("yoy") > 0.5, "great_result"), ((F.col("qoq") > 0) & (F.col("yoy") < 0), "turnaround"), (F.col("positive_4") >= 3, "compounder"))
    return rows.withColumn("evidence", evidence).withColumn("tag", F.explode(tags)).select("symbol_id", "report_date", "tag", "evidence")


def sector_growth(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    joined = rows.join(sectors, "symbol_id")
    out = joined.groupBy("sector", "report_date").agg(F.sum("sales").alias("sales"), F.percentile("yoy", F.lit(0.5)).alias("median_yoy"), F.avg((F.col("yoy") > 0).cast("double")).alias("growing_share"))
    return out.withColumn("sales_yoy", ratio(F.col("sales"), F.lag("sales", 4).over(Window.partitionBy("sector").orderBy("report_date"))) - 1)


def leadership(rows: DataFrame) -> DataFrame:
    """Weighted percentile score of sectors per date and a trend label."""
    score = 50 * F.coalesce(pct_rank(F.round("sales_yoy", 9), "report_date"), F.lit(0.5)) + 50 * F.coalesce(pct_rank(F.round("median_yoy", 9), "report_date"), F.lit(0.5))
    return rows.withColumn("score", score).withColumn("trend", F.when(F.col("score") >= 70, "leading").when(F.col("score") >= 40, "middle").otherwise("lagging"))


def within_sector(rows: DataFrame, metric: str, invert: bool = False) -> DataFrame:
    value = pct_rank(metric, "sector")
    return rows.withColumn(f"{metric}_pct", 100 * (1 - value if invert else value))


def own_history(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Median of the last n observations and the share of them at or below the current one."""
    spec = by_quarter().rowsBetween(-(n - 1), 0)
    seen = F.collect_list(value).over(spec)
    rows = rows.withColumns({"_seen": seen, f"{value}_median": F.percentile(value, F.lit(0.5)).over(spec)})
    here = F.col(value)
    share = F.when(here.isNotNull(), F.size(F.filter("_seen", lambda x: x <= here)) / F.nullif(F.size("_seen"), F.lit(0)))
    return rows.withColumn(f"{value}_own_pct", share).drop("_seen")


def valuation_zone(share: Column) -> Column:
    return F.when(share <= 0.2, "cheap").when(share <= 0.8, "fair").when(share > 0.8, "rich")


def trimmed(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median, mean between the 10 % and 90 % quantiles, and share below zero, per group."""
    edges = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.1)).alias("_lo"), F.percentile(value, F.lit(0.9)).alias("_hi"), F.percentile(value, F.lit(0.5)).alias("median"))
    joined = rows.join(edges, list(keys))
    return joined.groupBy(*keys, "median").agg(F.avg(F.when(F.col(value).between(F.col("_lo"), F.col("_hi")), F.col(value))).alias("trimmed_mean"), F.avg((F.col(value) < 0).cast("double")).alias("loss_share"))


def compare_snapshots(now: DataFrame, before: DataFrame, value: str) -> DataFrame:
    old = before.select("symbol_id", F.col(value).alias("_o"))
    delta = F.col(value) - F.col("_o")
    return now.join(old, "symbol_id", "left").withColumns({"delta": delta, "trend": F.when(delta > 5, "improving").when(delta < -5, "deteriorating").when(delta.isNotNull(), "stable").otherwise("new")}).drop("_o")


def first_to_last_growth(rows: DataFrame, value: str) -> DataFrame:
    """Yearly growth from the first to the last positive value."""
    positive = rows.filter(F.col(value) > 0).groupBy("symbol_id").agg(F.min("report_date").alias("_d0"), F.max("report_date").alias("_d1"), F.min_by(value, "report_date").alias("_a"), F.max_by(value, "report_date").alias("_b"))
    years = F.datediff("_d1", "_d0") / 365.25
    return positive.filter(F.col("_d1") > F.col("_d0")).select("symbol_id", (F.pow(F.col("_b") / F.col("_a"), 1 / years) - 1).alias("cagr"))


def fundamental_score(rows: DataFrame) -> DataFrame:
    """Blend of quality, growth and size parts with a tier and red flags."""
    quality, grown, size = clip(50 + 100 * F.coalesce("qoq", F.lit(0.0)), 0, 100), clip(50 + 100 * F.coalesce("yoy", F.lit(0.0)), 0, 100), clip(F.col("orders") * 10, 0, 100)
    rows = rows.withColumn("score", 0.4 * quality + 0.4 * grown + 0.2 * size)
    flags = reasons((F.col("yoy") < -0.5, "collapse"), (F.col("orders") < 2, "thin"), (F.col("yoy").isNull(), "no_history"))
    return rows.withColumns({"tier": F.when(F.col("score") >= 70, "A").when(F.col("score") >= 55, "B").when(F.col("score") >= 40, "C").otherwise("D"), "red_flags": F.concat_ws(",", flags)})


# --- lists --------------------------------------------------------------------------------------------------


def watchlist(ranked: DataFrame, broke: DataFrame) -> DataFrame:
    """Ranked symbols with their best breakout, the gates they fail and tags."""
    best = broke.filter("setup_family is not null").groupBy("symbol_id").agg(F.max_by("setup_family", F.struct("conviction", "trade_date")).alias("setup_family"), F.max("conviction").alias("conviction"))
    rows = ranked.join(best, "symbol_id", "left")
    fails = reasons((F.col("composite") < 50, "rank"), (F.coalesce("conviction", F.lit(0.0)) < 60, "conviction"), (F.col("setup_family").isNull(), "no_setup"))
    tags = reasons((F.col("composite") >= 80, "leader"), (F.col("conviction") >= 80, "power"))
    return rows.withColumns({"fails": F.concat_ws(",", fails), "n_fails": F.size(fails), "first_fail": F.get(fails, 0), "tags": F.concat_ws(",", tags)})


def watch_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("watch_score", 0.6 * F.col("composite") + 0.3 * F.coalesce("conviction", F.lit(0.0)) - 5 * F.col("n_fails"))


def priority_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.when((F.col("composite") >= 80) & (F.col("n_fails") == 0), "1_act").when(F.col("n_fails") == 0, "2_ready").when(F.col("n_fails") == 1, "3_near").otherwise("4_rest"))


def repeat_counts(events: DataFrame, as_of: Column, *days: int) -> DataFrame:
    """Appearances within several look-backs, first and last value, and whether it grew."""
    age = F.datediff(as_of, F.to_date("ts"))
    out = events.groupBy("symbol_id", "category").agg(*[F.count_if((age >= 0) & (age < n)).alias(f"seen_{n}") for n in days], F.min_by("importance", "event_id").alias("first_value"), F.max_by("importance", "event_id").alias("last_value"))
    return out.withColumn("escalated", F.col("last_value") > F.col("first_value"))


def screen(rows: DataFrame, filters: dict[str, tuple[str, float]], sort: str, limit: int) -> DataFrame:
    """Numeric filters by column (>=, <=); a missing value never passes. Sorted with nulls last, then by symbol."""
    for column, (op, value) in filters.items():
        rows = rows.filter(F.col(column) >= value if op == ">=" else F.col(column) <= value)
    return rows.orderBy(F.round(sort, 6).desc_nulls_last(), "symbol_id").limit(limit)


def progress(rows: DataFrame, signals: list[str], time: str = "trade_date") -> DataFrame:
    """Improved and worsened signals against the observation before, and what they add up to."""
    w = along(order=time)
    up = sum(((F.col(c) > F.lag(c).over(w)).cast("int") for c in signals[1:]), (F.col(signals[0]) > F.lag(signals[0]).over(w)).cast("int"))
    down = sum(((F.col(c) < F.lag(c).over(w)).cast("int") for c in signals[1:]), (F.col(signals[0]) < F.lag(signals[0]).over(w)).cast("int"))
    rows = rows.withColumns({"improved": F.coalesce(up, F.lit(0)), "worsened": F.coalesce(down, F.lit(0))})
    return rows.withColumn("progress", F.when(F.col("improved") > F.col("worsened"), "PROGRESSING").when(F.col("improved") < F.col("worsened"), "REGRESSING").otherwise("FLAT"))


# --- events -------------------------------------------------------------------------------------------------

#: Days for which each kind of event counts.
LOOKBACK = {"purchase": 10, "signup": 20, "error": 3, "click": 2}


def materiality(events: DataFrame, trust: DataFrame) -> DataFrame:
    """Weighted materiality of events; sources are a handful."""
    joined = events.join(trust, "source", "left")
    return joined.withColumn("materiality", 0.35 * clip(F.col("importance") / 2, 0, 100) + 0.25 * F.coalesce("trust", F.lit(50.0)) + 0.40 * F.when(F.col("category") == "purchase", 80.0).otherwise(30.0))


def within_lookback(events: DataFrame, as_of: Column) -> DataFrame:
    days = F.lit(5)
    for name, n in LOOKBACK.items():
        days = F.when(F.col("category") == name, n).otherwise(days)
    age = F.datediff(as_of, F.to_date("ts"))
    return events.filter((age >= 0) & (age <= days))


def corroborated(events: DataFrame, hours: int = 24) -> DataFrame:
    """Events that another source reported for the same symbol and kind within some hours.

    The nearest event of each other source before and after decides, found by
    carrying times along the symbol's events, so no pairs are formed.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("symbol_id", "category").orderBy("ts", "event_id")
    # what follows is read from the other end, since a frame that shrinks would be worked out anew for each event
    back = Window.partitionBy("symbol_id", "category").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = events.withColumn("_t", t)
    near = []
    for s in (0, 1):
        other = F.when(F.col("source") == s, F.col("_t"))
        before = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        after = F.last(other, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
        gap = F.least(F.col("_t") - before, after - F.col("_t"))
        near.append((F.col("source") != s) & (gap <= hours * 3_600_000_000))
    return rows.withColumn("_ok", F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))).filter("_ok").drop("_ok", "_t")


def suppressed(events: DataFrame, published: DataFrame, days: int = 7) -> DataFrame:
    """Events without those whose symbol and kind were published within some days before."""
    last = published.select("symbol_id", "category", F.to_date("ts").alias("_p")).distinct()
    near = last.select("symbol_id", "category", F.explode(F.sequence(F.col("_p"), F.date_add("_p", days))).alias("_day")).distinct()
    return events.withColumn("_day", F.to_date("ts")).join(near, ["symbol_id", "category", "_day"], "left_anti").drop("_day")


def triggers(events: DataFrame, least: float) -> DataFrame:
    """One trigger per symbol and day from events over a value, with a clipped strength."""
    hit = events.filter(F.col("importance") >= least).withColumn("day", F.to_date("ts"))
    return hit.groupBy("symbol_id", "day").agg(F.max("importance").alias("_m"), F.count("*").alias("n")).select("symbol_id", "day", clip(F.col("_m") / 2, 0, 100).alias("strength"), "n")


#: Words that tell the kind of a catalyst, with their score.
CATALYSTS = (("purchase|order", "demand", 3.0), ("signup", "growth", 2.0), ("error|fail", "risk", -2.0))


def catalysts(events: DataFrame, text: str = "category") -> DataFrame:
    """Best evidence per symbol by key words."""
    kind, score = F.lit("none"), F.lit(0.0)
    for words, name, points in reversed(CATALYSTS):
        hit = F.lower(text).rlike(words)
        kind, score = F.when(hit, name).otherwise(kind), F.when(hit, points).otherwise(score)
    rows = events.withColumns({"catalyst": kind, "score": score})
    best = F.struct("score", "importance", "event_id")
    return rows.groupBy("symbol_id").agg(F.max_by("catalyst", best).alias("catalyst"), F.max("score").alias("score"), F.max_by("event_id", best).alias("event_id"))


# --- ledgers ------------------------------------------------------------------------------------------------


def fifo(trades: DataFrame) -> DataFrame:
    """First-in-first-out matches of buys and sells with realised profit.

    Buys and sells become intervals of the running quantity of their side; two
    overlap where their quantities meet. Instead of comparing all pairs, the
    borders of both sides are merged in order, and each piece takes the last buy
    and the last sell that opened at or before it: one window, no pairs. Sells
    beyond what was bought have no match.
    """
    key = ["account", "instrument"]
    order = Window.partitionBy(*key, "side").orderBy("executed_on", "l_orderkey", "l_linenumber", "price", "qty")
    runs = trades.withColumns({"_end": F.sum("qty").over(order.rowsBetween(Window.unboundedPreceding, 0))}).withColumn("_start", F.col("_end") - F.col("qty"))
    buy = F.when(F.col("side") == "BUY", F.struct("price", "executed_on", "_end"))
    sell = F.when(F.col("side") == "SELL", F.struct("price", "executed_on", "_end"))
    cuts = runs.select(*key, F.col("_start").alias("_at"), buy.alias("_b"), sell.alias("_s"))
    merged = cuts.groupBy(*key, "_at").agg(F.max("_b").alias("_b"), F.max("_s").alias("_s"))
    along_ = Window.partitionBy(*key).orderBy("_at")
    so_far = along_.rowsBetween(Window.unboundedPreceding, 0)
    pieces = merged.withColumns({"_b": F.last("_b", ignorenulls=True).over(so_far), "_s": F.last("_s", ignorenulls=True).over(so_far), "_next": F.lead("_at").over(along_)})
    upto = F.least(F.coalesce("_next", F.col("_b._end")), F.col("_b._end"), F.col("_s._end"))
    lots = pieces.withColumn("qty", upto - F.col("_at")).filter((F.col("qty") > 0) & F.col("_b").isNotNull() & F.col("_s").isNotNull())
    return lots.select(*key, "qty", F.col("_b.executed_on").alias("bought_on"), F.col("_s.executed_on").alias("sold_on"), (F.col("qty") * (F.col("_s.price") - F.col("_b.price"))).alias("pnl"))


def net_positions(trades: DataFrame) -> DataFrame:
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    return trades.groupBy("account", "instrument").agg(F.sum(signed).alias("net_qty"), F.max("executed_on").alias("last_fill"), F.count("*").alias("fills")).filter("net_qty <> 0")


def compare_positions(ledger: DataFrame, broker: DataFrame, tolerance: float = 1.0) -> DataFrame:
    key = ["account", "instrument"]
    both = ledger.select(*key, F.col("net_qty").alias("_l")).join(broker.select(*key, F.col("net_qty").alias("_b")), key, "full_outer")
    return both.select(*key, F.when(F.col("_l").isNull(), "broker_only").when(F.col("_b").isNull(), "ledger_only").when(F.abs(F.col("_l") - F.col("_b")) <= tolerance, "match").otherwise("mismatch").alias("result"))


def ledger_statistics(lots: DataFrame) -> DataFrame:
    p = F.col("pnl")
    return lots.groupBy("account").agg(F.count("*").alias("lots"), F.sum("pnl").alias("pnl"), ratio(F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))).alias("profit_factor"), F.avg("pnl").alias("expectancy"), F.avg((p > 0).cast("double")).alias("win_rate"))


def fill_costs(trades: DataFrame, bps: float = 5.0) -> DataFrame:
    value = F.col("qty") * F.col("price")
    return trades.withColumns({"value": value, "cost": value * bps / 10_000, "net": F.when(F.col("side") == "BUY", -value * (1 + bps / 10_000)).otherwise(value * (1 - bps / 10_000))})


def position_size(rows: DataFrame, capital: float, risk: float = 0.01, mult: float = 2.0) -> DataFrame:
    return rows.withColumn("shares", F.floor(F.coalesce(ratio(F.lit(capital * risk), mult * F.col("atr_14")), F.lit(0.0))))


def limit_breaches(positions: DataFrame, max_positions: int, max_weight: float) -> DataFrame:
    part = Window.partitionBy("account")
    weight = ratio(F.abs("net_qty"), F.sum(F.abs("net_qty")).over(part))
    why = reasons((F.count(F.lit(1)).over(part) > max_positions, "positions"), (weight > max_weight, "weight"))
    return positions.withColumn("breaches", F.concat_ws(",", why))
