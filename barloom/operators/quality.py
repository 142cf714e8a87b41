"""Data quality and trust: violation columns, rule tables and quality aggregates over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.stats import along, ratio, reasons


def close_() -> Column:
    return F.col("close")


def high_() -> Column:
    return F.col("high")


def low_() -> Column:
    return F.col("low")


def open_() -> Column:
    return F.col("open")


def by_symbol() -> WindowSpec:
    return along()



def bar_violations(bars: DataFrame) -> DataFrame:
    """What is wrong with each bar, as a comma-joined list; empty for valid bars. A null volume counts as 0."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing = prices[0].isNull() | prices[1].isNull() | prices[2].isNull() | prices[3].isNull()
    return bars.withColumn("violations", F.concat_ws(",", reasons((missing, "null_price"), (F.coalesce("volume", F.lit(0.0)) < 0, "volume"), (high_() < F.greatest(open_(), close_(), low_()), "high"), (low_() > F.least(open_(), close_(), high_()), "low"))))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected rows."""
    return rows.filter("violations = ''").drop("violations"), rows.filter("violations <> ''")


def delivery_violations(rows: DataFrame) -> DataFrame:
    d = F.col("delivery_pct")
    return rows.withColumn("violations", F.concat_ws(",", reasons((d.isNull() | (d < 0) | (d > 100), "delivery_pct"), (F.coalesce("volume", F.lit(0.0)) < 0, "volume"))))


def rule_table(bars: DataFrame, key: tuple[str, ...] = ("symbol_id", "trade_date")) -> DataFrame:
    """One row per rule with its number of failing rows."""
    rules = {"null_fields": close_().isNull() | open_().isNull(), "ohlc": (high_() < low_()) | (high_() < close_()) | (low_() > close_()), "negative_volume": F.col("volume") < 0, "wide_range": ratio(high_(), low_()) > 2}
    counted = bars.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    listed = counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("failed")) for k in rules])).alias("x")).select("x.rule", "x.failed")
    doubles = bars.groupBy(*key).count().filter("count > 1").agg(F.lit("duplicate_key").alias("rule"), F.count("*").alias("failed"))
    return listed.unionByName(doubles)


def moves(bars: DataFrame) -> DataFrame:
    return bars.withColumn("move", ratio(close_(), F.lag("close").over(by_symbol())) - 1)


def jump_days(bars: DataFrame, median: float = 0.1, symbols: int = 3) -> DataFrame:
    """Per day: median absolute move, shares of moves beyond 30, 50 and 100 %, and whether the day is suspicious."""
    m = F.abs("move")
    day = moves(bars).filter("move is not null").groupBy("trade_date").agg(F.count("*").alias("n"), F.percentile(m, F.lit(0.5)).alias("median_move"), *[F.avg((m > k / 100).cast("double")).alias(f"over_{k}") for k in (30, 50, 100)])
    return day.withColumn("flagged", (F.col("n") >= symbols) & (F.col("median_move") > median))


def provider_shares(rows: DataFrame) -> DataFrame:
    """Shares of providers on the latest date; one row, since only one date is asked for."""
    end = rows.agg(F.max("trade_date").alias("trade_date"))
    last = rows.join(F.broadcast(end), "trade_date", "left_semi")
    share = lambda name: F.avg((F.col("provider") == name).cast("double")).alias(f"{name}_share")
    return last.agg(F.count("*").alias("n"), share("primary"), share("fallback"), F.avg(F.col("provider").isNull().cast("double")).alias("unknown_share")).withColumn("low", F.col("primary_share") < 0.7)


def unadjusted_gaps(bars: DataFrame, actions: DataFrame, gap: float = 0.3, days: int = 3) -> DataFrame:
    """Moves of at least ``gap`` within some days of an ex-date. Actions are few per symbol and meet bars by symbol."""
    near = F.abs(F.datediff("trade_date", "ex_date")) <= days
    return moves(bars).filter(F.abs("move") >= gap).join(actions, "symbol_id").filter(near).select("symbol_id", "trade_date", "move", "ex_date")


def segment_drift(rows: DataFrame, as_of: Column, limit: float = 0.05) -> DataFrame:
    age = F.datediff(as_of, F.col("trade_date"))
    odd = (F.col("segment") != "regular").cast("double")
    out = rows.agg(F.avg(F.when((age >= 0) & (age < 7), odd)).alias("recent"), F.avg(F.when((age >= 7) & (age < 37), odd)).alias("prior"))
    return out.withColumns({"delta": F.col("recent") - F.col("prior"), "drift": F.coalesce(F.abs(F.col("recent") - F.col("prior")) > limit, F.lit(False))})


def critical_universe(bars: DataFrame, n: int, as_of: Column, lookback: int = 365, min_days: int = 10) -> DataFrame:
    """The n symbols of the highest median traded value within the look-back that traded on enough days."""
    age = F.datediff(as_of, F.col("trade_date"))
    recent = bars.filter((age >= 0) & (age <= lookback)).groupBy("symbol_id").agg(F.percentile(close_() * F.col("volume"), F.lit(0.5)).alias("median_value"), F.count("*").alias("days"))
    return recent.filter(F.col("days") >= min_days).orderBy(F.round("median_value", 6).desc(), "symbol_id").limit(n)


def quarantine_state(universe: DataFrame, quarantine: DataFrame, limit: float = 0.1) -> DataFrame:
    """How many symbols of the universe are in active quarantine, and whether that share is too high."""
    hit = quarantine.filter("active").select("symbol_id").distinct().withColumn("_q", F.lit(1))
    return universe.join(hit, "symbol_id", "left").agg(F.count("*").alias("universe"), F.count("_q").alias("quarantined")).withColumn("blocked", F.col("quarantined") > limit * F.col("universe"))


def sector_coverage(rows: DataFrame, limit: float = 0.1) -> DataFrame:
    return rows.agg(F.avg(F.col("sector").isNull().cast("double")).alias("missing_share")).withColumn("failed", F.coalesce(F.col("missing_share") > limit, F.lit(False)))


def basis_shifts(bars: DataFrame, gap: float = 0.3, symbols: int = 2) -> DataFrame:
    """Dates on which at least so many symbols gap: how many, and the median and largest gap."""
    hit = moves(bars).withColumn("_m", F.abs("move")).filter(F.col("_m") >= gap)
    day = hit.groupBy("trade_date").agg(F.countDistinct("symbol_id").alias("symbols"), F.percentile("_m", F.lit(0.5)).alias("median_gap"), F.max("_m").alias("max_gap"))
    return day.filter(F.col("symbols") >= symbols)


def reconcile_providers(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Each primary close with the fallback's: confidence 1 where equal, 0.8 with a note where not, null without one."""
    other = fallback.select("symbol_id", "trade_date", F.col("close").alias("_o"))
    differs = F.abs(close_() - F.col("_o")) > 0
    return primary.join(other, ["symbol_id", "trade_date"], "left").withColumns({"confidence": F.when(differs, 0.8).when(F.col("_o").isNotNull(), 1.0), "note": F.when(differs, "differs")}).drop("_o")


def stale_quarantine(quarantine: DataFrame, bars: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Symbols in active quarantine for longer, that have no bar on or after that date, with the first such date."""
    old = quarantine.filter(F.col("active") & (F.datediff(as_of, F.col("from_date")) > days))
    seen = bars.groupBy("symbol_id").agg(F.max("trade_date").alias("_last"))
    later = old.join(seen, "symbol_id", "left").filter(F.col("_last").isNull() | (F.col("_last") < F.col("from_date")))
    return later.groupBy("symbol_id").agg(F.min("from_date").alias("since"))


def trust_state(rows: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Latest provider of each symbol and whether it is quarantined."""
    last = rows.groupBy("symbol_id").agg(F.max_by("provider", "trade_date").alias("provider"), F.max("trade_date").alias("last_date"))
    flagged = quarantine.filter("active").select("symbol_id").distinct().withColumn("_q", F.lit(True))
    return last.join(flagged, "symbol_id", "left").select("symbol_id", "provider", "last_date", F.coalesce("_q", F.lit(False)).alias("quarantined"))


def trust_summary(rows: DataFrame, quarantine: DataFrame, warn: float = 0.2, block: float = 0.5) -> DataFrame:
    """Per date: providers, fallback ratio, quarantined symbols and a status."""
    active = quarantine.filter("active").select("symbol_id").distinct().withColumn("_q", F.lit(1))
    day = rows.join(active, "symbol_id", "left").groupBy("trade_date").agg(F.count("*").alias("n"), F.avg((F.col("provider") == "fallback").cast("double")).alias("fallback_ratio"), F.count("_q").alias("quarantined"))
    return day.withColumn("status", F.when(F.col("quarantined") > block * F.col("n"), "blocked").when(F.col("fallback_ratio") > warn, "degraded").otherwise("trusted"))


def compare_bars(stored: DataFrame, reference: DataFrame) -> DataFrame:
    """Per symbol: dates missing from the stored bars, extra in them, mismatched and matched."""
    key = ["symbol_id", "trade_date"]
    both = stored.select(*key, close_().alias("_a"), F.lit(True).alias("_s")).join(reference.select(*key, close_().alias("_b"), F.lit(True).alias("_r")), key, "full_outer")
    kind = F.when(F.col("_s").isNull(), "missing").when(F.col("_r").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "match").otherwise("mismatch")
    return both.groupBy("symbol_id").agg(*[F.count_if(kind == k).alias(k) for k in ("missing", "extra", "mismatch", "match")])


def shift_score(left: DataFrame, right: DataFrame, days: int) -> DataFrame:
    """Share of a symbol's dates that meet the other provider's when shifted by some days."""
    a, b = left.select("symbol_id", "trade_date").distinct(), right.select("symbol_id", "trade_date").distinct()
    hits = a.select("symbol_id", F.date_add("trade_date", days).alias("trade_date")).join(b, ["symbol_id", "trade_date"]).groupBy("symbol_id").agg(F.count("*").alias("_h"))
    sizes = a.groupBy("symbol_id").agg(F.count("*").alias("_a")).join(b.groupBy("symbol_id").agg(F.count("*").alias("_b")), "symbol_id")
    return sizes.join(hits, "symbol_id", "left").select("symbol_id", (F.coalesce("_h", F.lit(0)) / F.least("_a", "_b")).alias("score"))


def scale_ratio(left: DataFrame, right: DataFrame, field: str = "close") -> DataFrame:
    joined = left.select("symbol_id", "trade_date", F.col(field).alias("_a")).join(right.select("symbol_id", "trade_date", F.col(field).alias("_b")), ["symbol_id", "trade_date"])
    return joined.groupBy("symbol_id").agg(F.percentile(ratio(F.col("_a"), F.col("_b")), F.lit(0.5)).alias("scale"), F.count("*").alias("n"))


def stale_symbols(bars: DataFrame, cutoff: Column, min_rows: int = 300) -> DataFrame:
    out = bars.groupBy("symbol_id").agg(F.max("trade_date").alias("last_date"), F.count("*").alias("n"))
    return out.filter((F.col("last_date") <= cutoff) | (F.col("n") < min_rows))


def readiness(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("ready", F.row_number().over(by_symbol()) >= n)


def feature_confidence(rows: DataFrame) -> DataFrame:
    """The smaller of readiness and provider confidence, within 0 and 1."""
    return rows.withColumn("feature_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("ready"), 1.0).otherwise(0.0), F.coalesce("confidence", F.lit(1.0)))))


def feature_coverage(rows: DataFrame, columns: list[str], run_date: Column, threshold: float = 0.8) -> DataFrame:
    some = F.coalesce(*[F.col(c).cast("double") for c in columns]).isNotNull()
    out = rows.agg(F.avg(some.cast("double")).alias("coverage"), F.max(F.when(some, F.col("trade_date"))).alias("latest"))
    return out.withColumns({"low_coverage": F.coalesce(F.col("coverage") < threshold, F.lit(True)), "stale": F.coalesce(F.col("latest") < run_date, F.lit(True))})


def compare_cells(left: DataFrame, right: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Counts of cells that differ beyond the tolerance or are missing on a side; both have the key and ``value``."""
    both = left.select(*key, F.col("value").alias("_a")).join(right.select(*key, F.col("value").alias("_b")), key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").when(F.abs(F.col("_a") - F.col("_b")) > tolerance, "mismatch").otherwise("match")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
