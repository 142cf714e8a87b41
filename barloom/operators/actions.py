"""Corporate actions, identity and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_actions(rows: DataFrame) -> DataFrame:
    """Price and share factors from the free text of bonus issues and splits; null where the text says neither."""
    text = F.lower("subject")
    number = lambda pattern, k: F.expr(f"try_cast(regexp_extract(lower(subject), '{pattern}', {k}) AS double)")
    bonus, split = r"bonus\\D*(\\d+)\\s*:\\s*(\\d+)", r"from\\D*(\\d+(?:\\.\\d+)?)\\D+to\\D*(\\d+(?:\\.\\d+)?)"
    ratio = F.when(text.contains("bonus"), (number(bonus, 1) + number(bonus, 2)) / number(bonus, 2)).when(text.rlike("split|sub-division"), number(split, 1) / number(split, 2))
    kind = F.when(text.contains("bonus"), "bonus").when(text.rlike("split|sub-division"), "split")
    return rows.withColumns({"action": kind, "share_factor": ratio, "price_factor": 1 / ratio})


def reconcile(fetched: DataFrame, stored: DataFrame, key: list[str], value: str) -> DataFrame:
    """Status of each action key: inserted, changed, unchanged or deactivated."""
    both = fetched.select(*key, F.col(value).alias("_f"), F.lit(True).alias("_in")).join(stored.select(*key, F.col(value).alias("_s"), F.lit(True).alias("_was")), key, "full_outer")
    status = F.when(F.col("_was").isNull(), "inserted").when(F.col("_in").isNull(), "deactivated").when(F.col("_f").eqNullSafe(F.col("_s")), "unchanged").otherwise("changed")
    return both.select(*key, F.coalesce("_f", "_s").alias(value), status.alias("status"))


def adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Prices times the factors of all actions with a later ex-date.

    Actions turn into intervals of dates with one factor each (running products
    from the latest back), and bars take the interval they are in by a window
    over both, so no bar meets more than one action.
    """
    back = Window.partitionBy("symbol_id").orderBy(F.desc("ex_date")).rowsBetween(Window.unboundedPreceding, 0)
    daily = actions.groupBy("symbol_id", "ex_date").agg(F.sum(F.log("price_factor")).alias("_l"))
    steps = daily.select("symbol_id", F.col("ex_date").alias("trade_date"), F.exp(F.sum("_l").over(back)).alias("_factor"), F.lit(1).alias("_step"))
    rows = bars.withColumn("_step", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    # the next action after a bar's date holds the product of itself and all later ones
    ahead = Window.partitionBy("symbol_id").orderBy(F.desc("trade_date"), F.col("_step")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("factor", F.coalesce(F.last("_factor", ignorenulls=True).over(ahead), F.lit(1.0))).filter("_step = 0").drop("_step", "_factor")
    return out.withColumns({f"adjusted_{c}": F.col(c) * F.col("factor") for c in ("open", "high", "low", "close")})


def action_set_hash(actions: DataFrame) -> DataFrame:
    """One hash of the set, the same in any order; the list holds one short line for each action of a symbol."""
    lines = actions.select("symbol_id", F.concat_ws("|", F.col("symbol_id").cast("string"), F.col("ex_date").cast("string"), F.round("price_factor", 6).cast("string")).alias("x"))
    per = lines.groupBy("symbol_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), ","), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("action_hash"))


def canonical(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    return rows.join(aliases, "symbol_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "symbol_id"))


#: Series codes and their trading segment.
SEGMENTS = {"EQ": "regular", "BE": "trade_to_trade", "BZ": "trade_to_trade", "SM": "sme", "ST": "sme"}


def segment(series: Column) -> Column:
    out = F.lit("other")
    for code, name in SEGMENTS.items():
        out = F.when(series == code, name).otherwise(out)
    return out


def one_security(listings: DataFrame) -> DataFrame:
    """One row per security with its distinct listings."""
    return listings.groupBy("isin").agg(F.sort_array(F.collect_set("listing")).alias("listings"), F.min("symbol_id").alias("symbol_id"))


def trading_days(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    return bars.filter(F.col("trade_date").between(start, end)).select("trade_date").distinct()


def first_of_month(days: DataFrame) -> DataFrame:
    return days.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.min("trade_date").alias("first_day"))


def gap_days(last: DataFrame, target: Column, holidays: DataFrame) -> DataFrame:
    """Weekdays after each symbol's last bar up to the target that are no holidays."""
    days = last.filter(F.col("last_date") < target).select("symbol_id", F.explode(F.sequence(F.date_add("last_date", 1), target)).alias("day")).filter(F.weekday("day") < 5)
    return days.join(holidays.select(F.col("holiday").alias("day")), "day", "left_anti").groupBy("symbol_id").agg(F.count("*").alias("missing"))
