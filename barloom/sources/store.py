"""Partitioned and versioned tables, incremental replacement, and raw CSV sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.shared import shared_dir


def table_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def with_fallback(rows: DataFrame) -> DataFrame:
    """Adjusted prices where they are known, else the raw ones; absent columns count as unknown."""
    have = set(rows.columns)
    return rows.withColumns({c: F.coalesce(F.col(f"adjusted_{c}"), F.col(c)) if f"adjusted_{c}" in have else F.col(c) for c in ("open", "high", "low", "close")})


def restrict(rows: DataFrame, symbols: DataFrame | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows of a date range and a symbol list; the filters reach the scan."""
    if start is not None:
        rows = rows.filter(F.col("trade_date") >= start)
    if end is not None:
        rows = rows.filter(F.col("trade_date") <= end)
    return rows if symbols is None else rows.join(symbols.select("symbol_id").distinct(), "symbol_id", "left_semi")


def latest_values(rows: DataFrame, as_of: Column, columns: list[str]) -> DataFrame:
    """Values of each symbol's last row at or before a date."""
    return rows.filter(F.col("trade_date") <= as_of).groupBy("symbol_id").agg(F.max("trade_date").alias("trade_date"), *[F.max_by(c, "trade_date").alias(c) for c in columns])


def write_features(rows: DataFrame, path: str, snapshot: str) -> None:
    """Write rows by year and month under a snapshot; writing a snapshot again replaces its partitions."""
    tagged = rows.withColumns({"snapshot_id": F.lit(snapshot), "year": F.year("trade_date"), "month": F.month("trade_date")})
    parted = tagged.repartition("year", "month")
    parted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id", "year", "month").parquet(path)


def read_features(spark: SparkSession, path: str, snapshot: str | None = None, start: str | None = None, end: str | None = None, symbols: list | None = None) -> DataFrame:
    """Read back with pruning by snapshot, year and dates."""
    rows = spark.read.parquet(path)
    if snapshot is not None:
        rows = rows.filter(F.col("snapshot_id") == snapshot)
    if start is not None:
        rows = rows.filter((F.col("year") >= int(start[:4])) & (F.col("trade_date") >= F.to_date(F.lit(start))))
    if end is not None:
        rows = rows.filter((F.col("year") <= int(end[:4])) & (F.col("trade_date") <= F.to_date(F.lit(end))))
    return rows.filter(F.col("symbol_id").isin(symbols)) if symbols else rows


def newer(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows and the fresh ones later than each symbol's last stored date."""
    last = stored.groupBy("symbol_id").agg(F.max("trade_date").alias("_last"))
    late = fresh.join(last, "symbol_id", "left").filter(F.col("_last").isNull() | (F.col("trade_date") > F.col("_last"))).drop("_last")
    return stored.unionByName(late)


def replace_tail(stored: DataFrame, fresh: DataFrame, cutoff: Column) -> DataFrame:
    """Stored rows before the cutoff and the recomputed ones; of equal keys the fresh row stays."""
    rows = stored.filter(F.col("trade_date") < cutoff).withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("symbol_id", "trade_date").orderBy(F.desc("_new")))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n", "_new")


def attach_master(rows: DataFrame, master: DataFrame) -> DataFrame:
    """Join the master; a blank or missing sector is Other."""
    return rows.join(master, "symbol_id", "left").withColumn("sector", F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("Other")))


#: Column names of the two dialects of raw bar files.
DIALECTS = {"symbol_id": ("SC_CODE", "FinInstrmId"), "trade_date": ("TRADING_DATE", "TradDt"), "open": ("OPEN", "OpnPric"), "high": ("HIGH", "HghPric"), "low": ("LOW", "LwPric"), "close": ("CLOSE", "ClsPric"), "volume": ("NO_OF_SHRS", "TtlTradgVol")}


def raw_bars(raw: DataFrame) -> DataFrame:
    """Bars from text columns of either dialect; rows without all prices go, and one row of each key stays."""
    have = {c.lstrip("﻿").strip(): c for c in raw.columns}
    pick = {k: next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None).cast("string")) for k, names in DIALECTS.items()}
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    day = F.coalesce(F.to_date(F.try_to_timestamp(pick["trade_date"], F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(pick["trade_date"], F.lit("dd-MM-yyyy"))))
    rows = raw.select(pick["symbol_id"].try_cast("long").alias("symbol_id"), day.alias("trade_date"), *[number(pick[c]).alias(c) for c in ("open", "high", "low", "close", "volume")])
    n = F.row_number().over(Window.partitionBy("symbol_id", "trade_date").orderBy(F.desc("volume"), F.desc("close"), F.desc("open"), F.desc("high"), F.desc("low")))
    return rows.dropna(subset=["symbol_id", "trade_date", "open", "high", "low", "close"]).withColumn("_n", n).filter("_n = 1").drop("_n")


def normalise(raw: DataFrame, numbers: list[str], flags: list[str]) -> DataFrame:
    """Plain column names, numbers and booleans from text; unknown columns stay."""
    import re

    named = raw.toDF(*[re.sub(r"[^a-z0-9]+", "_", c.lstrip("﻿").strip().lower()).strip("_") for c in raw.columns])
    out = {c: F.regexp_replace(c, "[,%]", "").try_cast("double") for c in numbers if c in named.columns}
    out |= {c: F.when(F.lower(c).isin("y", "yes", "true", "1"), True).when(F.lower(c).isin("n", "no", "false", "0"), False) for c in flags if c in named.columns}
    return named.withColumns(out) if out else named
