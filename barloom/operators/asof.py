"""Point-in-time joins and selections: as-of, bitemporal, reconciliation of two sets of events.

As-of joins are unions: both sides go into one window by key and time, where
the last known right-hand row is carried on. That costs one shuffle, works for
any skew in time, and never compares pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], strict: bool = False) -> DataFrame:
    """Attach the columns of the latest right-hand row at or before (strictly: before) each left-hand row's time.

    Several right-hand rows of one time resolve to the greatest struct of the
    columns. Rows with null keys or times get nothing.
    """
    packed = right.filter(F.col(right_time).isNotNull()).groupBy(key, F.col(right_time).alias("_t")).agg(F.max(F.struct(F.col(right_time).alias("_at"), *columns)).alias("_r"))
    rows = left.withColumns({"_t": F.col(left_time), "_side": F.lit(0 if strict else 1)}).unionByName(packed.withColumn("_side", F.lit(1 if strict else 0)), allowMissingColumns=True)
    is_left = F.col("_side") == (0 if strict else 1)
    before = Window.partitionBy(key).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(before)).filter(is_left)
    return carried.select(*left.columns, F.col("_r._at").alias("matched_at"), *[F.col(f"_r.{c}").alias(c) for c in columns])


def known_by(rows: DataFrame, cutoff: Column) -> DataFrame:
    return rows.filter(F.coalesce("available_at", "published_at") <= cutoff)


def membership_at(rows: DataFrame, effective: Column, available: Column) -> DataFrame:
    """Memberships in force at one time as recorded by another, without those superseded by then; the best per symbol."""
    known = rows.filter((F.col("recorded_at") <= available) & (F.col("valid_from") <= effective) & (F.col("valid_to").isNull() | (F.col("valid_to") > effective)))
    gone = rows.filter((F.col("recorded_at") <= available) & F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id"))
    n = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("trust"), F.desc("recorded_at"), F.desc("id")))
    return known.join(gone, "id", "left_anti").withColumn("_n", n).filter("_n = 1").drop("_n")


def resolve_observations(rows: DataFrame, quarantined: DataFrame, cutoff: Column) -> DataFrame:
    """Latest trusted observation of each entity known by the cutoff: week, then status, then time of record."""
    n = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("week_end"), F.desc("status_rank"), F.desc("recorded_at")))
    return rows.filter(F.col("recorded_at") <= cutoff).join(quarantined.select("symbol_id", "week_end"), ["symbol_id", "week_end"], "left_anti").withColumn("_n", n).filter("_n = 1").drop("_n")


def latest_at(rows: DataFrame, as_of: Column, time: str, key: str = "symbol_id") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))
    return rows.filter(F.col(time) <= as_of).withColumn("_n", n).filter("_n = 1").drop("_n")


def prior_state(rows: DataFrame, state: str, time: str, key: str = "symbol_id") -> DataFrame:
    """For each row the state before it, since when that held and for how many rows."""
    w = Window.partitionBy(key).orderBy(time)
    change = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))
    run = rows.withColumn("_run", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(key, "_run").orderBy(time)
    known = run.withColumns({"_age": F.row_number().over(island), "_since": F.first(time).over(island)})
    return known.withColumns({"prior_state": F.lag(state).over(w), "prior_age": F.lag("_age").over(w), "prior_since": F.lag("_since").over(w)}).drop("_run", "_age", "_since")


def filter_by_stage(candidates: DataFrame, stages: DataFrame, allowed: list[str], min_confidence: float, require: bool) -> DataFrame:
    snap = stages.select("symbol_id", "stage", F.col("confidence").alias("_c"))
    joined = candidates.join(snap, "symbol_id", "inner" if require else "left")
    good = F.col("stage").isin(allowed) & (F.col("_c") >= min_confidence)
    return joined.filter(good if require else good | F.col("stage").isNull()).drop("_c")


def candidate_union(sources: list[tuple[str, DataFrame]], fields: list[str]) -> DataFrame:
    """One row per symbol over candidate sources in order of priority: first known fields, all sources, the primary one."""
    tagged = [df.select("symbol_id", *fields).withColumns({"_p": F.lit(i), "_name": F.lit(name)}) for i, (name, df) in enumerate(sources)]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_p"))).alias(f) for f in fields]
    order = F.array_sort(F.collect_set(F.struct("_p", "_name")))
    return rows.groupBy("symbol_id").agg(*first, F.array_join(F.transform(order, lambda x: x["_name"]), ",").alias("sources"), F.min_by("_name", "_p").alias("primary_source"))


def reconcile_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per symbol, how two event sets relate: before, same_day, after, left_only or right_only, and repeats."""
    a = left.groupBy("symbol_id").agg(F.min("day").alias("left_day"), F.count("*").alias("_na"))
    b = right.groupBy("symbol_id").agg(F.min("day").alias("right_day"), F.count("*").alias("_nb"))
    rel = F.when(F.col("right_day").isNull(), "left_only").when(F.col("left_day").isNull(), "right_only").when(F.col("left_day") < F.col("right_day"), "before").when(F.col("left_day") == F.col("right_day"), "same_day").otherwise("after")
    return a.join(b, "symbol_id", "full_outer").select("symbol_id", "left_day", "right_day", rel.alias("relation"), ((F.coalesce("_na", F.lit(0)) > 1) | (F.coalesce("_nb", F.lit(0)) > 1)).alias("repeated"))


def episodes(rows: DataFrame, key: list[str], time: str) -> DataFrame:
    """Episode id, first-observation flag and number of observations."""
    w = Window.partitionBy(*key)
    return rows.withColumns({"episode_id": F.concat_ws(":", *[F.col(k).cast("string") for k in key]), "is_first": F.row_number().over(w.orderBy(time)) == 1, "observations": F.count(F.lit(1)).over(w)})
