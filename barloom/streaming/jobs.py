"""Stateful steps as Structured Streaming jobs. Each takes and gives streaming (or batch) DataFrames of events.

Events have event_id, symbol_id, category, importance, source and ts (timestamp).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sources.store import table_path

EVENTS = "event_id long, symbol_id long, category string, importance double, source long, ts timestamp"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    # as a pattern, the path may name a single file as well as a folder
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.select("event_id", F.col("user_id").alias("symbol_id"), F.col("event_type").alias("category"), F.col("value").alias("importance"), (F.col("event_id") % 2).alias("source"), F.col("ts").cast("timestamp").alias("ts"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table in the shared folder, and read that."""
    spark, path = stream.sparkSession, table_path(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def bars(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling bars; a bar is given out once no event within the limit of lateness can change it."""
    order = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "symbol_id")
        .agg(F.min_by("importance", order).alias("open"), F.max("importance").alias("high"), F.min("importance").alias("low"), F.max_by("importance", order).alias("close"), F.count("*").alias("volume"))
        .select("symbol_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume")
    )


def first_of_kind(events: DataFrame, within: str = "7 days") -> DataFrame:
    """Drop an event whose symbol and category have been seen within the time."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["symbol_id", "category"])


def corroborated(events: DataFrame, other: DataFrame, hours: int = 24) -> DataFrame:
    """Pairs of events of one symbol and category from two sources within some hours; both sides have a watermark."""
    a = events.withWatermark("ts", "1 day").alias("a")
    b = other.select(F.col("event_id").alias("other_id"), F.col("symbol_id").alias("_s"), F.col("category").alias("_c"), F.col("source").alias("_o"), F.col("ts").alias("other_ts")).withWatermark("other_ts", "1 day")
    near = F.expr(f"other_ts BETWEEN ts - INTERVAL {hours} HOURS AND ts + INTERVAL {hours} HOURS")
    return a.join(b, (F.col("symbol_id") == F.col("_s")) & (F.col("category") == F.col("_c")) & (F.col("source") != F.col("_o")) & near).select("event_id", "other_id", "symbol_id", "category")


def appearances(events: DataFrame, width: str = "20 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "symbol_id").count()
    return w.select("symbol_id", F.col("w.end").alias("end"), F.col("count").alias("n"))


EPISODE = "symbol_id long, opened timestamp, last_seen timestamp, peak double, n long, status string"


def episodes(events: DataFrame, idle_days: int = 5) -> DataFrame:
    """Episode life cycle: opens with an event, keeps its peak, and is archived after some idle days of event time."""
    idle = pd.Timedelta(days=idle_days)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        held = state.get if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], *held, "archived"))
            state.remove()
            held = None
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for ts, value in zip(rows["ts"], rows["importance"], strict=True):
                if held and ts - pd.Timestamp(held[1]) > idle:
                    out.append((key[0], *held, "archived"))
                    held = None
                held = (ts, ts, value, 1) if held is None else (held[0], max(pd.Timestamp(held[1]), ts), max(held[2], value), held[3] + 1)
            state.update((pd.Timestamp(held[0]).to_pydatetime(), pd.Timestamp(held[1]).to_pydatetime(), float(held[2]), int(held[3])))
            state.setTimeoutTimestamp(max(int((pd.Timestamp(held[1]) + idle).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["symbol_id", "opened", "last_seen", "peak", "n", "status"])

    return events.withWatermark("ts", "1 day").groupBy("symbol_id").applyInPandasWithState(follow, EPISODE, "opened timestamp, last_seen timestamp, peak double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def split_batches(events: DataFrame, valid: Callable, good: str, bad: str, checkpoint: str) -> None:
    """Each micro-batch into valid and rejected rows, to two tables; a repeated batch overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        ok = valid(batch)
        batch.filter(ok).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter(~ok | ok.isNull()).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def refresh(stored: str, features: Callable[[DataFrame], DataFrame], warmup: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that recomputes features of the symbols in a batch and writes them as that batch's version.

    ``stored`` holds bars; of the symbols in the batch the last ``warmup`` bars
    and the new ones enter the windows.
    """
    from barloom.operators.ranking import tail

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = batch.select("symbol_id").distinct()
        history = tail(spark.read.parquet(f"{stored}/bars").join(touched, "symbol_id", "left_semi"), warmup)
        rows = history.select(*batch.columns).unionByName(batch).dropDuplicates(["symbol_id", "trade_date"])
        fresh = features(rows).join(batch.select("symbol_id", "trade_date"), ["symbol_id", "trade_date"], "left_semi")
        fresh.write.mode("overwrite").parquet(f"{stored}/features/version={number}")

    return step
