"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Unset, a temporary folder serves a local master; a cluster has none of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = spark.conf.get("barloom.shared.dir", None)
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("barloom.shared.dir", known)
    return known


def kept(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder once and read back, so that what follows does not work them out again."""
    path = f"{shared_dir(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Number all rows 1, 2, 3 ... without a window over all of them.

    Ranges of the order are written once, sorted on their own, and start where the
    earlier ones end; one count for each range is broadcast. Rows that the order
    does not tell apart come in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = kept(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_c")).select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    placed = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(starts), "_range").withColumn(name, placed).drop("_range", "_before")
