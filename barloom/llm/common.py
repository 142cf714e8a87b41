"""Helpers shared by the text operations."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.shared import shared_dir

#: Words are maximal runs of characters other than space, \t, \n, \v, \f and \r.
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of texts; the largest row may exceed it.
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
NOT_GAP = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(docs: DataFrame, found: Column, names: list[str]) -> DataFrame:
    """``docs`` with the fields of a struct as columns; columns of those names are replaced, and no other name is taken."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), found.alias("found"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in names], *[F.col("found")[c].alias(c) for c in names])


def held_out(doc_id: Column | str, mod: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; false for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for null, empty and blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def n_words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, GAP))).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Let Python tasks get texts in batches of BATCH_BYTES at most, however long the texts are."""
    now = spark.conf.get(BATCH_KEY, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def stash(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back: later steps neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/barloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._barloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what ``stash`` wrote for a result that no later step reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._barloom_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs whose DataFrames are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row of ``key`` and ``label`` (0 or 1) for each id; ids that are null or labelled both ways are left out."""
    known = labels.select(key, F.col(label).cast("int").alias(label)).filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    return known.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_other")).filter(F.col(label) == F.col("_other")).drop("_other")


def bounded_sample(df: DataFrame, key: str, strata: str, limit: int, salt: int = 17) -> DataFrame:
    """At most ``limit`` distinct keys of each of the values of ``strata``, the same ones on every run.

    Keys are taken in the order of a hash. Each value's count says below which
    hash about three times ``limit`` of its keys lie, so that only a bounded
    number of rows of a value, however frequent, meets in one window. Null values
    are left out. All values take part, whatever their number.
    """
    rows = df.filter(F.col(strata).isNotNull() & F.col(key).isNotNull()).select(key, strata).withColumn("_h", F.xxhash64(F.col(key), F.lit(salt)))
    counts = rows.groupBy(strata).agg(F.count("*").alias("_n"))
    # share of all hashes; values of few rows keep them all
    low = (F.col("_h").cast("double") / 2.0**64 + 0.5) * F.col("_n") <= 3 * limit + 64
    thinned = rows.join(counts, strata).filter(low).select(key, strata, "_h").distinct()
    order = Window.partitionBy(strata).orderBy("_h", key)
    return thinned.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= limit).select(key, strata)
