"""Importance resampling towards a target distribution over hashed n-grams.

Every run of one to three words falls into one of a fixed number of buckets. Two
multinomials over the buckets, of the raw corpus and of the target texts, give
each bucket an integer gain; the gains are one small array that scores a document
in one pass. With Gumbel noise from a hash of its id added, the highest scores are
a draw without replacement in proportion to the weights. The cutoff comes from a
quantile sketch: two of its values bracket the wanted rank, exact counts of the
rows beyond each end validate the bracket or widen it, and only the rows inside
are ordered to find the last one drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import beside, small_batches, stash

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: First half-width of the bracket, as a share of the rows, and the accuracy of the sketch.
BRACKET = 0.002
ACCURACY = 10_000
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20

#: Word characters stay (A-Z in lower case), all else separates; bytes above 0x7F belong to words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

Text = bytes | None


def pieces(text: Text) -> Iterator[list[bytes]]:
    """The words of a text, a megabyte or one longer word at a time."""
    raw = (text or b"").translate(_LETTERS)
    at = 0
    while at < len(raw):
        cut = raw.find(b" ", at + PIECE)
        cut = len(raw) if cut < 0 else cut
        yield raw[at:cut].split()
        at = cut


def feature_hashes(text: Text, longest: int = LONGEST) -> Iterator[list[int]]:
    """crc32 of the runs of 1, 2 ... ``longest`` words, one list a length and piece; a run's hash carries on that of the run before its last word."""
    held: list[bytes] = []
    for words in pieces(text):
        both = held + words
        new = len(held)  # runs that end before here are done
        hashes = list(map(crc32, both))
        yield hashes[new:]
        spaced = [b" " + w for w in both]
        for size in range(2, longest + 1):
            hashes = list(map(crc32, spaced[size - 1 :], hashes))
            yield hashes[max(0, new - size + 1) :]
        held = both[-(longest - 1) :] if longest > 1 else []


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket`` and ``n``: how often features of all texts fall into it. Each task adds its texts up before rows are shuffled."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch["t"]:
                for found in feature_hashes(text, longest):
                    if found:
                        total += np.bincount(np.array(found, dtype=np.int64) % buckets, minlength=buckets)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    made = texts.select(F.col(column).cast("binary").alias("t")).mapInPandas(count, "bucket int, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from the counts of both sides: one array of a fixed size."""
    sides = []
    for counts in (raw, target):
        side = [0] * buckets
        for bucket, n in counts.collect():  # at most one row a bucket
            side[bucket] = n
        sides.append(side)
    s, t = (float(sum(side)) for side in sides)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + buckets) / ((float(a) + 1) * (t + buckets)))) for a, b in zip(*sides, strict=True)], dtype=np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down; a null id has that of the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight`` to every row; columns of those names are replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            out = np.zeros((len(texts), 3), dtype=np.int64)
            for row, text in zip(out, texts, strict=True):
                for k, found in enumerate(feature_hashes(text, longest)):
                    if k % longest == 0:
                        row[0] += len(found)
                    row[1] += len(found)
                    if found:
                        row[2] += own[np.array(found, dtype=np.int64) % len(own)].sum()
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return beside(docs, scored(F.col("text").cast("binary")), ["n_words", "n_features", "weight"])


def bracket(scores: DataFrame, wanted: int, n: int) -> tuple[int, int, int]:
    """Two scores between which the ``wanted``-th highest lies, and the exact number of rows above them.

    The sketch proposes the ends; only exact counts of the rows above the upper
    end and from the lower end on settle that the wanted rank is between them.
    """
    half = BRACKET
    while True:
        share = 1 - wanted / n
        ends = [max(0.0, share - half), min(1.0, share + half)]
        low, high = scores.agg(F.percentile_approx("score", ends, ACCURACY)).first()[0]
        if ends[0] == 0.0 or ends[1] == 1.0:  # the sketch's extremes are exact
            exact = scores.agg(F.min("score"), F.max("score")).first()
            low, high = exact[0] if ends[0] == 0.0 else low, exact[1] if ends[1] == 1.0 else high
        above, reached = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < wanted <= reached:
            return low, high, above
        half *= 4


def in_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows 1, 2, 3 ... by ``order``: ranges are sorted on their own and start where the earlier ones end.

    ``order`` must tell all rows apart. The ranges are written, so that a lost
    executor deals no row anew; one count for each range is broadcast.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stash(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranges.join(F.broadcast(before), "_range")
    return placed.withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).drop("_range", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score and rank (null where not drawn).

    Drawn are floor(percent * N / 100) of the N documents with at least
    ``min_words`` words: those with the highest scores, ties to the smaller doc_id
    (null last). Rows of one id with one score go by weight and features, and alike
    ones in an order of their own. Null, empty and wordless texts have no features,
    weight 0 and are not drawn; without target texts all gains follow from
    smoothing alone. Texts of any length are read whole, in pieces. An empty table
    gives an empty result; other columns of both tables are ignored.
    """
    gain = gains(bucket_counts(docs, buckets=buckets, longest=longest), bucket_counts(target, buckets=buckets, longest=longest), buckets)
    weighed = weigh(docs.select("doc_id", "text"), gain, longest).drop("text")
    scored = stash(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_row", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= min_words)
    n = able.count()
    wanted = percent * n // 100
    plain = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("_row")]
    low, high, above = bracket(able, wanted, n)
    inside = in_order(able.filter(F.col("score").between(low, high)), order, "_place").filter(F.col("_place") <= wanted - above).drop("_place")
    drawn = in_order(able.filter(F.col("score") > high).unionByName(inside), order, "rank")
    rest = scored.join(drawn.select("_row"), "_row", "left_anti")
    return drawn.select(*plain, F.col("rank").cast("long")).unionByName(rest.select(*plain, F.lit(None).cast("long").alias("rank")))
