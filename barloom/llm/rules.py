"""Quality rules: fixed limits on words and repeats, then a hashed n-gram likelihood ratio.

Words and word pairs hash into a fixed number of buckets. Two multinomials over
the buckets, of texts labelled good (the trusted target) and of the whole raw
corpus, give each bucket a log-likelihood ratio; a document's verdict is the mean
ratio of its n-grams against a fixed threshold. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stash, words_of

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Buckets of the multinomials: a constant, so the table of weights never grows.
BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Labelled ids up to this many (16 bytes each) go to all tasks.
BROADCAST_IDS = 2_000_000
THRESHOLD = -0.15

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _word_hashes(words: Column) -> Column:
    """Each word is hashed once; windows and n-grams hash these numbers."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _window_hashes(words: Column) -> Column:
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    return F.when(last >= 1, hashes)


def _repeated_starts(hashes: Column) -> Column:
    """Sorted start positions of the windows whose hash occurs twice or more; null where all differ."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ordered)


def base_rules(docs: DataFrame) -> DataFrame:
    """Add the word and repeat figures, ``base_failed`` and the hashes of the words (``_words``).

    Null texts count as empty: no words, and failed. A line counts as repeated
    when it has a word and equals an earlier line of its text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blanks = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(blanks)) != "")
    measured = (
        docs.withColumn("_parts", words_of(F.col("text")))
        .withColumn("_words", _word_hashes(F.col("_parts")))
        .drop("_parts")
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.translate(text, blanks, "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "_hashes": _window_hashes(F.col("_words")),
            }
        )
        .drop("_lines")
        .withColumn("_ordered", _repeated_starts(F.col("_hashes")))
        .drop("_hashes")
    )
    ordered = F.col("_ordered")
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter(ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1))), lambda x: x["i"]))
    counted = measured.withColumn("_starts", F.when(ordered.isNotNull(), starts)).drop("_ordered")
    at = F.col("_starts")
    steps = F.transform(at, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(at, i + 1) - x), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return (
        counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_starts")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def _buckets(words: Column) -> Column:
    """Buckets of all words and neighbouring word pairs, from the words' hashes."""
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    single = F.transform(words, lambda w: bucket(w))
    double = F.transform(words, lambda w, i: bucket(F.xxhash64(F.get(words, i - 1), w)))
    return F.concat(single, F.slice(double, 2, F.greatest(F.size(words) - 1, F.lit(0))))


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Log-likelihood ratio (target against raw) of each bucket that occurs.

    Every document counts towards the raw multinomial, every document labelled
    1 towards the target. Counts are summed before they are shuffled.
    """
    good = labels.filter(F.col("quality") == 1).select("doc_id").distinct().withColumn("_good", F.lit(1))
    if good.count() <= BROADCAST_IDS:  # beyond that the texts are shuffled to the ids
        good = F.broadcast(good)
    grams = docs.select("doc_id", words_of(F.col("text")).alias("_parts")).select("doc_id", _word_hashes(F.col("_parts")).alias("_words")).join(good, "doc_id", "left")
    counts = stash(
        grams.select("_good", F.explode(_buckets(F.col("_words"))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("_good").alias("target"))
    )
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not total["target"]:  # nothing to compare with
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    share = lambda c: (F.col(c) + SMOOTHING) / (total[c] + SMOOTHING * BUCKETS)
    return counts.select("bucket", (F.log(share("target")) - F.log(share("raw"))).alias("weight"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base figures, ``llr`` and ``kept``.

    ``llr`` is the mean weight of the document's n-grams, 0 without words. A
    document is kept when the base rules pass and ``llr`` reaches the threshold.
    The same text always gets the same verdict; a ratio equal to the threshold is
    kept. Repeated rows stay apart. Without any text labelled 1 there is no target
    and every ratio is 0, so the base rules alone decide. Ids with a label 1
    among others count as good. Texts of any length are taken whole. Empty tables
    give an empty result; other columns of ``docs`` are ignored.
    """
    # the weights have at most BUCKETS rows, so the broadcast has a fixed bound
    known = F.broadcast(weights(docs, labels))
    figures = base_rules(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"))
    rows = figures.select("_row", "doc_id", *BASE, F.explode_outer(_buckets(F.col("_words"))).alias("bucket"))
    scored = rows.join(known, "bucket", "left").groupBy("_row", "doc_id", *BASE).agg(F.coalesce(F.avg("weight"), F.lit(0.0)).alias("llr"))
    return scored.drop("_row").withColumn("kept", ~F.col("base_failed") & (F.round("llr", 9) >= threshold))
